"""Times the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]`` and prints one JSON line.

Every query runs twice into the noop sink; the second, warm run counts. ``words_per_second`` relates the flagship to the
corpus's words, dictionary building included, and ``lookup_words_per_second`` leaves the dictionary out.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from morphlake.operators import dictionary as d
from morphlake.operators.lemmatize import explode_tokens, lemmatize_texts, spread
from morphlake.operators.lookup import Variant, lookup, sized
from morphlake.operators.metrics import phase_times, throughput, word_count
from morphlake.plans.queries import QUERIES, _scratch

HEADLINE = ("lemmatize_documents_ws", "lemmatize_fast", "lemmatize_joined", "lemmatize_documents_columnar", "lemmatize_conversations", "lemmatize_lines", "lookup_corpus_tokens", "tokens_lower", "corpus_dictionary", "word_count", "line_word_count", "lookup_column", "lines_roundtrip")


def timed(make) -> float:
    took = 0.0
    for _ in range(2):
        began = time.time()
        found: DataFrame = make()
        found.write.format("noop").mode("overwrite").save()
        took = time.time() - began
    return round(took, 3)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {name: timed(lambda q=QUERIES[name]: q(spark, sf_dir)) for name in HEADLINE}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = word_count(docs).first()["words"]
    dictionary = d.load_or_build(spark, _scratch(spark), lambda: QUERIES["corpus_dictionary"](spark, sf_dir))
    took["lookup_only"] = timed(lambda: lemmatize_texts(docs, dictionary, ["doc_id"], variant=Variant(lower=True, lemma_bytes=None)))
    tokens = explode_tokens(spread(docs, ["doc_id"]), ["doc_id"])
    phases = phase_times({"scan": lambda: docs.select("text"), "tokenize": lambda: tokens, "lookup": lambda: lookup(tokens, sized(dictionary), Variant(lower=True, lemma_bytes=None))})
    flagship = took["lemmatize_documents_ws"]
    print(json.dumps({"metric": "lemmatize_documents_ws", "value": flagship, "unit": "sec", "queries": took, "sf": sf_dir, "phases_ms": {k: round(v) for k, v in phases.items() if k != "total"}, "words": words, "words_per_second": round(throughput(words, 1000 * flagship)), "lookup_words_per_second": round(throughput(words, 1000 * took["lookup_only"]))}))


if __name__ == "__main__":
    main()
