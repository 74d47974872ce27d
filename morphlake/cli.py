"""``python -m morphlake.cli DICTIONARY [INPUT] [OUTPUT] [--variant NAME] [--seconds N] [--metrics-only]``: a text file
lemmatized line by line.

Without an output, lines go to standard output. With ``--seconds`` the lookup is repeated and its rates are printed; with
``--metrics-only`` it is run once and the times of its phases are printed, both without the text. Without an input, the
demonstration looks up its own words.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from morphlake.operators.dictionary import bounded_dictionary, require_entries, trie_dictionary
from morphlake.operators.lemmatize import explode_tokens, lemmatize_lines
from morphlake.operators.lookup import VARIANTS, lookup, sized
from morphlake.operators.metrics import phase_times, throughput, word_count
from morphlake.plans import fixtures as fx
from morphlake.sources.dictionary_csv import parse_lines, read_dictionary_lines
from morphlake.sources.text import read_lines, write_lines


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="morphlake")
    parser.add_argument("dictionary")
    parser.add_argument("input", nargs="?")
    parser.add_argument("output", nargs="?")
    parser.add_argument("--variant", choices=("packed", "single_thread", "stride", "bounded"), default="packed")
    parser.add_argument("--seconds", type=float)
    parser.add_argument("--metrics-only", action="store_true")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("morphlake").getOrCreate()
    lines = parse_lines(read_dictionary_lines(spark, given.dictionary))
    dictionary = require_entries((bounded_dictionary if given.variant == "bounded" else trie_dictionary)(lines).cache())
    variant = VARIANTS[given.variant]
    if given.input is None:
        for row in lookup(fx.demo(spark), dictionary, variant).orderBy("i").collect():
            print(row["token"], row["lemma"])
        return 0
    texts = read_lines(spark, given.input).select("line_no", "line")
    found = lemmatize_lines(texts, dictionary, ["line_no"], variant=variant)
    if given.metrics_only:
        tokens = explode_tokens(texts, ["line_no"], "line")
        phases = {"dictionary": lambda: dictionary, "scan": lambda: texts, "tokenize": lambda: tokens, "lookup": lambda: lookup(tokens, sized(dictionary), variant), "end_to_end": lambda: found}
        words, took = word_count(texts, "line").first()["words"], phase_times(phases)
        del took["total"]  # the later phases hold the earlier ones
        print(f"Words: {words}", *[f"  {name}: {ms:.1f} ms" for name, ms in took.items()], f"  {throughput(words, took['end_to_end']):.0f} words/s", sep="\n", file=sys.stderr)
        return 0
    if given.seconds is not None:
        words, began, times = word_count(texts, "line").first()["words"], time.time(), []
        while not times or time.time() - began < given.seconds:
            start = time.time()
            found.write.format("noop").mode("overwrite").save()
            times.append(1000 * (time.time() - start))
        print(f"{len(times)} iterations, mean {sum(times) / len(times):.1f} ms, longest {max(times):.1f} ms, {throughput(words * len(times), sum(times)):.0f} words/s", file=sys.stderr)
    elif given.output:
        write_lines(found, given.output)
    else:
        for row in found.orderBy("line_no").select("text").toLocalIterator():
            print(row["text"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
