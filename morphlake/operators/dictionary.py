"""Dictionary builders: from parsed lines (line_no, wordform, lemma, parsed) to keyed relations (key, lemma)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.functions.text import byte_length, byte_prefix, tokens_whitespace

MOST_PAIRS = 7_000_000
SLOT = 32


def first_wins(entries: DataFrame) -> DataFrame:
    return entries.groupBy("key").agg(F.min_by("lemma", "line_no").alias("lemma"))


def trie_dictionary(parsed: DataFrame) -> DataFrame:
    """Every parsed line without a hyphen in its wordform, also with an empty wordform or lemma; the first line of a key wins."""
    kept = parsed.filter("parsed and not contains(wordform, '-')")
    return first_wins(kept.select("line_no", F.lower("wordform").alias("key"), "lemma"))


def bounded_dictionary(parsed: DataFrame, slot: int = SLOT) -> DataFrame:
    """Non-empty, hyphen-free lines whose key and lemma are shorter than a slot; the first of those wins."""
    kept = parsed.filter("wordform <> '' and lemma <> '' and not contains(wordform, '-')").select("line_no", F.lower("wordform").alias("key"), "lemma")
    return first_wins(kept.filter((byte_length(F.col("key")) < slot) & (byte_length(F.col("lemma")) < slot)))


def pair_dictionary(parsed: DataFrame, most: int | None = MOST_PAIRS, slot: int = SLOT) -> DataFrame:
    """line_no, wordform, lemma and their first bytes: different non-empty pairs in order of appearance, case and hyphens kept."""
    pairs = parsed.filter("wordform <> '' and lemma <> ''").groupBy("wordform", "lemma").agg(F.min("line_no").alias("line_no"))
    kept = pairs if most is None else pairs.orderBy("line_no").limit(most)
    return kept.select("line_no", "wordform", "lemma", byte_prefix(F.col("wordform"), slot).alias("key_bytes"), byte_prefix(F.col("lemma"), slot).alias("lemma_bytes"))


def automaton_entries(parsed: DataFrame) -> DataFrame:
    """Different (key, lemma) of non-empty, hyphen-free lines; a key may have several lemmas."""
    return parsed.filter("wordform <> '' and lemma <> '' and not contains(wordform, '-')").select(F.lower("wordform").alias("key"), "lemma").distinct()


def resolve(entries: DataFrame, policy: str = "greatest") -> DataFrame:
    """One lemma a key: the greatest or the least in byte order."""
    pick = {"greatest": F.max, "least": F.min}[policy]
    return entries.groupBy("key").agg(pick("lemma").alias("lemma"))


def trie_statistics(dictionary: DataFrame) -> DataFrame:
    """states, transitions and lemma_bytes of the byte trie that the keys would make: one state a different byte prefix."""
    code = F.hex(F.encode("key", "UTF-8"))
    sizes = F.sequence(F.lit(1), F.octet_length("key"))
    prefixes = dictionary.filter("key <> ''").select(F.explode(F.transform(sizes, lambda i: F.substring(code, F.lit(1), 2 * i))).alias("prefix"))
    states = prefixes.agg((F.count_distinct("prefix") + 1).alias("states"))
    lemma_bytes = dictionary.agg(F.coalesce(F.sum(F.octet_length("lemma") + 1), F.lit(0)).cast("long").alias("lemma_bytes"))
    return states.select("states", (F.col("states") - 1).alias("transitions"), F.lit(1).alias("one")).join(lemma_bytes.withColumn("one", F.lit(1)), "one").select("states", "transitions", "lemma_bytes")


def corpus_dictionary(texts: DataFrame, text: str = "text", endings: str = "(s|en|tion)$") -> DataFrame:
    """A dictionary from a corpus's own lower-cased tokens: those with such an ending, less the ending; none with a hyphen.

    Each text gives its different fitting tokens, so far fewer rows than tokens reach the exchange.
    """
    tokens = F.array_distinct(tokens_whitespace(F.lower(text)))
    fitting = F.filter(tokens, lambda t: F.regexp_like(t, F.lit(endings)) & ~F.contains(t, F.lit("-")))
    keys = texts.select(F.explode(fitting).alias("key")).distinct()
    return keys.select("key", F.regexp_replace("key", endings, "").alias("lemma"))


def require_entries(dictionary: DataFrame) -> DataFrame:
    """The dictionary, or an exception if it is empty."""
    if dictionary.limit(1).count() == 0:
        raise ValueError("the dictionary is empty")
    return dictionary


def load_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at the path; built and written there first if it is missing."""
    try:
        return require_entries(spark.read.parquet(path))
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    build().write.mode("overwrite").parquet(path)
    return require_entries(spark.read.parquet(path))
