"""Counts and rates of lemmatizer runs."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphlake.functions.text import byte_length, tokens_whitespace


def line_word_counts(lines: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    return lines.select(*keys, F.size(tokens_whitespace(F.coalesce(line, F.lit("")))).cast("long").alias("words"))


def word_count(texts: DataFrame, text: str = "text") -> DataFrame:
    return texts.agg(F.coalesce(F.sum(F.size(tokens_whitespace(F.coalesce(text, F.lit(""))))), F.lit(0)).cast("long").alias("words"))


def truncated_words(tokens: DataFrame, slot: int = 32) -> DataFrame:
    """Tokens that a slot with a terminator does not hold."""
    return tokens.filter(byte_length(F.col("token")) >= slot).agg(F.count(F.lit(1)).alias("truncated"))


def cardinalities(found: DataFrame, keys: list[str]) -> DataFrame:
    """words, lemmas (neither empty nor null) and texts of a lookup's result."""
    return found.agg(F.count(F.lit(1)).alias("words"), F.count(F.when(F.col("lemma") != "", 1)).alias("lemmas"), F.count_distinct(F.struct(*keys)).alias("texts"))


def throughput(words: int, milliseconds: float) -> float:
    """Words a second, 0 if no time passed."""
    return words / (milliseconds / 1000) if milliseconds > 0 else 0.0


def phase_times(phases: dict[str, Callable[[], DataFrame]]) -> dict[str, float]:
    """Milliseconds of each phase, run to the end without output, and of all of them (``total``). A phase holds those it
    reads from unless their result is stored."""
    took = {}
    for name, made in phases.items():
        began = time.perf_counter()
        made().write.format("noop").mode("overwrite").save()
        took[name] = 1000 * (time.perf_counter() - began)
    return took | {"total": sum(took.values())}


def loop_statistics(runs: DataFrame) -> DataFrame:
    """From (words, ms) a run: iterations, mean and longest time, words a second over all of them."""
    total = F.sum("ms")
    rate = F.when(total > 0, F.sum("words") / (total / 1000)).otherwise(0.0)
    return runs.agg(F.count(F.lit(1)).alias("iterations"), F.avg("ms").alias("mean_ms"), F.max("ms").alias("longest_ms"), rate.alias("words_per_second"))
