"""One lookup operator; its variants differ in policies, not in code.

A lookup is an equi-join of tokens with a keyed dictionary, at most one match a token. The dictionary is broadcast while
its checked number of rows allows it; beyond that Spark joins by exchange and splits hot tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphlake.functions.text import byte_prefix, cut_text

#: Dictionary rows (some tens of bytes each) that are broadcast at most.
BROADCAST_ROWS = 2_000_000


@dataclass(frozen=True)
class Variant:
    """``lower``: fold the token's case first. ``token_bytes``: a slot that cuts the token, and what a miss returns.
    ``lemma_bytes``: a slot that cuts the lemma. ``empty_is_miss``: an empty lemma gives the whole token. ``misses``:
    whether tokens without a match stay."""

    lower: bool = False
    token_bytes: int | None = None
    lemma_bytes: int | None = 32
    empty_is_miss: bool = False
    misses: bool = True


COLUMNAR = Variant()
PACKED = Variant(lower=True, empty_is_miss=True)
SINGLE_THREAD = Variant(lower=True)
STRIDE = Variant(lower=True, token_bytes=31, lemma_bytes=31, empty_is_miss=True)
BOUNDED = Variant(lower=True, token_bytes=31, lemma_bytes=None, empty_is_miss=True)
LINEAR = Variant(token_bytes=32)
EXACT = Variant(misses=False)
VARIANTS = {"columnar": COLUMNAR, "packed": PACKED, "single_thread": SINGLE_THREAD, "stride": STRIDE, "bounded": BOUNDED, "linear": LINEAR, "exact": EXACT}


def sized(dictionary: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The dictionary with a broadcast hint if it has no more rows than that."""
    return F.broadcast(dictionary) if dictionary.limit(most + 1).count() <= most else dictionary


def lookup(tokens: DataFrame, dictionary: DataFrame, variant: Variant = COLUMNAR) -> DataFrame:
    """The tokens' columns and ``lemma``. ``tokens`` has a column ``token``, ``dictionary`` key and lemma."""
    token = F.lower("token") if variant.lower else F.col("token")
    cut = token if variant.token_bytes is None else cut_text(token, variant.token_bytes)
    keyed = dictionary.select(F.col("key").alias("__key"), F.col("lemma").alias("__lemma"))
    found = tokens.withColumn("__token", cut).join(keyed, F.col("__token") == F.col("__key"), "left" if variant.misses else "inner")
    return found.withColumn("lemma", _result(token, F.col("__token"), F.col("__lemma"), variant)).drop("__token", "__key", "__lemma")


def _result(token: Column, cut: Column, lemma: Column, variant: Variant) -> Column:
    hit = lemma if variant.lemma_bytes is None else cut_text(lemma, variant.lemma_bytes)
    if variant.empty_is_miss:
        hit = F.when(hit == "", token).otherwise(hit)
    return F.when(lemma.isNull(), cut).otherwise(hit)


def missing(tokens: DataFrame, dictionary: DataFrame, variant: Variant = EXACT) -> DataFrame:
    """The tokens without a match."""
    token = F.lower("token") if variant.lower else F.col("token")
    keys = dictionary.select(F.col("key").alias("__key"))
    return tokens.join(keys, token == F.col("__key"), "left_anti")


def linear_dictionary(pairs: DataFrame, slot: int = 32) -> DataFrame:
    """From pairs to key and lemma by their first bytes; of one key the earliest pair counts."""
    cut = pairs.select("line_no", byte_prefix(F.col("wordform"), slot).cast("string").alias("key"), cut_text(F.col("lemma"), slot).alias("lemma"))
    return cut.groupBy("key").agg(F.min_by("lemma", "line_no").alias("lemma"))
