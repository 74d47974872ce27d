"""Positions of pattern matches in code points, with DataFrame functions alone.

A text is the alternation of what a pattern's matches leave between them and the matches, so running sums of the two
lists' lengths are the positions. Sums run in blocks of ``_BLOCK`` matches and then over the blocks, which keeps texts
with very many matches from costing the square of their number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from morphlake.llm.common import let

_BLOCK = 256
_SPAN = "array<struct<start:int,end:int,match:string>>"


def _summed(pairs: Column) -> Column:
    """From pairs (gap, match) to a struct of the total length and spans relative to the first gap's start."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(done: Column, pair: Column) -> Column:
        first = done["at"] + F.length(pair["gap"])
        last = first + F.length(pair["match"])
        one = F.struct(first.alias("start"), last.alias("end"), pair["match"].alias("match"))
        return F.struct(last.alias("at"), F.concat(done["out"], F.array(one)).alias("out"))

    return F.aggregate(pairs, start, step)


def _located(pairs: Column) -> Column:
    count = F.ceil(F.size(pairs) / F.lit(_BLOCK)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda b: _summed(F.slice(pairs, b * _BLOCK + 1, F.lit(_BLOCK))))
    return let(blocks, _joined)


def _joined(blocks: Column) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    offsets = F.aggregate(blocks, start, lambda done, b: F.struct((done["at"] + b["at"]).alias("at"), F.concat(done["out"], F.array(done["at"])).alias("out")))["out"]
    shifted = F.zip_with(blocks, offsets, lambda b, o: F.transform(b["out"], lambda s: F.struct((s["start"] + o).alias("start"), (s["end"] + o).alias("end"), s["match"].alias("match"))))
    return F.flatten(shifted)


def find(text: Column, pattern: str) -> Column:
    """All leftmost, non-overlapping matches: array of (start, end, match), end exclusive. Matches must not be empty."""

    def of(matches: Column) -> Column:
        pairs = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
        return F.when(F.size(matches) > 0, let(pairs, _located)).otherwise(F.array().cast(_SPAN))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)


def listed(found: Column, kind: str, order: int) -> Column:
    """The spans as (start, order, end, kind, match), ready to be sorted."""
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["match"].alias("match")))


def by_kind(spans: Column) -> Column:
    """Sorted by kind as listed, then by start."""
    keyed = F.transform(spans, lambda s: F.struct(s["order"].alias("a"), s["start"].alias("b"), s["end"].alias("c"), s.alias("span")))
    return F.transform(F.sort_array(keyed), lambda k: k["span"])


def text_of(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def replaced(text: Column, spans: Column, mark) -> Column:
    """The text with each span, in order of start, replaced by ``mark(span)``; a span inside an earlier one is passed over."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(done: Column, s: Column) -> Column:
        between = F.substring(text, done["at"] + 1, s["start"] - done["at"])
        taken = F.struct(s["end"].alias("at"), F.concat(done["out"], F.array(between, mark(s))).alias("out"))
        return F.when(s["start"] >= done["at"], taken).otherwise(done)

    walked = F.aggregate(spans, start, step)
    rest = F.substring(text, walked["at"] + 1, F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(walked["out"], ""), rest))
