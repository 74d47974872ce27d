"""Packing of tokenised documents into sequences of at most ``window`` tokens.

A document longer than the window gives whole windows first; what is left of it, if anything, is packed by its length:

1. Lengths are put into bins of ``GRAIN`` tokens, rounded up. Every combination of at most three bins that fills the
   window exactly is enumerated, and non-negative least squares finds repeat counts whose use of the bins comes closest
   to their histogram. Counts are rounded and kept within the histogram.
2. The residual lengths are packed greedily, longest first, each into the fullest sequence it fits, all documents of a
   length and all sequences of one shape at once.
3. Documents of shapes that stay more than a share ``SLACK`` short go into a stream that is cut at the window's borders.

The plan is made from the histogram alone (at most window - 1 lengths) and its size has a bound that does not grow with
the corpus, so it goes to every task with the code. What it says is "the documents of ranks i to i + n among all, by
length, take this slot of the sequences from s on"; a document's rank is its place within its length and salt plus
offsets from sums, so no task holds all documents of one length. Ids are written to the shared folder once and meet their
slots by one exchange.

Edge cases: a null or empty text is one end id; a document of exactly the window is one whole piece; rows that repeat a
doc_id are packed each on its own (``row``); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from morphlake.llm.common import clean_text, store, table, trim
from morphlake.llm.tokens import END_ID, encode_texts, encoder, vocabulary_path

WINDOW = 4096
GRAIN = 16
SLACK = 1 / 170
#: Rows of one length and salt that one task ranks on average, or the root of the commonest length's documents if more.
SALT_ROWS = 1_000


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 3_000) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by active sets: the column that helps most enters, columns at zero leave."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tolerance = 1e-4 * float(np.abs(a.T @ b).max(initial=0.0))  # counts are rounded afterwards
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        enter = int(np.argmax(gain)) if len(gain) else 0
        if not len(gain) or gain[enter] <= tolerance:
            break
        active[enter] = True
        while True:
            own = np.nonzero(active)[0]
            part = a[:, own]
            z = np.linalg.solve(part.T @ part + 1e-9 * np.eye(len(own)), part.T @ b)
            if (z > 0).all():
                x[:] = 0
                x[own] = z
                break
            low = z <= 0
            step = np.min(x[own][low] / np.maximum(x[own][low] - z[low], 1e-300))
            x[own] += step * (z - x[own])
            gone = own[low & (x[own] <= 1e-12)]
            if not len(gone):
                gone = own[low][:1]
            x[gone], active[gone] = 0, False
            if not active.any():
                break
    return x


def combinations_of(bins: int, counts: np.ndarray) -> list[tuple[int, ...]]:
    """Sets of at most three bins (from 1) with documents in them that add up to ``bins``."""
    some = set(np.nonzero(counts)[0].tolist())
    found = [(bins,)] if bins in some else []
    found += [(a, bins - a) for a in some if a <= bins - a and bins - a in some]
    return found + [(a, b, bins - a - b) for a in some for b in some if a <= b <= bins - a - b and bins - a - b in some]


@dataclass
class _Shape:
    """``count`` sequences alike: slots (first rank, length or None if it differs), with ``space`` left."""

    count: int
    space: int
    slots: list[tuple[int, int | None]]

    def split(self, count: int) -> _Shape:
        """Takes the first ``count`` sequences off."""
        first = _Shape(count, self.space, list(self.slots))
        self.slots = [(rank + count, length) for rank, length in self.slots]
        self.count -= count
        return first


def _greedy(lengths: list[tuple[int, int, int]], window: int) -> list[_Shape]:
    """From (length, first rank, documents), longest first: each into the fullest sequences that have the space."""
    by_space: dict[int, list[_Shape]] = {}
    spaces: list[int] = []

    def put(shape: _Shape) -> None:
        if shape.space not in by_space:
            by_space[shape.space] = []
            bisect.insort(spaces, shape.space)
        by_space[shape.space].append(shape)

    def fill(shape: _Shape, length: int, rank: int, times: int) -> None:
        for k in range(times):
            shape.slots.append((rank + k * shape.count, length))
        shape.space -= times * length
        put(shape)

    for length, rank, left in sorted(lengths, reverse=True):
        while left:
            at = bisect.bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                shape = by_space[space].pop()
                if not by_space[space]:
                    del by_space[space], spaces[at]
                if shape.count > left:
                    rest, shape = shape, shape.split(left)
                    put(rest)
                times = min(space // length, left // shape.count)
            else:
                times = min(window // length, left)
                shape = _Shape(left // times, window, [])
            fill(shape, length, rank, times)
            rank, left = rank + times * shape.count, left - times * shape.count
    return [shape for shapes in by_space.values() for shape in shapes]


@dataclass
class Plan:
    """Slots by first rank. ``before``: documents shorter than a length, for all lengths up to the window.

    A slot's offset is ``offset`` plus the lengths of the documents at the same place of its sequence's earlier slots
    (``first``, ``second``: their first ranks, -1 for none). In a stream, ``step`` is the documents' length and
    ``offset`` the place of the first.
    """

    window: int
    before: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    first: np.ndarray
    second: np.ndarray
    step: np.ndarray
    sequences: int
    whole_before: np.ndarray

    def lengths(self, ranks: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.before, ranks, "right") - 1

    def place(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each document's first token."""
        at = np.searchsorted(self.rank, ranks, "right") - 1
        i, offset = ranks - self.rank[at], self.offset[at].copy()
        for earlier in (self.first, self.second):
            has = earlier[at] >= 0
            offset[has] += self.lengths(earlier[at][has] + i[has])
        flat = self.step[at] > 0
        offset[flat] += i[flat] * self.step[at][flat]
        sequence = np.where(flat, self.sequence[at] + offset // self.window, self.sequence[at] + i)
        return sequence, np.where(flat, offset % self.window, offset)


def make_plan(counts: np.ndarray, whole: np.ndarray, window: int = WINDOW, grain: int = GRAIN, slack: float = SLACK) -> Plan:
    """From documents by length left (index 0: none left) and whole windows by that length."""
    counts = np.asarray(counts, np.int64)
    before = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    grain = math.gcd(window, grain)  # bins add up to the window exactly
    binned = -(-np.arange(window) // grain)
    bins = window // grain
    per_bin = np.bincount(binned[1:], counts[1:], minlength=bins + 1).astype(np.int64)
    taken, shapes = np.zeros(bins + 1, np.int64), []
    first_of = np.full(bins + 2, before[window], np.int64)
    for length in range(window - 1, 0, -1):
        first_of[binned[length]] = before[length]
    combos = combinations_of(bins, per_bin)
    if combos:
        a = np.zeros((bins + 1, len(combos)))
        for j, combo in enumerate(combos):
            for b in combo:
                a[b, j] += 1
        scale = max(1.0, float(per_bin.max()))
        x = nonnegative_least_squares(a, per_bin / scale) * scale
        for j in np.argsort(-x, kind="stable"):
            repeat = int(np.rint(x[j]))
            for b in set(combos[j]):
                repeat = min(repeat, int(per_bin[b] - taken[b]) // combos[j].count(b))
            if repeat > 0:
                slots = []
                for b in combos[j]:
                    slots.append((int(first_of[b] + taken[b]), None))
                    taken[b] += repeat
                shapes.append(_Shape(repeat, 0, slots))
    residual = []
    for length in np.nonzero(counts)[0]:
        if length:
            start = max(int(before[length]), int(first_of[binned[length]] + taken[binned[length]]))
            if start < before[length + 1]:
                residual.append((int(length), start, int(before[length + 1]) - start))
    greedy = _greedy(residual, window)
    rows, sequence, position = [], 0, 0
    for shape in shapes + [s for s in greedy if s.space <= slack * window]:
        offset, unknown = 0, []
        for rank, length in shape.slots:
            earlier = [*unknown, -1, -1][:2]
            rows.append((rank, sequence, offset, *earlier, 0))
            if length is None:
                unknown.append(rank)
            else:
                offset += length
        sequence += shape.count
    stream = sorted((rank, length, shape.count) for shape in greedy if shape.space > slack * window for rank, length in shape.slots)
    for rank, length, count in stream:
        rows.append((rank, sequence, position, -1, -1, length))
        position += count * length
    sequence += -(-position // window)
    whole_before = sequence + np.concatenate([[0], np.cumsum(np.asarray(whole, np.int64))[:-1]])
    columns = np.array(sorted(rows) or [(1 << 62, 0, 0, -1, -1, 0)], np.int64).T
    return Plan(window, before, *columns, sequences=int(sequence + np.sum(whole)), whole_before=whole_before)


def _token_rows(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in batches:
            for first, ids, ends in encode_texts(batch.column("text"), words, end_id):
                kind = "<u2" if int(ids.max(initial=0)) < 1 << 16 else "<u4"
                raw, size = memoryview(ids.astype(kind).tobytes()), int(kind[-1])
                starts = [0, *ends[:-1].tolist()]
                data = pa.array([raw[size * a : size * b].tobytes() for a, b in zip(starts, ends.tolist(), strict=True)], pa.binary())
                counts = pa.array(np.diff(ends, prepend=0).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[first : first + len(ends)], counts, data], ["doc_id", "n", "ids"])
                del raw, data, ids
            trim()

    return run


def _pieces(window: int):
    """From rows with ids, n and the place of whole windows and of what is left, to a row a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {name: batch.column(name).to_pylist() for name in ("doc_id", "row", "n", "whole", "sequence", "offset")}
            ids_of, out, size = batch.column("ids"), {k: [] for k in ("doc_id", "row", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")}, 0

            def flush() -> pa.RecordBatch:
                arrays = [pa.array(out["doc_id"], batch.schema.field("doc_id").type)]  # noqa: B023  used at once
                arrays += [pa.array(out[k], pa.int64()) for k in ("row", "start", "length", "doc_tokens", "sequence_id", "offset")]  # noqa: B023
                return pa.RecordBatch.from_arrays([*arrays, pa.array(out["ids"], pa.binary())], list(out))  # noqa: B023

            for k, (doc_id, row, n, whole, sequence, offset) in enumerate(zip(*get.values(), strict=True)):
                raw = ids_of[k].as_py()
                ids = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4").tobytes()
                cuts = [(i * window, window, whole + i, 0) for i in range(n // window)]
                start = n - n % window
                while start < n:
                    length = min(n - start, window - offset)
                    cuts.append((start, length, sequence, offset))
                    start, sequence, offset = start + length, sequence + 1, 0
                for start, length, at, place in cuts:
                    for name, value in zip(out, (doc_id, row, start, length, n, at, place, ids[4 * start : 4 * (start + length)]), strict=True):
                        out[name].append(value)
                    size += length
                if size > 1 << 20:
                    yield flush()
                    out, size = {name: [] for name in out}, 0
            yield flush()

    return run


def _placed(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, left, rank, wholes = (batch.column(c).to_numpy() for c in ("row", "left", "rank", "wholes"))
            sequence, offset = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
            some = left > 0
            sequence[some], offset[some] = plan.place(plan.before[left[some]] + rank[some])
            arrays = (row, plan.whole_before[left] + wholes, sequence, offset)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in arrays], ["row", "whole", "sequence", "offset"])

    return run


def _ranked(sizes: DataFrame, window: int, salts: int) -> DataFrame:
    """row, left, rank (place among the documents of the same length left), wholes (whole windows of those before it)."""
    salted = sizes.select("row", (F.col("n") % window).alias("left"), F.floor(F.col("n") / window).alias("k"), F.pmod(F.xxhash64("row"), F.lit(salts)).alias("salt"))
    sums = salted.groupBy("left", "salt").agg(F.count(F.lit(1)).alias("c"), F.sum("k").alias("s"))
    up = W.partitionBy("left").orderBy("salt")
    sums = sums.select("left", "salt", (F.sum("c").over(up) - F.col("c")).alias("c0"), (F.sum("s").over(up) - F.col("s")).alias("s0"))
    own = W.partitionBy("left", "salt").orderBy("row")
    inside = salted.select("row", "left", "salt", (F.row_number().over(own) - 1).cast("long").alias("i"), (F.sum("k").over(own) - F.col("k")).alias("ki"))
    return inside.join(sums, ["left", "salt"]).select("row", F.col("left").cast("long").alias("left"), (F.col("i") + F.col("c0")).alias("rank"), (F.col("ki") + F.col("s0")).cast("long").alias("wholes"))


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """A row a piece: doc_id, row, start, length, doc_tokens, sequence_id, offset, ids (little-endian uint32)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", clean_text().alias("text"))
    made = texts.mapInArrow(_token_rows(path or vocabulary_path(), end_id), f"doc_id {id_type}, n long, ids binary")
    tokens = store(made.withColumn("row", F.monotonically_increasing_id()), "tokens").df
    sizes = tokens.select("row", "n")
    left = sizes.groupBy((F.col("n") % window).cast("int").alias("left")).agg(F.count(F.lit(1)).alias("c"), F.sum(F.floor(F.col("n") / window)).alias("s"))
    counts, whole = np.zeros(window, np.int64), np.zeros(window, np.int64)
    for r in left.collect():  # one row a length, window rows at most
        counts[r["left"]], whole[r["left"]] = r["c"], r["s"]
    plan = make_plan(counts, whole, window)
    most = int(counts.max())
    ranked = _ranked(sizes, window, max(1, -(-most // max(SALT_ROWS, math.isqrt(most)))))
    placed = ranked.mapInArrow(_placed(plan), "row long, whole long, sequence long, offset long")
    joined = tokens.join(placed, "row")
    return joined.mapInArrow(_pieces(window), f"doc_id {id_type}, row long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pack(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op1_packing": op1_packing}
ORACLES: dict[str, str] = {}
