"""Mixing to target weights: token weights are raked to source, language and topic marginals, documents are sampled.

Tokens are counted over cells (source, language, topic). Iterative proportional fitting scales the cells to each target
marginal in turn until all three hold. A cell's fitted tokens over its own are its documents' relative weight; a factor
common to all cells turns weights into probabilities, cut at one, that keep ``keep`` of all tokens on average. A document
stays if a hash of its id, read as a number from 0 to 1, is below its probability, so a run can be repeated.

Targets are shares by value, or an exponent that tempers the corpus's own shares (below one raises rare values). A value
that targets do not name gets no tokens; one that the corpus lacks is left out and the rest scaled up. Marginals that the
corpus's cells cannot meet together (a topic of one language only) are met in turn: the topic's last, so exactly.

Topics are clusters of what a document's words have beyond its language: words of six or more bytes are counted in
``WIDTH`` hashed classes, the square roots of the language's expected counts are taken off those of the document's, and
spherical k-means over all documents, a fixed number of rounds from starts that depend on sums alone, finds ``TOPICS`` directions. Vectors
and directions are whole numbers, so sums and products are exact in any order and every pass gives a document the same
topic.

The driver holds a row a cell (about 300 bytes each), never a row a document. Documents meet their cell's row by a
broadcast while cells are few, else by an exchange that Spark splits where a cell is hot. ``mix`` counts a text's words a
second time: a tenth of all ids go, and sending texts to meet them would cost more than the counting.

Edge cases: null text has no tokens; a text without long words has topic -1; a null source or language is a value of its
own; documents without tokens take their cell's weight, and a cell without tokens has weight zero; a document whose cell
is missing stays; rows that repeat a doc_id share its fate where their cells agree; an empty table gives an empty result;
other columns pass through ``mix``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from morphlake.llm.common import clean_text, free, store, table, trim

TOPICS, WIDTH, LANGUAGES, ROUNDS = 8, 256, 64, 8
#: Directions of the first three rounds, of which the topics are picked.
STARTS = 32
LONG_WORD = 6
#: Length of the vectors that topics are made of.
SCALE = 1 << 14
TEMPER = 0.8
KEEP = 0.9
#: Cells that are broadcast, and cells that the driver fits, at most; more than those it refuses.
BROADCAST_CELLS, MOST_CELLS = 100_000, 500_000
DIMENSIONS = ("source", "lang", "topic")


@dataclass(frozen=True)
class Targets:
    """For each dimension shares by value, or an exponent over the corpus's own shares."""

    source: dict | float = TEMPER
    lang: dict | float = TEMPER
    topic: dict | float = TEMPER
    keep: float = KEEP
    seed: int = field(default=7)


def _counts(text: bytes) -> tuple[int, np.ndarray]:
    found = text.split()
    codes = np.array([crc32(w) for w in found if len(w) >= LONG_WORD], np.uint32)
    return len(found), np.bincount(codes % WIDTH, minlength=WIDTH).astype(np.int32)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_counts(x.as_py()) for x in batch.column("text")]
        made = [pa.array([n for n, _ in rows], pa.int64()), pa.array([c.tobytes() for _, c in rows], pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "source", "lang")] + made, ["doc_id", "source", "lang", "tokens", "counts"])
        trim()


def count_words(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, tokens (words), counts (of long words by class, as bytes)."""
    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", "source", "lang")}
    schema = ", ".join(f"{c} {kind}" for c, kind in kinds.items()) + ", tokens long, counts binary"
    return docs.select(*kinds, clean_text().cast("binary").alias("text")).mapInArrow(_counted, schema)


def _group(lang) -> int:
    return crc32(b"\0" if lang is None else str(lang).encode()) % LANGUAGES


def _matrix(counts) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in counts), np.int32).reshape(-1, WIDTH)


def _groups(langs) -> np.ndarray:
    coded = langs.dictionary_encode() if isinstance(langs, pa.Array) else langs
    known = np.array([_group(x) for x in coded.dictionary.to_pylist()] + [_group(None)])
    return known[np.nan_to_num(coded.indices.to_numpy(zero_copy_only=False), nan=len(known) - 1).astype(int)]


def _summed(counted: DataFrame, add) -> np.ndarray:
    """Sums of the matrices that ``add`` makes of each batch; a row a number that is not zero goes through one exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = add(batch)
            i, j = np.nonzero(made)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(made[i, j], pa.int64())], ["i", "j", "n"])

    out = np.zeros((WIDTH, WIDTH), np.int64)
    for r in counted.select("lang", "counts").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        out[r["i"], r["j"]] = r["n"]
    return out


@dataclass(frozen=True)
class Topics:
    """``shares`` of word classes by language, and the directions of the topics."""

    shares: np.ndarray
    directions: np.ndarray

    def vectors(self, counts: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """What the counts have beyond their language's, as whole numbers of length SCALE."""
        expected = counts.sum(axis=1, keepdims=True) * self.shares[groups]
        return _scaled(np.sqrt(counts) - np.sqrt(expected))

    def of(self, counts: np.ndarray, groups: np.ndarray) -> np.ndarray:
        near = self.vectors(counts, groups) @ self.directions.T
        return np.where(counts.any(axis=1), near.argmax(axis=1), -1).astype(np.int32)


def _scaled(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.rint(x / np.maximum(length, 1e-9) * SCALE).astype(np.int64)


def _picked(sums: np.ndarray, count: int) -> np.ndarray:
    """Directions of the longest sum and then, one by one, of the sums that are long and far from those taken."""
    length = np.sqrt((sums.astype(float) ** 2).sum(axis=1))
    scaled, out, near = _scaled(sums.astype(float)), [], np.zeros(len(sums))
    for _ in range(count):
        out.append(scaled[int(np.argmax(length * (1 - near)))])
        near = np.maximum(near, scaled @ out[-1] / SCALE**2)
    return np.array(out)


def fit_topics(counted: DataFrame, rounds: int = ROUNDS) -> Topics:
    """From the stored table of ``count_words``: a pass for the languages' shares, one for the starts and one a round, of which
    there are at least three."""

    def by_language(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((LANGUAGES, WIDTH), np.int64)
        np.add.at(out, _groups(batch.column("lang")), _matrix(batch.column("counts")))
        return out

    sums = _summed(counted, by_language)[:LANGUAGES]
    shares = sums / np.maximum(sums.sum(axis=1, keepdims=True), 1)
    topics = Topics(shares, np.zeros((TOPICS, WIDTH), np.int64))

    def by_class(batch: pa.RecordBatch, now: Topics = topics) -> np.ndarray:
        counts, out = _matrix(batch.column("counts")), np.zeros((WIDTH, WIDTH), np.int64)
        made = now.vectors(counts, _groups(batch.column("lang")))
        np.add.at(out, made.argmax(axis=1), made)
        return out

    topics = Topics(shares, _picked(_summed(counted, by_class), STARTS))
    for at in range(rounds):

        def by_topic(batch: pa.RecordBatch, now: Topics = topics) -> np.ndarray:
            counts, groups = _matrix(batch.column("counts")), _groups(batch.column("lang"))
            own, out = now.of(counts, groups), np.zeros((len(now.directions), WIDTH), np.int64)
            np.add.at(out, own[own >= 0], now.vectors(counts, groups)[own >= 0])
            return out

        sums = _summed(counted, by_topic)[: len(topics.directions)]
        if at == 2:
            moved = _picked(sums, TOPICS)
        else:
            moved = np.where(sums.any(axis=1, keepdims=True), _scaled(sums.astype(float)), topics.directions)
            if at > 2 and (moved == topics.directions).all():
                break
        topics = Topics(shares, moved)
    return topics


def assign(counted: DataFrame, topics: Topics) -> DataFrame:
    """doc_id, source, lang, topic, tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = topics.of(_matrix(batch.column("counts")), _groups(batch.column("lang")))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "source", "lang")], pa.array(own), batch.column("tokens")], ["doc_id", "source", "lang", "topic", "tokens"])

    kinds = [counted.schema[c] for c in ("doc_id", "source", "lang")]
    return counted.mapInArrow(run, T.StructType([*kinds, T.StructField("topic", T.IntegerType()), T.StructField("tokens", T.LongType())]))


def rake(cells: list[tuple], tokens: np.ndarray, targets: Targets, rounds: int = 200, tolerance: float = 1e-10) -> np.ndarray:
    """Fitted tokens of each cell, in all as many as there are. Cells without tokens stay without."""
    fitted, total = tokens.astype(np.float64).copy(), float(tokens.sum())
    margins = []
    for d, name in enumerate(DIMENSIONS):
        values = sorted({c[d] for c in cells}, key=lambda v: (v is None, str(v)))
        index = {v: i for i, v in enumerate(values)}
        code = np.array([index[c[d]] for c in cells], np.int64)
        own = np.bincount(code, tokens, minlength=len(values))
        wanted = getattr(targets, name)
        share = np.array([max(0.0, wanted.get(v, 0.0)) for v in values]) if isinstance(wanted, dict) else np.where(own > 0, own, 0.0) ** wanted * (own > 0)
        share = np.where(own > 0, share, 0.0)
        if share.sum() > 0:
            margins.append((code, share / share.sum() * total))
    for _ in range(rounds):
        moved = 0.0
        for code, goal in margins:
            have = np.bincount(code, fitted, minlength=len(goal))
            factor = np.divide(goal, have, out=np.zeros_like(goal), where=have > 0)
            moved = max(moved, float(np.abs(factor[have > 0] - 1).max(initial=0.0)))
            fitted *= factor[code]
        if moved < tolerance:
            break
    return fitted


def probabilities(tokens: np.ndarray, fitted: np.ndarray, keep: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and probabilities min(1, factor * weight) that keep that share of all tokens on average."""
    weight = np.divide(fitted, tokens, out=np.zeros(len(tokens)), where=tokens > 0)
    if not weight.any():
        return weight, weight
    low, high, goal = 0.0, 1 / weight[weight > 0].min(), keep * tokens.sum()
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if (np.minimum(1, middle * weight) * tokens).sum() < goal else (low, middle)
    return weight, np.minimum(1, high * weight)


_CELL = ("cell_source", "cell_lang", "cell_topic", "weight", "probability")


def fit_cells(assigned: DataFrame, targets: Targets, names: list[str] | tuple[str, ...] = _CELL) -> DataFrame:
    """A row a cell: source, language, topic, weight and probability, under these names."""
    spark = assigned.sparkSession
    sums = assigned.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))
    found = sums.limit(MOST_CELLS + 1).collect()
    if len(found) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells of source, language and topic; give a coarser source column")
    found.sort(key=lambda r: tuple(str(r[d]) for d in DIMENSIONS))
    tokens = np.array([r["tokens"] for r in found], np.float64)
    cells = [tuple(r[d] for d in DIMENSIONS) for r in found]
    weight, chance = probabilities(tokens, rake(cells, tokens, targets) if len(cells) else tokens, targets.keep)
    rows = [(*c, float(w), float(p)) for c, w, p in zip(cells, weight, chance, strict=True)]
    kinds = [sums.schema[d].dataType for d in DIMENSIONS] + [T.DoubleType()] * 2
    made = spark.createDataFrame(rows, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))
    return F.broadcast(made) if len(rows) <= BROADCAST_CELLS else made


def _sampled(rows: DataFrame, cells: DataFrame, topic: str, names: list[str] | tuple[str, ...], seed: int) -> tuple[DataFrame, Column]:
    """Rows with their cell's columns, and whether a row stays."""
    same = F.col("source").eqNullSafe(F.col(names[0])) & F.col("lang").eqNullSafe(F.col(names[1])) & (F.col(topic) == F.col(names[2]))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) / F.lit(float(1 << 53))
    return rows.join(cells, same, "left"), draw < F.coalesce(names[4], F.lit(1.0))


def weigh(docs: DataFrame, targets: Targets = Targets()) -> DataFrame:  # noqa: B008  frozen
    """doc_id, source, lang, topic, tokens, weight, probability, kept."""
    counted = store(count_words(docs), "counted")
    assigned = store(assign(counted.df, fit_topics(counted.df)), "assigned").df
    counted.drop()
    found, kept = _sampled(assigned, fit_cells(assigned, targets), "topic", _CELL, targets.seed)
    return found.select("doc_id", "source", "lang", "topic", "tokens", "weight", "probability", kept.alias("kept"))


def mix(docs: DataFrame, targets: Targets = Targets()) -> DataFrame:  # noqa: B008  frozen
    """The documents that stay, with all their columns; texts are read twice and never exchanged."""
    counted = store(count_words(docs), "counted")
    topics = fit_topics(counted.df)
    columns = docs.columns
    own, *names = free(columns, "own_topic", *_CELL)
    cells = fit_cells(assign(counted.df, topics), targets, names)
    counted.drop()
    at, lang = columns.index("text"), columns.index("lang")

    def add_topics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.array([_counts((x.as_py() or "").encode())[1] for x in batch.column(at)], np.int32).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(topics.of(counts, _groups(batch.column(lang))))], [*batch.schema.names, own])
            trim()

    schema = T.StructType([*docs.schema.fields, T.StructField(own, T.IntegerType())])
    found, kept = _sampled(docs.mapInArrow(add_topics, schema), cells, own, names, targets.seed)
    return found.filter(kept).select(*columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weigh(table(spark, sf_dir, "documents"))


QUERIES = {"op7_mixing": op7_mixing}
ORACLES: dict[str, str] = {}
