"""Quality classifier by positive-unlabelled learning.

A document's features are shares of bytes and words (symbols, capitals, digits, repeats, line and word shapes) and hashed
word shapes; every word of a text counts. A logistic model minimises the non-negative unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

over trusted positives (labelled good) and unlabelled documents. The class prior is estimated first: a plain model of
positives against unlabelled rows is fitted on one half of the sample; among the scores of the other half's positives and
of all documents outside the held-out fold and that half (a histogram), the prior is the smallest ratio of the shares of
documents and of positives above a threshold, with a margin for chance. Labels of bad documents are never used.
``language``, ``source`` and ``doc_id`` are no features.

Features of all whole texts are written once and read by every later step. The gradients use at most ``sample`` positives
and ``sample`` unlabelled rows, chosen by a hash of doc_id, outside the held-out fold: 81 weights need no more, and the
README has the effect of the bound measured. No text is exchanged; memory is one Arrow batch.

Edge cases: null text is empty and gets a score from the constant features; without positives, or without unlabelled
rows, every score is the prior 0.5; rows that repeat a doc_id are scored each by its text; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.llm.common import clean_text, store, table

#: Positives, and unlabelled rows, that the model is fitted on at most.
SAMPLE = 12_000
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
HASHED = 64
_SYMBOLS = np.frombuffer(b"#*$%&|<>@^~_={}[]\\/", np.uint8)
_STOPS = np.frombuffer(b".,;:!?", np.uint8)
_SHAPE = bytes(ord("A") if 65 <= b < 91 else ord("a") if 97 <= b < 123 or b >= 128 else ord("0") if 48 <= b < 58 else b for b in range(256))
_RUNS = np.isin(np.arange(256), np.frombuffer(b"Aa0", np.uint8))
NUMBERS = 16
#: Standard deviations that a feature differs from the mean at most.
CLIP = 8.0
#: Bins of the histogram of all documents' logits, from -LIMIT to LIMIT.
BINS, LIMIT = 4_000, 20.0


def features(text: bytes) -> np.ndarray:
    """NUMBERS shares and HASHED shares of word shapes."""
    out = np.zeros(NUMBERS + HASHED, np.float32)
    found = text.split()
    n = len(found)
    out[0] = min(np.log1p(n), 12) / 12
    out[1] = n < 50
    if not n:
        return out
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = len(text)
    upper, lower = count[65:91].sum(), count[97:123].sum() + count[128:].sum()
    out[2] = upper / max(1, upper + lower)
    out[3] = min(1, 10 * count[_SYMBOLS].sum() / size)
    out[4] = min(1, 10 * count[_STOPS].sum() / size)
    out[5] = count[48:58].sum() / size
    out[6] = min(1, 20 * count[33] / size)
    out[7] = min(1, 20 * count[124] / size)
    out[8] = min(1, (size - n) / n / 20)
    out[9] = len(set(found)) / n
    out[10] = len(set(zip(found, found[1:]))) / max(1, n - 1)  # noqa: B905  the second is shorter
    lines = [x for x in text.split(b"\n") if x.strip()]
    out[11] = len(set(lines)) / max(1, len(lines))
    out[12] = min(1, len(lines) / n * 5)
    shapes: Counter[bytes] = Counter()
    for shape, times in Counter(_shaped(text).split()).items():
        shapes[shape[:6]] += times
    hashed = [0] * HASHED
    for shape, times in shapes.items():
        hashed[_hash(shape) % HASHED] += times
    out[NUMBERS:] = np.array(hashed) / n
    out[13] = 1 - sum(v for s, v in shapes.items() if s[-1:] in b"Aa0.,") / n
    out[14] = out[10] * out[0]
    out[15] = max(map(len, found)) > 60
    return out


def _shaped(text: bytes) -> bytes:
    """The whole text with every letter and digit as its class and each run of a class as one; white space stays."""
    found = np.frombuffer(text.translate(_SHAPE), np.uint8)
    stays = np.ones(len(found), bool)
    stays[1:] = (found[1:] != found[:-1]) | ~_RUNS[found[1:]]
    return found[stays].tobytes()


def _hash(shape: bytes) -> int:
    value = 0
    for b in shape:
        value = (value * 131 + b) & 0xFFFFFFFF
    return value ^ value >> 7


@dataclass
class Model:
    """Weights over standardised features, with the prior they were fitted for."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """The rows as the fit sees them."""
        return np.clip((x - self.mean) / self.scale, -CLIP, CLIP)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x) @ self.weights + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logit(x))


def _descend(gradient, size: int, rounds: int, rate: float = 0.05) -> np.ndarray:
    """Adam from zero."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, rounds + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_risk(p: np.ndarray, u: np.ndarray, prior: float, l2: float = 1e-3, rounds: int = 400) -> np.ndarray:
    """Weights, the bias last, at the least non-negative unbiased risk under the logistic loss."""
    p, u = np.c_[p, np.ones(len(p))], np.c_[u, np.ones(len(u))]

    def gradient(w: np.ndarray) -> np.ndarray:
        zp, zu = p @ w, u @ w
        bad_u, bad_p = np.logaddexp(0, zu).mean(), np.logaddexp(0, zp).mean()
        pull = prior * (p.T @ (_sigmoid(zp) - 1)) / len(p)
        push = (u.T @ _sigmoid(zu)) / len(u) - prior * (p.T @ _sigmoid(zp)) / len(p)
        rest = l2 * np.r_[w[:-1], 0]
        return pull + push + rest if bad_u - prior * bad_p >= 0 else -push + rest

    return _descend(gradient, p.shape[1], rounds)


def prior_above(sp: np.ndarray, cuts: np.ndarray, share_u: np.ndarray, n_u: int, delta: float = 0.1) -> float:
    """The share of positives among ``n_u`` rows of which ``share_u`` score at least each cut, from positives' scores."""
    sp = np.sort(sp)
    share_p = 1 - np.searchsorted(sp, cuts, "left") / len(sp)
    margin = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(n_u) + 1 / np.sqrt(len(sp)))
    ratio = np.where(share_p >= 0.05, (share_u + margin) / np.maximum(share_p, 0.05), np.inf)
    best = int(np.argmin(ratio))
    return float(np.clip(share_u[best] / share_p[best], 0.05, 0.98))


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """As ``prior_above``, from rows in memory: one half of either fits the model, the other half is scored."""
    p0, p1, u0, u1 = p[::2], p[1::2], u[::2], u[1::2]
    if not (len(p1) and len(u1)):
        return 0.5
    w = fit_risk(p0, u0, 0.5, rounds=200)
    sp, su = p1 @ w[:-1], np.sort(u1 @ w[:-1])
    cuts = np.quantile(sp, np.linspace(0, 0.95, 200))
    return prior_above(sp, cuts, 1 - np.searchsorted(su, cuts, "left") / len(su), len(su))


def fit(p: np.ndarray, u: np.ndarray, prior: float | None = None, rounds: int = 400) -> Model:
    width = NUMBERS + HASHED
    if not len(p) or not len(u):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 0.5)
    both = np.concatenate([p, u]).astype(np.float64)
    model = Model(both.mean(axis=0), np.maximum(both.std(axis=0), 0.02), np.zeros(width), 0.0, 0.5)
    p, u = model.scaled(p), model.scaled(u)
    model.prior = estimate_prior(p, u) if prior is None else prior
    w = fit_risk(p, u, model.prior, rounds=rounds)
    model.weights, model.bias = w[:-1], float(w[-1])
    return model


def fold(doc_id: Column | str = "doc_id") -> Column:
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(0))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(x.as_py()).tobytes() for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary())], ["doc_id", "x"])


def _array(column) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), np.float32).reshape(-1, NUMBERS + HASHED)


def vectors(docs: DataFrame) -> DataFrame:
    """doc_id, x: the features of every whole text, in the order of ``features``, as bytes."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", clean_text().cast("binary").alias("text")).mapInArrow(_vectors, f"doc_id {id_type}, x binary")


def training_ids(found: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """id, good: the documents that the gradients use, outside the held-out fold, at most 2 * sample rows."""

    def chosen(rows: DataFrame) -> DataFrame:
        ids = rows.filter(F.col("doc_id").isNotNull() & (fold() != HELD_OUT)).select("doc_id").distinct()
        return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    good = chosen(labels.filter("quality = 1")).withColumn("good", F.lit(True))
    both = good.unionByName(chosen(found).withColumn("good", F.lit(False)))
    return store(both.select(F.col("doc_id").alias("id"), "good"), "sample").df


def training_rows(found: DataFrame, ids: DataFrame) -> tuple[np.ndarray, np.ndarray, list]:
    """Features of positives and of unlabelled rows, and the unlabelled rows' ids. The chosen ids are broadcast."""
    rows = found.join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select("good", "doc_id", "x").toArrow()  # 2 * sample rows and their repeats
    rows = rows.sort_by([("doc_id", "ascending"), ("x", "ascending")])
    good = np.array(rows["good"].to_pylist(), bool)
    x = _array(rows["x"])
    return x[good], x[~good], [i for i, flag in zip(rows["doc_id"].to_pylist(), good, strict=True) if not flag]


def _histogram(found: DataFrame, model: Model, left_out: list) -> np.ndarray:
    """Documents outside the held-out fold by bin of their logit, but for those left out."""

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.clip((model.logit(_array(batch.column("x"))) + LIMIT) / (2 * LIMIT) * BINS, 0, BINS - 1).astype(int)
            bins, counts = np.unique(z, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int32()), pa.array(counts, pa.int64())], ["bin", "n"])

    ids = found.sparkSession.createDataFrame([(i,) for i in left_out], found.select(F.col("doc_id").alias("id")).schema)
    rest = found.filter(fold() != HELD_OUT).join(F.broadcast(ids), F.col("doc_id") == F.col("id"), "left_anti")
    out = np.zeros(BINS, np.int64)
    for r in rest.select("x").mapInArrow(binned, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        out[r["bin"]] = r["n"]
    return out


def learn(found: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """From the table of ``vectors``: the prior over all documents, then the weights."""
    p, u, ids = training_rows(found, training_ids(found, labels, sample))
    if len(p) < 2 or len(u) < 2:
        return fit(p, u, 0.5)
    ranking = fit(p[::2], u[::2], 0.5, rounds=200)
    counts = _histogram(found, ranking, ids[::2])
    if not counts.sum():
        return fit(p, u, 0.5)
    edges = np.linspace(-LIMIT, LIMIT, BINS + 1)[:-1]
    share_u = counts[::-1].cumsum()[::-1] / counts.sum()
    return fit(p, u, prior_above(ranking.logit(p[1::2]), edges, share_u, int(counts.sum())))


def score(found: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, from the table of ``vectors``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_array(batch.column("x"))))], ["doc_id", "score"])

    id_type = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {id_type}, score double")


def op2_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = store(vectors(table(spark, sf_dir, "documents")), "vectors").df
    scored = score(found, learn(found, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold() == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op2_pu_quality": op2_pu_quality}
ORACLES: dict[str, str] = {}
