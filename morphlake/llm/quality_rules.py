"""Quality rules: counts of words, symbols and repeats, and a hashed n-gram log-likelihood ratio.

Every word and every pair of neighbouring words is hashed into features, as many as ``buckets_for`` the trusted documents. Two multinomials over them, one of
documents under trust (labelled as good) and one of the whole raw corpus, give each feature a log ratio; a document's
score is the sum over its features divided by their number, and it is kept if it passes the base rules and its score
reaches ``least``. The threshold is a constant, so a document's verdict depends on no sampling.

Counts cover every word of every document and are added up before their exchange, at most a row a bucket and task. The
fitted table has a number a bucket, at most MOST_BUCKETS whatever the corpus. Scores need no exchange at all. Labels are broadcast while they
are few (their number is checked) and joined by an exchange of texts beyond that.

Edge cases: a null text has no words, all counts zero and fails the base rules; without labels, or if none of them is
good, every ratio is zero and the base rules decide; several labels of a document count as good if one is; rows that
repeat a doc_id are judged each by its text; an empty table gives an empty result; other columns pass through ``judge``,
whatever their names, except those it makes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.llm.common import SPACE, clean_text, free, let, table, words

#: Buckets of a small corpus and of the largest, and trusted documents a bucket between them.
BUCKETS, MOST_BUCKETS, DOCS_A_BUCKET = 1 << 16, 1 << 20, 4
LEAST = -0.1
SMOOTHING = 15.0
STEP = 1 / 32
#: Ids of good documents (8 bytes each) that are broadcast at most.
BROADCAST_IDS = 1_000_000
SYMBOLS = "[#*$%&|<>]"


def _hashes(found: Column) -> Column:
    return F.transform(found, lambda w: F.xxhash64(w))


def _pairs(hashes: Column) -> Column:
    """Hashes of neighbouring words' hashes."""
    after = F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0)))
    return F.zip_with(F.slice(hashes, 1, F.size(after)), after, lambda a, b: F.xxhash64(a, b))


def buckets_for(trusted: int) -> int:
    """A power of two that grows with the number of trusted documents, since only what they hold tells features apart."""
    return min(MOST_BUCKETS, max(BUCKETS, 1 << max(0, trusted // DOCS_A_BUCKET - 1).bit_length()))


def _bucket(hashed: Column, pair: bool, buckets: int) -> Column:
    """Words fall into the lower half of the buckets, pairs into the upper half."""
    half = buckets // 2
    return hashed.bitwiseAND(F.lit(half - 1)).cast("int") + (half if pair else 0)


def good_ids(labels: DataFrame) -> DataFrame:
    return labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("good_id")).distinct()


def fit(docs: DataFrame, labels: DataFrame, buckets: int | None = None) -> list[int]:
    """log p(feature | trusted) - log p(feature | raw) for every bucket, in whole steps of ``STEP``.

    Both shares are smoothed by the same pseudo-count on the scale of trusted counts, so what a small corpus shows once or
    twice says nothing, and what it shows often says as much as in a large one. Whole steps make a document's sum exact
    in any order and the table small enough to stay in a core's cache.
    """
    good = good_ids(labels)
    known = good.count()
    buckets = buckets or buckets_for(known)
    good = F.broadcast(good) if known <= BROADCAST_IDS else good
    hashed = docs.select("doc_id", clean_text().alias("text")).join(good, F.col("doc_id") == F.col("good_id"), "left")
    hashed = hashed.select(F.col("good_id").isNotNull().alias("good"), _hashes(words(F.col("text"))).alias("h"))
    paired = hashed.select("good", "h", _pairs(F.col("h")).alias("p"))
    features = F.concat(F.transform("h", lambda h: _bucket(h, False, buckets)), F.transform("p", lambda h: _bucket(h, True, buckets)))
    exploded = paired.select("good", F.explode(features).alias("bucket"))
    counts = exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count(F.when(F.col("good"), 1)).alias("trusted"))
    found = {r["bucket"]: (r["trusted"], r["raw"]) for r in counts.collect()}
    out = [0] * buckets
    for half in (range(buckets // 2), range(buckets // 2, buckets)):
        trusted, raw = (sum(found.get(b, (0, 0))[k] for b in half) for k in (0, 1))
        for b in half if trusted else ():
            t, r = found.get(b, (0, 0))
            ratio = math.log((t + SMOOTHING) / (r * trusted / raw + SMOOTHING))
            out[b] = max(-127, min(127, round(ratio / STEP)))
    return out


def _windows(hashes: Column, pairs: Column) -> Column:
    """Hashes (64 bits) of the three-word windows, from those of the pairs and of the words behind them."""
    n = F.greatest(F.size(hashes) - 2, F.lit(0))
    return F.zip_with(F.slice(pairs, 1, n), F.slice(hashes, 3, n), lambda p, h: F.xxhash64(p, h))


def _covered(windows: Column) -> Column:
    """Words inside windows that occur twice or more: windows sorted by hash, those with an equal neighbour, their words."""

    def hits(keyed: Column) -> Column:
        n = F.size(keyed)
        none = F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(None).cast("int").alias("i"))
        before = F.concat(F.array(none), F.slice(keyed, 1, n - 1))
        after = F.concat(F.slice(keyed, 2, n - 1), F.array(none))
        zipped = F.arrays_zip(keyed.alias("k"), before.alias("b"), after.alias("a"))
        same = F.filter(zipped, lambda z: F.coalesce(z["k"]["h"] == z["b"]["h"], F.lit(False)) | F.coalesce(z["k"]["h"] == z["a"]["h"], F.lit(False)))
        return F.sort_array(F.transform(same, lambda z: z["k"]["i"]))

    def words_at(at: Column) -> Column:
        gaps = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: F.least(b - a, F.lit(3)))
        return F.aggregate(gaps, F.lit(3), lambda total, g: total + g)

    keyed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(keyed, hits), words_at)


def judge(docs: DataFrame, model: list[int], least: float = LEAST) -> DataFrame:
    """The documents with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed and kept."""
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept")
    own = [c for c in docs.columns if c not in made]
    found_words, hashes, pairs, windows = free([*docs.columns, *made], "words", "hashes", "pairs", "windows")
    text = clean_text()
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.regexp_like(x, F.lit(f"[^{SPACE}]")))
    counted = docs.select(
        *[docs[c] for c in own],
        words(text).alias(found_words),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.when(F.contains(text, F.lit("\n")), F.size(lines) - F.size(F.array_distinct(lines))).otherwise(0).cast("long").alias("n_dup_lines"),
    )
    kept = [*own, "n_symbols", "n_dup_lines"]
    hashed = counted.select(*kept, F.size(found_words).cast("long").alias("n_words"), F.length(F.array_join(found_words, "")).cast("long").alias("word_chars"), _hashes(F.col(found_words)).alias(hashes))
    kept += ["n_words", "word_chars"]
    paired = hashed.select(*kept, hashes, _pairs(F.col(hashes)).alias(pairs))
    weights = F.split(F.lit(",".join(map(str, model))), ",").cast("array<tinyint>")  # folded to a constant

    def steps(hashed: str, pair: bool) -> Column:
        return F.aggregate(hashed, F.lit(0), lambda total, h: total + F.get(weights, _bucket(h, pair, len(model))))

    features = F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    scored = paired.select(*kept, ((steps(hashes, False) + steps(pairs, True)) * STEP / features).alias("score"), _windows(F.col(hashes), F.col(pairs)).alias(windows))
    repeated = F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(_covered(F.col(windows))).cast("long")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found = scored.withColumn("n_repeat_words", repeated).drop(windows).withColumn("base_failed", failed)
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least))


def keep(docs: DataFrame, model: list[int], least: float = LEAST) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns, whatever their names.

    The number that the filter reads as well cannot be computed twice, and so Spark computes the verdict once: a filter on
    the verdict alone would be moved below the columns it is made of and repeat them.
    """
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("whole_row"))
    judged = judge(rows, model, least).select("whole_row", "kept", F.monotonically_increasing_id().alias("no"))
    return judged.filter(F.col("kept") & (F.col("no") >= 0)).select("whole_row.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = judge(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


QUERIES = {"op3_quality_rules": op3_quality_rules}
ORACLES: dict[str, str] = {}
