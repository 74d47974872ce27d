"""Exact deduplication of an incoming batch against immutable snapshots.

A snapshot is a set of written tables: one row a distinct text (64-bit digest, SHA-256, best row, number of rows), dealt
into buckets by digest, and a static binary-fuse filter a bucket. A batch is grouped on its own first; only then are its
distinct digests screened by the filters, a bucket at a time; where the batch outgrows the snapshot, a bucket's digests
are dealt over salts, each with a copy of the filter. What the filters reject is new; the rest joins the exact buckets. Whatever then has two rows or more goes to a check of bytes: every row's normalised text against that of the
row that stays. Rows that fail it (a collision of digests) are regrouped by the text itself.

Texts are equal when identical after deleting every ASCII white-space character. Of equal texts the row with the most
code points in its original text stays, then the smallest doc_id.

Only narrow digest rows are shuffled for grouping and screening; texts move for rows of groups alone, and a group's rows
are dealt over as many salts as its size asks for, each with one copy of the text that stays. Rows of classes beyond
``HOT`` such salts meet their class under salts too. Tables that the result does not read are removed on the way.

Edge cases: null counts as empty, and empty texts equal each other; a null doc_id sorts last among equals; rows that
repeat a doc_id are rows of their own, and of rows that repeat the one that stays only one is kept; empty tables give
empty results; other columns are kept by ``keep_one`` and ignored by ``groups``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from morphlake.llm import fuse_filter
from morphlake.llm.common import SPACE, Stored, clean_text, free, small, store, table

#: Distinct digests a bucket aims at, and rows of one group that share a copy of its text.
BUCKET_KEYS = 50_000
SALT_ROWS = 2_048
#: Digests of a batch that one task screens on average at most, and salts' worth of rows that make a class hot.
BATCH_ROWS = 200_000
HOT = 32


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE}]+", "")


def xxh64(norm: Column) -> Column:
    return F.xxhash64(norm)


def sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


@dataclass(frozen=True)
class Digests:
    """What names a normalised text: a 64-bit key for filters and buckets, and a wider one for the exact join."""

    key: Callable[[Column], Column] = xxh64
    wide: Callable[[Column], Column] = sha256

    def rows(self, docs: DataFrame) -> DataFrame:
        """doc_id, n (code points of the original text), digest, sha."""
        return (
            docs.select("doc_id", clean_text().alias("text"))
            .select("doc_id", F.length("text").cast("long").alias("n"), normalised(F.col("text")).alias("norm"))
            .select("doc_id", "n", self.key(F.col("norm")).alias("digest"), self.wide(F.col("norm")).alias("sha"))
        )


def _best() -> Column:
    """Orders rows of a group: the greatest one stays."""
    return F.struct(F.col("n"), F.col("doc_id").isNotNull().alias("known"), F.bitwise_not("doc_id").alias("id"))


def _classes(rows: DataFrame) -> DataFrame:
    """A row a text; partial sums come before the exchange, so a hot text is no hot key."""
    return rows.groupBy("digest", "sha").agg(F.max(_best()).alias("best"), F.count(F.lit(1)).alias("size"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.shiftrightunsigned("digest", 17), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Snapshot:
    """Written once and never changed; ``classes`` holds digest, sha, best and size, ``filters`` bucket and made."""

    classes: Stored
    filters: Stored
    buckets: int

    def drop(self) -> None:
        self.classes.drop()
        self.filters.drop()


def build_snapshot(rows: DataFrame, bucket_keys: int = BUCKET_KEYS) -> Snapshot:
    """From digest rows; the number of buckets follows the number of distinct texts, so a bucket's size does not."""

    def made(own: pa.Table) -> pa.Table:
        one = [own.column("bucket")[:1].combine_chunks(), pa.array([fuse_filter.build(own.column("digest").to_numpy())], pa.binary())]
        return pa.Table.from_arrays(one, ["bucket", "made"])

    distinct = store(_classes(rows), "snapshot")
    buckets = max(1, -(-distinct.df.count() // bucket_keys))
    keys = distinct.df.select(_bucket(buckets).alias("bucket"), "digest")
    return Snapshot(distinct, store(keys.groupBy("bucket").applyInArrow(made, "bucket int, made binary"), "filters"), buckets)


def _salts(classes: DataFrame, snapshot: Snapshot, batch_rows: int) -> int:
    """As many as keep the batch's rows of a bucket and salt near ``batch_rows``."""
    return max(1, -(-classes.count() // (snapshot.buckets * batch_rows)))


def _dealt(classes: DataFrame, snapshot: Snapshot, salts: int) -> DataFrame:
    return classes.withColumn("bucket", _bucket(snapshot.buckets)).withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(salts)).cast("int"))


def screen(classes: DataFrame, snapshot: Snapshot, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """The batch's texts with ``maybe``: false where the filter of their bucket proves that the snapshot lacks them."""

    def probed(left: pa.Table, right: pa.Table) -> pa.Table:
        found = np.zeros(left.num_rows, bool)
        if left.num_rows and right.num_rows:
            found = fuse_filter.probe(right.column("made")[0].as_py(), left.column("digest").to_numpy())
        return left.drop_columns(["bucket", "salt"]).append_column("maybe", pa.array(found, pa.bool_()))

    salts = _salts(classes, snapshot, batch_rows)
    dealt = _dealt(classes, snapshot, salts)
    filters = snapshot.filters.df.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "made")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema) + ", maybe boolean"
    return dealt.groupBy("bucket", "salt").cogroup(filters.groupBy("bucket", "salt")).applyInArrow(probed, schema)


def merge(screened: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Texts of the screened batch and of the snapshot, each once. Only texts that the filters let pass meet the exact buckets."""
    new, maybe = screened.filter("not maybe").drop("maybe"), screened.filter("maybe").drop("maybe")
    old = snapshot.classes.df.select("digest", "sha", F.col("best").alias("old_best"), F.col("size").alias("old_size"))
    met = maybe.join(old, ["digest", "sha"], "full_outer")
    size = F.coalesce("size", F.lit(0)) + F.coalesce("old_size", F.lit(0))
    return new.unionByName(met.select("digest", "sha", F.greatest("best", "old_best").alias("best"), size.alias("size")))


def _tagged(rows: DataFrame, classes: DataFrame, hot_rows: int) -> DataFrame:
    """Every row with its class's size and keep_id. Rows of hot classes, of which there are few, meet it under salts."""
    named = classes.select("digest", "sha", "size", _id_of().alias("keep_id"), F.ceil(F.col("size") / hot_rows).cast("int").alias("salts"))
    hot = store(named.filter("salts > 1").select(F.col("digest").alias("d"), F.col("sha").alias("s"), "salts"), "hot").df
    if not hot.limit(1).count():
        return rows.join(named.drop("salts"), ["digest", "sha"])
    marked = rows.join(small(hot, 80), (F.col("digest") == F.col("d")) & (F.col("sha") == F.col("s")), "left")
    dealt = marked.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id", "n"), F.col("salts")), F.lit(0)).cast("int")).drop("d", "s", "salts")
    return dealt.join(named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts"), ["digest", "sha", "salt"]).drop("salt")


def _id_of(best: str = "best") -> Column:
    return F.bitwise_not(F.col(f"{best}.id"))


def _checked(docs: DataFrame, tagged: DataFrame, names: Digests, salt_rows: int) -> DataFrame:
    """A stored table of the rows of groups after the check of bytes: doc_id, n, digest, sha, keep_id, size, and the text
    where it differs."""
    members = store(tagged.filter("size > 1").select(F.col("doc_id").alias("id"), "digest", "sha", "size", "keep_id").distinct(), "members")
    texts = docs.select("doc_id", clean_text().alias("text")).join(small(members.df, 160), F.col("doc_id").eqNullSafe(F.col("id")))
    texts = texts.select("doc_id", F.length("text").cast("long").alias("n"), normalised(F.col("text")).alias("norm"), "digest", "sha", "size", "keep_id")
    texts = store(texts.filter((names.key(F.col("norm")) == F.col("digest")) & (names.wide(F.col("norm")) == F.col("sha"))), "grouped")
    salts = F.ceil(F.col("size") / F.lit(salt_rows)).cast("int")
    stays = texts.df.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest", "sha", "size").agg(F.min("norm").alias("kept_norm"))
    stays = stays.select("digest", "sha", "kept_norm", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    dealt = texts.df.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n"), salts).cast("int"))
    other = F.when(F.col("norm") != F.col("kept_norm"), F.col("norm"))
    out = store(dealt.join(stays, ["digest", "sha", "salt"]).select("doc_id", "n", "digest", "sha", "keep_id", "size", other.alias("other")), "checked").df
    members.drop()
    texts.drop()
    return out


def _regrouped(checked: DataFrame) -> DataFrame:
    """For colliding digests: groups by the text itself."""
    own = checked.groupBy("digest", "sha", "other").agg(F.max(_best()).alias("best"), F.count(F.lit(1)).alias("size"))
    own = own.select(F.col("digest").alias("d"), F.col("sha").alias("s"), F.col("other").alias("o"), F.col("size"), _id_of().alias("keep_id"))
    same = (F.col("digest") == F.col("d")) & (F.col("sha") == F.col("s")) & F.col("other").eqNullSafe(F.col("o"))
    return checked.drop("size", "keep_id").join(own, same).drop("d", "s", "o")


def groups(docs: DataFrame, incoming: Column | None = None, names: Digests | None = None, salt_rows: int = SALT_ROWS, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept, sha for every row.

    ``incoming`` marks the rows of the new batch; the others form the snapshot. Default: half of the ids, by hash.
    """
    names = names or Digests()
    new = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1 if incoming is None else incoming
    rows = store(names.rows(docs).withColumn("incoming", F.coalesce(new, F.lit(True))), "digests")
    snapshot = build_snapshot(rows.df.filter("not incoming"))
    batch = store(_classes(rows.df.filter("incoming")), "batch")
    screened = store(screen(batch.df, snapshot, batch_rows), "screened")
    classes = store(merge(screened.df, snapshot), "classes")
    tagged = store(_tagged(rows.df, classes.df, HOT * salt_rows), "tagged").df
    for done in (rows, snapshot, batch, screened, classes):
        done.drop()
    checked = _checked(docs, tagged, names, salt_rows)
    if checked.filter("other is not null").limit(1).count():
        checked = _regrouped(checked)
    lone = tagged.filter("size = 1").select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    turn = F.row_number().over(W.partitionBy("digest", "sha", "other", "doc_id").orderBy(F.desc("n")))
    kept = checked.filter(stays).withColumn("kept", turn == 1).unionByName(checked.filter(~stays).withColumn("kept", F.lit(False)))
    return lone.unionByName(kept.select("doc_id", "digest", "keep_id", F.col("size").alias("group_size"), "kept", "sha"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows that stay, with all their columns."""
    found = store(groups(docs, **options).select("doc_id", "digest", "kept"), "kept")
    names = options.get("names") or Digests()
    odd_id, odd_digest, flag = free(docs.columns, "odd_id", "odd_digest", "stays")
    keys = found.df.groupBy("doc_id", "digest").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("times"))
    odd = store(keys.filter("not kept or times > 1").select(F.col("doc_id").alias(odd_id), F.col("digest").alias(odd_digest), F.col("kept").alias(flag)), "odd").df
    found.drop()
    same = F.col("doc_id").eqNullSafe(F.col(odd_id)) & (names.key(normalised(clean_text())) == F.col(odd_digest))
    rest = docs.join(small(odd.drop(flag), 80), same, "left_anti")
    if not odd.filter(flag).limit(1).count():
        return rest
    return rest.unionByName(docs.join(odd.filter(flag).drop(flag), same, "left_semi").dropDuplicates(["doc_id"]))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


_OP9_SQL = r"""
with d as (select doc_id, length(coalesce(text, '')) n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) text_sha256,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') norm from documents),
g as (select *, first_value(doc_id) over (partition by norm order by n desc, doc_id) keep_id, count(*) over (partition by norm) group_size from d)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from g
"""

QUERIES = {"op9_exact_dedup": op9_exact_dedup}
ORACLES = {"op9_exact_dedup": _OP9_SQL}
