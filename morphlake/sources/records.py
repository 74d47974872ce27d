"""Pairs of files of zero-padded fixed-size records: one with keys, one with values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = 32


def slot(text: Column, size: int = RECORD) -> Column:
    """The first bytes, zero-padded to the size."""
    return F.substring(F.concat(F.encode(text, "UTF-8"), F.lit(bytes(size))), 1, size)


def unslot(record: Column) -> Column:
    """The text before the first zero byte. Bytes are walked in hexadecimal, so cut letters do no harm."""
    return F.unhex(F.regexp_extract(F.hex(record), "^((?:(?!00)..)*)", 1)).cast("string")


def _records(spark: SparkSession, path: str, size: int) -> tuple[DataFrame, int]:
    found = spark.read.format("binaryFile").load(path).select("content", "length")
    lengths = [r["length"] for r in found.select("length").collect()]
    if len(lengths) != 1 or lengths[0] % size:
        raise ValueError(f"{path}: expected one file of whole {size}-byte records, found lengths {lengths}")
    count = lengths[0] // size
    rows = found.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.substring("content", i * size + 1, F.lit(size)))).alias("at", "record")) if count else found.select(F.lit(0).alias("at"), F.col("content").alias("record")).limit(0)
    return rows, count


def read_record_pairs(spark: SparkSession, keys: str, values: str, size: int = RECORD) -> DataFrame:
    """at, key, lemma. A missing file, a length that is no multiple of the size or differing lengths raise."""
    left, n = _records(spark, keys, size)
    right, m = _records(spark, values, size)
    if n != m:
        raise ValueError(f"{keys} and {values} hold {n} and {m} records")
    return left.select("at", unslot(F.col("record")).alias("key")).join(right.select("at", unslot(F.col("record")).alias("lemma")), "at")


def pack_records(rows: DataFrame, column: str, order: str, size: int = RECORD) -> bytes:
    """All records of a column in order. For dictionaries, whose size is bounded; the bytes come to the driver."""
    found = rows.select(order, slot(F.col(column), size).alias("record")).orderBy(order).toLocalIterator()
    return b"".join(bytes(r["record"]) for r in found)
