"""Shared pieces: table access, shared-folder tables, whitespace classes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters, as a Java and Python character class.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_text(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    return F.filter(F.split(text, f"[{SPACE}]+", -1), lambda w: w != "")


def literal_doubles(values: list[float]) -> Column:
    """A constant array, folded by the optimizer, for tables of a fixed size."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, also where body's own lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free(columns: list[str], *names: str) -> list[str]:
    """Names for helper columns that none of the columns has, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it; where it is unset, a local master gets a folder
    of its own and any other raises, for a local folder is not shared there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="morphlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@dataclass(frozen=True)
class Stored:
    """A written table; ``drop`` removes its files once nothing reads them any more."""

    spark: SparkSession
    path: str

    @property
    def df(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def drop(self) -> None:
        if self in _LIVE:
            _LIVE.remove(self)
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


_LIVE: list[Stored] = []


def store(df: DataFrame, label: str) -> Stored:
    """Cuts lineage: writes the rows to the shared folder, so a lost executor costs no more than the reading of files."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _LIVE.append(Stored(df.sparkSession, path))
    return _LIVE[-1]


def clean_up() -> None:
    """Removes every table that operators have stored and not dropped. For callers whose results are written by now."""
    while _LIVE:
        _LIVE[-1].drop()


def trim() -> None:
    """Gives freed memory of a Python worker back to the system; workers stay alive between stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: Bytes that a broadcast side may take, as its rows are counted; a larger side is joined by an exchange.
BROADCAST_BYTES = 64 << 20


def small(rows: DataFrame, row_bytes: int) -> DataFrame:
    """The rows of a stored table, with a broadcast hint if their counted number keeps them within BROADCAST_BYTES."""
    return F.broadcast(rows) if rows.count() * row_bytes <= BROADCAST_BYTES else rows
