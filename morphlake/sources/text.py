"""Line-oriented text sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _numbered(spark: SparkSession, path: str, over_files: bool) -> DataFrame:
    """file, line_no, line of splittable text files.

    A file is read in blocks, each by one task in order. A row's place in its block is its row id less the block's least;
    the lines of the blocks before are sums over a row a block. The files are read twice, the first time for the count.
    """
    block = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at")).alias("block")
    rows = spark.read.text(path, lineSep="\n").select("value", block, F.monotonically_increasing_id().alias("row"))
    blocks = rows.groupBy("block").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("lines"))
    earlier = W.orderBy("block") if over_files else W.partitionBy("block.file").orderBy("block")
    blocks = blocks.select("block", "first", (F.sum("lines").over(earlier) - F.col("lines")).alias("before"))
    found = rows.join(blocks, "block")
    return found.select(F.col("block.file").alias("file"), (F.col("row") - F.col("first") + F.col("before")).alias("line_no"), F.col("value").alias("line"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 0), line: pieces between line feeds; a carriage return stays in its line. Files are split."""
    return _numbered(spark, path, over_files=False)


def read_ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, line over all files of a folder in order of their names, as ``write_lines`` leaves them."""
    return _numbered(spark, path, over_files=True).select("line_no", "line")


def read_unordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, for files of any size whose order does not matter: splittable."""
    return spark.read.text(path, lineSep="\n").select(F.col("value").alias("line"))


def words_raw(text: DataFrame, column: str = "text") -> DataFrame:
    """word: one a line, empty lines skipped, carriage returns kept."""
    return text.select(F.explode(F.split(column, "\n", -1)).alias("word")).filter("word <> ''")


def words_any_break(text: DataFrame, column: str = "text") -> DataFrame:
    """word: as ``words_raw`` with carriage returns and line feeds both as separators, runs together."""
    return text.select(F.explode(F.split(column, "[\r\n]+", -1)).alias("word")).filter("word <> ''")


def read_words_raw(spark: SparkSession, path: str) -> DataFrame:
    return words_raw(read_unordered_lines(spark, path), "line")


def read_words_any_break(spark: SparkSession, path: str) -> DataFrame:
    return words_any_break(read_unordered_lines(spark, path), "line")


def write_lines(lines: DataFrame, path: str, order: str = "line_no", column: str = "text") -> None:
    """One line a row, in ascending order over the part files; blank lines stay."""
    lines.orderBy(order).select(F.coalesce(column, F.lit("")).alias("value")).write.mode("overwrite").text(path, lineSep="\n")
