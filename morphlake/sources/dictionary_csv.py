"""Dictionary lines from a CSV file: a header, then wordform,lemma and columns that do not count. No quoting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.sources.text import read_lines


def read_dictionary_lines(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """line_no (from 1 behind the header), line. A missing file raises. First-entry-wins needs the order of lines, which the
    scan numbers over a split file."""
    return read_lines(spark, path).filter(F.col("line_no") >= int(header)).select((F.col("line_no") + 1 - int(header)).alias("line_no"), "line")


def parse_lines(lines: DataFrame) -> DataFrame:
    """line_no, wordform, lemma, parsed. A line parses if something follows its first comma or if it has a second one."""
    parts = F.split("line", ",", -1)
    parsed = (F.size(parts) >= 3) | ((F.size(parts) == 2) & (F.get(parts, F.lit(1)) != ""))
    return lines.select("line_no", F.get(parts, F.lit(0)).alias("wordform"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("lemma"), parsed.alias("parsed"))
