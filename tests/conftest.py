"""One local session for all tests."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def compare(spark, sf_dir: str, query, sql: str) -> None:
    """Rows of a query and of its SQL, in any order, with the same columns."""
    import duckdb

    base = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        base.sql(f"create view {path.stem} as select * from '{path}'")
    own, other = query(spark, sf_dir).toPandas(), base.sql(sql).df()
    assert sorted(own.columns) == sorted(other.columns)
    columns = sorted(own.columns)
    rows = lambda df: sorted(map(repr, df[columns].itertuples(index=False, name=None)))
    assert rows(own) == rows(other)
