"""Rows with every awkward case that all operators share."""

from __future__ import annotations

import random

import pytest

PIECES = ["a", "b.", "@", "x-", ".c", "1", "23", "4.5", " ", "-", "+", "(", ")", "😀", "é", "token", "=", '"', ":", "AKIA", "API_KEY", "secret", "ABCDEF12345678", "deadbeef" * 4, "0123456789abcdef", "4111 1111 1111 1111", "1.2.3.4", "256.", "\n", "_", "Q9z8Y7x6W5v4U3t2S1r0", "012", "\t", "word", "Word", "<|endoftext|>"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, digest string, weight int, sequence int"


def row(doc_id, text, lang="en", source="s"):
    """With extra columns whose names operators use inside."""
    return (doc_id, text, lang, source, None if text is None else len(text), False, 1.5, "d", 3, 4)


def awkward():
    chance = random.Random(5)
    rows = [row(i, "".join(chance.choices(PIECES, k=chance.randint(0, 25))), chance.choice(["en", "fr", None]), chance.choice(["s", "t", None])) for i in range(600)]
    rows += [row(1001, None), row(1002, ""), row(1003, "a@b.c " * 2000 + "token=abcdefgh "), row(1004, "1 23 4" * 5000), row(1005, "a@b" + ".c" * 20000), row(1006, "x" * 100_000), row(1007, "1" * 50_000)]
    rows += [row(1008, "one two three four " * 30), row(1008, "one two three four " * 30), row(1009, "onetwo three four " + "one two three four " * 29), row(None, "no id at all"), row(1010, " \t\n")]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder(spark, docs, tmp_path_factory):
    """The awkward rows as tables of a data folder, and some labels."""
    path = str(tmp_path_factory.mktemp("data"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 > 0)) for i in range(0, 600, 2)] + [(3, None), (None, 1), (4, 1), (4, 0)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="session")
def texts():
    """doc_id -> text, null as empty, without the repeated and the null id."""
    return {r[0]: r[1] or "" for r in awkward() if r[0] not in (None, 1008)}
