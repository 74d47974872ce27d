"""Fixed rows for queries over dictionaries: no table of the test data holds one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Lines of a dictionary file behind its header, one for each case of the builders.
LINES = [
    "теплому,теплий,adj",
    "ящірки,ящірка,noun",
    "ходив,ходити,verb",
    "Києва,Київ,prop",
    "києва,кий,noun",
    "по-перше,по-перше,adv",
    "мати,мати,noun",
    "мати,мати,verb",
    "двері,,noun",
    "двері,двері,noun",
    "безлеми",
    "кома,",
    ",порожній,x",
    "найвідповідальнішого,найвідповідальніший,adj",
    "",
    '"лапки, з комою",лапка,x',
    " пробіл,пробіл,x",
]
TOKENS = ["Теплому", "теплому", "Києва", "двері", "двері,", "найвідповідальнішого", "по-перше", "абвгдеєжзийклмноп", "абракадабра", "мати"]
TEXTS = ["Теплому ходив", "теплому ходив", "теплому  ходив", "двері, двері", "найвідповідальнішого абракадабра", " по-перше\tмати\nящірки", "", None, "мати\n\nКиєва\n", "двері мати"]
#: The words of the demonstration.
DEMO = [
    "теплому", "ящірки", "синього", "українська", "ходив", "двері", "чоловіка", "жінці", "вікном", "містах", "читала", "пишемо",
    "розмовляєш", "поїхав", "буду", "старіший", "найбільший", "відомому", "знайдену", "невідоме", "новини", "книжками", "допомагаючи", "бігатимеш",
]
#: Runs of a loop: words and milliseconds.
RUNS = [(761_625, 12.5), (761_625, 0.75), (761_625, 0.5), (0, 0.25)]
BREAKS = "one\r\ntwo\n\nthree four\r\n\r\nfive"


def _rows(spark: SparkSession, values: list, names: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(values)), names)


def lines(spark: SparkSession) -> DataFrame:
    return _rows(spark, LINES, "at int, line string").selectExpr("at + 1 as line_no", "line")


def tokens(spark: SparkSession) -> DataFrame:
    return _rows(spark, TOKENS, "i int, token string")


def demo(spark: SparkSession) -> DataFrame:
    return _rows(spark, DEMO, "i int, token string")


def texts(spark: SparkSession) -> DataFrame:
    return _rows(spark, TEXTS, "id int, text string")


def literal(value: str | None) -> str:
    """As SQL, line breaks and tabs spelled out."""
    if value is None:
        return "null"
    out = "'" + value.replace("'", "''") + "'"
    for mark, code in (("\n", 10), ("\r", 13), ("\t", 9)):
        out = out.replace(mark, f"' || chr({code}) || '")
    return f"({out})"


def values(rows: list, first: int = 0) -> str:
    return "(values " + ", ".join(f"({i}, {literal(x)})" for i, x in enumerate(rows, first)) + ")"
