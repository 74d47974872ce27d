"""Whole texts, whole documents, all pairs: cases that a partial count would miss."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pytest

from morphlake.llm import personal_data as pii
from morphlake.llm import pu_quality


# Quality classifier -------------------------------------------------------------------------------------------------
def shape_shares(text: bytes) -> np.ndarray:
    """Brute force: the shape of each word on its own."""
    shares = np.zeros(pu_quality.HASHED)
    found = text.split()
    for word in found:
        shape = re.sub(rb"([Aa0])\1+", rb"\1", word.translate(pu_quality._SHAPE))[:6]
        shares[pu_quality._hash(shape) % pu_quality.HASHED] += 1
    return shares / len(found)


def test_word_shapes_of_long_texts():
    plain = [b"word"] * 20_000
    junk = plain.copy()
    junk[7001:7049:2] = [b"#x9-|Q"] * 24  # between two multiples of fifty, at odd positions
    for found in (plain, junk, [b"a1", b"--"] * 10_000, [b"Abc", b"x"] * 399 + [b"9.5"]):
        text = b" ".join(found)
        assert np.allclose(pu_quality.features(text)[pu_quality.NUMBERS :], shape_shares(text), atol=1e-7)
    a, b = (pu_quality.features(b" ".join(x)) for x in (plain, [w + b"|" if i % 2 else w for i, w in enumerate(plain)]))
    assert a[13] == 0 and b[13] == 0.5


def plain_features(text: str) -> list[float]:
    """Brute force, letter by letter: the shares of a text."""
    data = text.encode()
    found = data.split()
    n = len(found)
    out = [min(math.log1p(n), 12) / 12, float(n < 50), *[0.0] * 14]
    if not n:
        return out
    size, share = len(data), lambda signs: sum(data.count(bytes([b])) for b in signs) / len(data)
    upper, lower = sum(65 <= b <= 90 for b in data), sum(97 <= b <= 122 or b >= 128 for b in data)
    lines = [x for x in data.split(b"\n") if x.strip()]
    pairs = {(found[i], found[i + 1]) for i in range(n - 1)}
    out[2:9] = [upper / max(1, upper + lower), min(1, 10 * share(b"#*$%&|<>@^~_={}[]\\/")), min(1, 10 * share(b".,;:!?")), share(b"0123456789"), min(1, 20 * share(b"!")), min(1, 20 * share(b"|")), min(1, (size - n) / n / 20)]
    out[9:13] = [len(set(found)) / n, len(pairs) / max(1, n - 1), len(set(lines)) / max(1, len(lines)), min(1, len(lines) / n * 5)]
    shapes = [re.sub(rb"([Aa0])\1+", rb"\1", w.translate(pu_quality._SHAPE))[:6] for w in found]
    out[13:16] = [sum(x[-1:] not in (b"A", b"a", b"0", b".", b",") for x in shapes) / n, out[10] * out[0], float(max(map(len, found)) > 60)]
    return out


def test_scores_of_whole_texts(spark):
    """Scores against features and a weighted sum of one's own, over a fitted model, long and odd texts among them."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, "#| " * 5000 + "é" * 999), (-2, ""), (-3, None), (-4, "\x0b\n \t"), (-5, "A1 b2\nA1 b2\n" * 900)], "doc_id long, text string"))
    found = pu_quality.vectors(docs).cache()
    model = pu_quality.learn(found, spark.read.parquet(f"{sf}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in pu_quality.score(found, model).collect()}
    for r in docs.collect():
        text = r["text"] or ""
        x = np.array([*plain_features(text), *(shape_shares(text.encode()) if text.split() else np.zeros(pu_quality.HASHED))])
        z = sum(w * min(8.0, max(-8.0, v)) for w, v in zip(model.weights, (x - model.mean) / model.scale, strict=True)) + model.bias
        assert scores[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4), r["doc_id"]


def test_prior_counts_all_documents(spark):
    """The histogram holds every document outside the fold but those fitted on, and a larger share gives a larger prior."""
    rows = [(i, f"good words of plain text number {i} " * 12 if i % 10 < 7 else "#$%| " * 30 + str(i)) for i in range(4000)]
    found = pu_quality.vectors(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    labels = spark.createDataFrame([(i, 1) for i in range(0, 4000, 10)], "doc_id long, quality int")
    p, u, ids = pu_quality.training_rows(found, pu_quality.training_ids(found, labels, 200))
    assert len(u) == len(ids) == 200 and len(p) == 200
    outside = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i, _ in rows)
    assert pu_quality._histogram(found, pu_quality.fit(p, u, 0.5, rounds=50), ids[::2]).sum() == outside - 100
    assert pu_quality.learn(found, labels, 200).prior == pytest.approx(0.7, abs=0.06)


def test_least_risk():
    """No small step from the fitted weights lowers the regularised non-negative risk by more than a trace."""
    chance = np.random.default_rng(4)
    p, u = chance.normal(1, 1, (500, 3)), np.concatenate([chance.normal(1, 1, (300, 3)), chance.normal(-1, 1, (200, 3))])

    def risk(w: np.ndarray) -> float:
        zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
        bad = np.logaddexp(0, zu).mean() - 0.6 * np.logaddexp(0, zp).mean()
        return 0.6 * np.logaddexp(0, -zp).mean() + max(0.0, bad) + 1e-3 / 2 * (w[:-1] ** 2).sum()

    w = pu_quality.fit_risk(p, u, 0.6, rounds=2000)
    assert all(risk(w) <= risk(w + step) + 2e-3 for step in chance.normal(0, 0.05, (200, 4)))


# Personal data ------------------------------------------------------------------------------------------------------
COMMON = "common words of a plain text that many others hold as well and that tell nothing of anyone here "


def marked(spark, texts: list[str]) -> list[list[str]]:
    """Of each text what its term spans cover."""
    found = pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [[texts[r["doc_id"]][s["start"] : s["end"]] for s in r["pii_spans"] if s["order"] == len(pii.KINDS)] for r in sorted(found, key=lambda r: r["doc_id"])]


def test_repeated_contact_line(spark):
    """Each of the equal lines of one document loses its revealing term."""
    line = COMMON + "Zanzibarite boss@corp.example " + COMMON
    texts = [line * 4] + [f"{COMMON} Zanzibarite {i} boss@corp.example {COMMON}" for i in range(4)] + [f"{COMMON} {i}" for i in range(200)]
    found = marked(spark, texts)
    assert [x.count("Zanzibarite") for x in found] == [4] + [1] * 4 + [0] * 200


def test_copies_do_not_hide_terms(spark):
    """One of the pages that hold a revealing term is copied a thousand times: the term stays revealing."""
    texts = [f"{i} pages by Zanzibarite at boss@corp.example" for i in range(10)] + ["0 pages by Zanzibarite at boss@corp.example"] * 1000
    found = marked(spark, texts + [f"{COMMON} {i}" for i in range(500)])
    assert [x.count("Zanzibarite") for x in found] == [1] * 1010 + [0] * 500


def test_terms_of_whole_documents(spark):
    """A short name far from the address and an account number are marked wherever they stand in the documents with it."""
    texts = [f"Zo {i} {COMMON * 3} boss@corp.example {COMMON * 2} account 7781x0 {COMMON} zo" for i in range(100, 104)]
    found = marked(spark, texts + [f"{COMMON} account boss corp {i}" for i in range(500, 900)])
    assert found[:4] == [["Zo", "7781x0", "zo"]] * 4 and not any(found[4:])
