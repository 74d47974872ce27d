"""Secrets and personal data against regular expressions of another engine."""

from __future__ import annotations

import collections
import hashlib
import importlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from morphlake.llm import personal_data as pii
from morphlake.llm import secrets, spans

ANY = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
ASSIGN = "(?:" + "|".join([*map(ANY, ("password", "passwd", "secret", "token")), ANY("api") + "_?" + ANY("key")]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def luhn(digits: str) -> bool:
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def _digits(m: re.Match) -> str:
    return re.sub("[^0-9]", "", m.group())


SECRETS = (("assign", ASSIGN, lambda m: len(m.group(1)) >= 8), ("access", "AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 16), ("hex", "[0-9a-f]+", lambda m: len(m.group()) >= 32))
PERSONAL = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group().split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(_digits(m)) <= 19 and luhn(_digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(_digits(m)) <= 15),
)


def expected(text: str, kinds) -> list[list[tuple]]:
    return [[(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if fits(m)] for kind, pattern, fits in kinds]


def joined(found) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def _hold(rows, texts, kinds, order):
    seen = 0
    for r in rows:
        if r["doc_id"] in texts:
            own = expected(texts[r["doc_id"]], kinds)
            flat = order(own)
            assert [r[f"n_{kind}"] for kind, _, _ in kinds] == [len(x) for x in own]
            assert r["base_sha256"] == hashlib.sha256(joined(flat).encode()).hexdigest(), r["doc_id"]
            every = r["spans"].split(",") if r["spans"] else []
            assert {f"{k}:{a}:{b}" for k, a, b in flat} <= set(every)
            seen += 1
    assert seen == len(texts)


def test_secrets(spark, folder, texts):
    names = [k for k, _, _ in SECRETS]
    order = lambda own: sorted((x for part in own for x in part), key=lambda s: (s[1], names.index(s[0])))
    _hold(secrets.op4_secret_scan(spark, folder).collect(), texts, SECRETS, order)


def test_personal_data(spark, folder, texts):
    _hold(pii.op5_personal_data(spark, folder).collect(), texts, PERSONAL, lambda own: [x for part in own for x in part])


@pytest.mark.parametrize("query,kinds", [(secrets.op4_secret_scan, SECRETS), (pii.op5_personal_data, PERSONAL)])
def test_documents(spark, sf, query, kinds):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    names = [k for k, _, _ in kinds]
    order = (lambda own: sorted((x for part in own for x in part), key=lambda s: (s[1], names.index(s[0])))) if kinds is SECRETS else (lambda own: [x for part in own for x in part])
    _hold(query(spark, sf).collect(), texts, kinds, order)


def test_many_matches_in_one_text(spark):
    text = "é 12 " * 3000
    found = spark.createDataFrame([(text,)], "text string").select(spans.find(F.col("text"), "[0-9]+").alias("s")).first()["s"]
    assert [(s["start"], s["end"]) for s in found] == [m.span() for m in re.finditer("[0-9]+", text)]


def test_markov_models_tell_random_from_ordinary(spark, docs):
    model = secrets.fit(secrets.labelled_samples(docs))
    rows = [(0, "kJ8sdfL29vXcQ0pR7tYbN3mW", True), (1, "internationalisation_of_names", False), (2, "the-long-identifier-of-a-thing", False), (3, "9f8b7c6d5e4f3a2b1c0d9e8f", True), (4, "=" * 40, False), (5, None, False)]
    data = spark.createDataFrame([(i, t and f"see {t} there", i) for i, t, _ in rows], "doc_id long, text string, secret_spans int")
    found = {r["doc_id"]: r["secret_spans"] for r in secrets.find_secrets(data, model).collect()}
    assert {i: bool(s) for i, s in found.items()} == {i: secret for i, _, secret in rows}
    assert all(s[0]["kind"] == "markov" and s[0]["start"] == 4 for s in found.values() if s)
    assert secrets.redact(secrets.find_secrets(data, model)).filter("doc_id = 0").first()["text"] == "see <SECRET> there"


def ratio(model: list[float], run: str) -> float:
    codes = [0, *[secrets.ALPHABET.find(c) + 1 for c in run]]
    return sum(model[a * secrets.SIZE + b] for a, b in zip(codes, codes[1:]))  # noqa: B905


def test_markov_models_held_out(spark, sf):
    """Random strings without a keyword, and names of the standard library, neither of them among the samples."""
    chance, size = random.Random(11), secrets.ALPHABET
    alphabets = ("0123456789abcdef", "0123456789ABCDEF", size[:62], size[:64], "abcdefghijklmnopqrstuvwxyz0123456789")
    planted = [("".join(chance.choices(letters, k=chance.randint(20, 31))), True) for letters in alphabets for _ in range(100)]
    modules = "asyncio unittest http.server ssl socket logging.handlers email.message urllib.request multiprocessing inspect tarfile zipfile sqlite3 decimal locale".split()
    names = {n.strip("_") for m in modules for n in dir(importlib.import_module(m)) if len(n.strip("_")) >= 20}
    assert len(names) > 150
    rows = [*planted, *[(n, False) for n in sorted(names)]]
    data = spark.createDataFrame([(i, f"see {t} there") for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    model = secrets.fit(secrets.labelled_samples(spark.read.parquet(f"{sf}/documents.parquet")))
    found = {r["doc_id"]: any(s["kind"] == "markov" for s in r["secret_spans"]) for r in secrets.find_secrets(data, model).collect()}
    caught = sum(found[i] for i, (_, secret) in enumerate(rows) if secret) / len(planted)
    wrong = sum(found[i] for i, (_, secret) in enumerate(rows) if not secret) / len(names)
    assert caught >= 0.9 and wrong <= 0.02, (caught, wrong)
    for i, (t, _) in enumerate(rows):
        assert found[i] == (ratio(model, t) >= secrets.LEAST and any(c.isalpha() for c in t))


def test_markov_fit(spark):
    """The table against counters: samples weigh alike, and the corpus's at most as much as the generated ones."""
    samples = [("ab" * 40, False, True), ("cab", False, True), ("bac", False, True), ("ba-1", False, False), ("9", True, False), ("a9b", True, True), ("", True, True), ("abba", False, False)]
    table = secrets.fit(spark.createDataFrame(samples, "token string, secret boolean, corpus boolean"))
    counts = {}
    for token, secret, corpus in samples:
        codes = [0, *[secrets.ALPHABET.find(c) + 1 for c in token]]
        for pair in zip(codes, codes[1:]):  # noqa: B905
            counts[secret, corpus, pair] = counts.get((secret, corpus, pair), 0) + 20 * (secrets.WEIGHT // len(token)) / secrets.WEIGHT
    total = lambda secret, corpus: sum(v for (s, c, _), v in counts.items() if (s, c) == (secret, corpus))
    share = {s: min(1.0, total(s, False) / total(s, True)) for s in (True, False)}
    assert share[False] < 1 and share[True] == 1
    for a in range(secrets.SIZE):
        p = [[counts.get((s, False, (a, b)), 0) + share[s] * counts.get((s, True, (a, b)), 0) + 0.5 for b in range(secrets.SIZE)] for s in (True, False)]
        own = [math.log(r / sum(p[0])) - math.log(o / sum(p[1])) for r, o in zip(*p, strict=True)]
        assert table[a * secrets.SIZE : (a + 1) * secrets.SIZE] == pytest.approx(own)


def test_ordinary_samples_lack_hits(spark):
    """Runs that a pattern covers are no ordinary samples, and letter-only hexadecimal runs neither."""
    text = "token = abcdefghijklmnop and deadbeefdeadbeefdeadbeefdeadbeefdeadbeef but ordinaryidentifier"
    found = secrets.labelled_samples(spark.createDataFrame([(1, text)], "doc_id long, text string")).filter("corpus").collect()
    assert {(r["token"], r["secret"]) for r in found} == {("abcdefghijklmnop", True), ("deadbeef" * 5, True), ("ordinaryidentifier", False)}


def test_clashing_names(spark):
    data = spark.createDataFrame([(1, "token=abcdefgh1 or a@b.cc", 5, 6, 7)], "doc_id long, text string, BASE int, runs int, base_ int")
    assert secrets.find_secrets(data).select(*data.columns).first() == data.first()
    assert pii.sanitise(data).columns == data.columns and pii.sanitise(data).first()["text"] == "token=abcdefgh1 or <EMAIL>"


def test_empty_samples_and_tables(spark, none):
    model = secrets.fit(spark.createDataFrame([], "token string, secret boolean, corpus boolean"))
    assert len(model) == secrets.SIZE**2 and set(model) == {0.0}
    assert secrets.find_secrets(none).count() == 0 and pii.find_personal_data(none).count() == 0 and pii.sanitise(none).count() == 0


def test_revealing_terms(spark):
    """A word met around one address in different texts, and nowhere else, is marked; words that others hold too are not.

    The background rows hold every other word of the six rows: a word that only they held would be revealing as well.
    """
    rows = [(i, f"number {i} then Zanzibarite wrote common words from boss@corp.example about item {i * 37}") for i in range(6)]
    rows += [(100 + i, f"common words wrote from then about number item {i} again") for i in range(200)]
    data = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, base int")
    found = {r["doc_id"]: [(s["kind"], s["match"]) for s in r["pii_spans"]] for r in pii.find_personal_data(data).collect()}
    assert all(x == [("email", "boss@corp.example"), ("removed", "zanzibarite")] for i, x in found.items() if i < 100)
    assert not any(x for i, x in found.items() if i >= 100)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(data).collect()}
    assert clean[0] == "number 0 then  wrote common words from <EMAIL> about item 0" and clean[100] == rows[6][1]
    copies = spark.createDataFrame([(i, rows[0][1]) for i in range(50)] + rows[6:], "doc_id long, text string")
    assert all(len(r["pii_spans"]) == 1 for r in pii.find_personal_data(copies).filter("doc_id < 50").collect())


def entities_of(kind: str, match: str) -> set[str]:
    digits = re.sub("[^0-9]", "", match)
    part = {"email": match.lower().split("@")[-1], "ip": ".".join(match.split(".")[:2]), "card": digits[:6], "phone": digits[:4]}[kind]
    return {f"{kind}:{digits if kind in ('card', 'phone') else match.lower()}", f"class:{kind}:{part}"}


def revealed(texts: list[str]) -> list[set]:
    """Brute force: the marked (start, end, kind) of each text, from counters over different texts."""
    held, terms = {}, {}
    for t in set(texts):
        base = [(k, m) for kind in PERSONAL for k, m in ((kind[0], m) for m in re.finditer(kind[1], t) if kind[2](m))]
        held[t] = set().union(*[entities_of(k, m.group()) for k, m in base])
        masked = list(t)
        for _, m in base:
            masked[m.start() : m.end()] = " " * (m.end() - m.start())
        every = lambda x: [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"\w{2,}", x)]
        terms[t] = (every("".join(masked)), {w for *_, w in every(t)})
    n, n_term = len(held), collections.Counter(w for _, words in terms.values() for w in words)
    n_entity = collections.Counter(e for x in held.values() for e in x)
    n_pair = collections.Counter((e, w) for t, x in held.items() for e in x for w in {w for *_, w in terms[t][0]})
    least = math.log(pii.ALPHA / sum(v >= 2 for v in n_term.values()))
    share = {}
    for (e, w), k in n_pair.items():
        if k >= 2 and n_entity[e] < n:
            x, q = k / n_entity[e], n_term[w] / n
            chance = -(k * math.log(x / q) + (0 if x == 1 else (n_entity[e] - k) * math.log((1 - x) / (1 - q)))) if x > q else 0
            value = math.log(n * k / (n_entity[e] * n_term[w])) / math.log(n / n_entity[e])
            if value >= pii.GENERALISE and chance <= least:
                share[e, w] = value
    out = []
    for t in texts:
        best = {w: max((share[e, w] for e in held[t] if (e, w) in share), default=None) for *_, w in terms[t][0]}
        out.append({(a, b, "removed" if best[w] >= pii.REMOVE else "term") for a, b, w in terms[t][0] if best[w] is not None})
    return out


def test_pointwise_information(spark):
    """Marks against counters: names near one address, a firm near its domain, a place near its area code, and chance."""
    chance = random.Random(8)
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    names = [("Ada", "ada@firm.example", "Firmware"), ("Bob", "bob@firm.example", "Firmware"), ("Eve", "eve@shop.example", "Shopping")]
    texts = []
    for i in range(600):
        text = chance.choices(words, k=25)
        if i % 5 == 0:
            name, mail, firm = names[i // 5 % 3]
            text[3:3] = [name, mail] + [firm] * (i % 10 == 0)
        if i % 7 == 0:
            text[9:9] = ["Placeham" if i % 14 else "Cityton", f"+{'1212' if i % 14 else '4455'}{i:07}"]
        texts.append(" ".join(text) + "." * (i % 3))
    texts += texts[:50] + [""]
    found = {r["doc_id"]: r["pii_spans"] for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    own = revealed(texts)
    marked = {texts[i][a:b].lower() for i, x in enumerate(own) for a, b, _ in x}
    assert {"firmware", "ada", "bob", "eve", "placeham", "cityton"} <= marked and len(marked) < 15
    for i, x in enumerate(own):
        assert {(s["start"], s["end"], s["kind"]) for s in found[i] if s["order"] == len(pii.KINDS)} == x, texts[i]
