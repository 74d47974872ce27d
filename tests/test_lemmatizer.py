"""Builders, lookups and whole texts against a plain model and fixed expectations."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from morphlake.operators import dictionary as d
from morphlake.operators import lemmatize as z
from morphlake.operators import lookup as k
from morphlake.operators import metrics as m
from morphlake.plans import fixtures as fx
from morphlake.sources import records
from morphlake.sources.dictionary_csv import parse_lines, read_dictionary_lines
from morphlake.sources.text import read_lines, read_ordered_lines, read_words_any_break, read_words_raw, write_lines

LONG = "найвідповідальнішого"
CUT = "найвідповідальні"
EXPECTED = {
    "Теплому": ("Теплому", "теплий", "теплий", "теплий", "теплий", "Теплому", None),
    "теплому": ("теплий", "теплий", "теплий", "теплий", "теплий", "теплий", "теплий"),
    "Києва": ("Києва", "Київ", "Київ", "Київ", "Київ", "Київ", None),
    "двері": ("", "двері", "", "двері", "двері", "двері", "двері"),
    "двері,": ("двері,", "двері,", "двері,", "двері,", "двері,", "двері,", None),
    LONG: (CUT, CUT, CUT, LONG.encode()[:31], LONG.encode()[:31], CUT, CUT),
    "по-перше": ("по-перше", "по-перше", "по-перше", "по-перше", "по-перше", "по-перше", None),
    "абвгдеєжзийклмноп": ("абвгдеєжзийклмноп",) * 3 + ("абвгдеєжзийклмноп".encode()[:31],) * 2 + ("абвгдеєжзийклмно", None),
    "абракадабра": ("абракадабра",) * 6 + (None,),
}


@pytest.fixture(scope="module")
def parsed(spark):
    return parse_lines(fx.lines(spark)).cache()


def _builders(parsed):
    trie = d.trie_dictionary(parsed)
    return [(trie, k.COLUMNAR), (trie, k.PACKED), (trie, k.SINGLE_THREAD), (trie, k.STRIDE), (d.bounded_dictionary(parsed), k.BOUNDED), (k.linear_dictionary(d.pair_dictionary(parsed)), k.LINEAR), (d.resolve(d.automaton_entries(parsed)), k.EXACT)]


def test_variants(spark, parsed):
    tokens = spark.createDataFrame([(t,) for t in EXPECTED], "token string")
    for number, (dictionary, variant) in enumerate(_builders(parsed)):
        found = {r["token"]: bytes(r["lemma"]) for r in k.lookup(tokens, dictionary, variant).withColumn("lemma", F.col("lemma").cast("binary")).collect()}
        wanted = {t: v[number] if isinstance(v[number], bytes) else v[number].encode() for t, v in EXPECTED.items() if v[number] is not None}
        assert found == wanted, number
    gone = {r["token"] for r in k.missing(tokens, d.automaton_entries(parsed)).collect()}
    assert gone == {t for t, v in EXPECTED.items() if v[6] is None}


def test_trie_dictionary_and_statistics(parsed):
    trie = {r["key"]: r["lemma"] for r in d.trie_dictionary(parsed).collect()}
    assert trie == {"теплому": "теплий", "ящірки": "ящірка", "ходив": "ходити", "києва": "Київ", "мати": "мати", "двері": "", "": "порожній", LONG: "найвідповідальніший", '"лапки': " з комою\"", " пробіл": "пробіл"}
    assert tuple(d.trie_statistics(d.trie_dictionary(parsed)).first()) == (124, 123, 143)


def test_greatest_and_least_lemma(parsed):
    entries = d.automaton_entries(parsed)
    pick = lambda policy: {r["key"]: r["lemma"] for r in d.resolve(entries, policy).collect()}["києва"]
    assert (pick("greatest"), pick("least")) == ("кий", "Київ")


def test_columnar_texts(spark, parsed):
    wanted = {0: "Теплому ходити", 1: "теплий ходити", 2: "теплий порожній ходити", 3: "двері, ", 4: f"{CUT} абракадабра", 5: "порожній по-перше\tмати\nящірки", 6: "порожній", 8: "мати\n\nКиєва\n", 9: " мати"}
    for plan in ("join", "arrow"):
        found = {r["id"]: r["lemmatized"] for r in z.lemmatize_columnar(fx.texts(spark), d.trie_dictionary(parsed), ["id"], plan=plan).collect()}
        assert found == wanted, plan


def test_lines_keep_blank_ones(spark, parsed):
    lines = z.split_lines(fx.texts(spark), ["id"])
    for plan in ("join", "arrow"):
        found = z.lemmatize_lines(lines, d.trie_dictionary(parsed), ["id", "line_no"], plan=plan)
        rows = {(r["id"], r["line_no"]): r["text"] for r in found.collect()}
        assert rows[5, 0] == "по-перше мати" and rows[5, 1] == "ящірка"
        assert [rows[8, i] for i in range(3)] == ["мати", "", "Київ"] and (8, 3) not in rows
        assert rows[3, 0] == "двері, " and (6, 0) not in rows and (7, 0) not in rows


def test_plans_agree_on_random_texts(spark):
    chance = random.Random(4)
    pieces = ["a", "B", "Ab", "é", "İx", "end", " ", "  ", "\t", "\n", "\x0b", "\x0c", "\r", "\xa0", "-", ""]
    rows = [(i, "".join(chance.choices(pieces, k=chance.randint(0, 12)))) for i in range(500)] + [(500, None)]
    texts = spark.createDataFrame(rows, "id int, text string")
    dictionary = spark.createDataFrame([("a", "LEMMA"), ("ab", ""), ("end", "é" * 20), ("", "empty")], "key string, lemma string")
    for tokenizer in ("whitespace", "single_space"):
        for variant in (k.COLUMNAR, k.PACKED, k.SINGLE_THREAD):
            one, two = ({r["id"]: r["t"] for r in z.lemmatize_texts(texts, dictionary, ["id"], tokenizer=tokenizer, variant=variant, plan=plan, out="t").select("id", F.hex(F.col("t").cast("binary")).alias("t")).collect()} for plan in ("join", "arrow"))
            assert one == two, (tokenizer, variant)
    model = {i: " ".join({"a": "LEMMA", "end": "é" * 16}.get(w, w) if w != "ab" else "" for w in re.findall(r"[^ \t\n\v\f\r]+", t.lower())) for i, t in rows if t and "İ" not in t}
    found = {r["id"]: r["lemmatized"] for r in z.lemmatize_texts(texts, dictionary, ["id"]).collect()}
    assert {i: t for i, t in found.items() if i in model} == {i: t for i, t in model.items() if re.search(r"[^ \t\n\v\f\r]", rows[i][1])}


def test_empty_dictionary_is_identity(spark):
    texts = spark.createDataFrame([(1, " a  b "), (2, "")], "id int, text string")
    none = spark.createDataFrame([], "key string, lemma string")
    assert {r["id"]: r["lemmatized"] for r in z.lemmatize_columnar(texts, none, ["id"]).collect()} == {1: " a  b ", 2: ""}
    with pytest.raises(ValueError):
        d.require_entries(none)


def test_column(spark, parsed):
    words = spark.createDataFrame([(1, "теплому"), (2, None)], "id int, word string")
    assert {r["id"]: r["lemma"] for r in z.lemmatize_column(words, "word", d.trie_dictionary(parsed)).collect()} == {1: "теплий", 2: None}


def test_files(spark, tmp_path, parsed):
    source = tmp_path / "dict.csv"
    source.write_bytes(("form,lemma\n" + "\n".join(fx.LINES) + "\n").encode())
    lines = read_dictionary_lines(spark, str(source))
    assert [(r["line_no"], r["line"]) for r in lines.orderBy("line_no").collect()] == list(enumerate(fx.LINES, 1))
    with pytest.raises(Exception):  # noqa: B017
        read_dictionary_lines(spark, str(tmp_path / "none.csv")).count()
    text = tmp_path / "in.txt"
    text.write_bytes("теплому ходив\r\n\nКиєва\n".encode())
    found = read_lines(spark, str(text))
    assert [r["line"] for r in found.orderBy("line_no").collect()] == ["теплому ходив\r", "", "Києва"]
    done = z.lemmatize_lines(found.select("line_no", "line"), d.trie_dictionary(parsed), ["line_no"])
    write_lines(done, str(tmp_path / "out"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))) == "теплий ходити\n\nКиїв\n"
    words = tmp_path / "words.txt"
    words.write_bytes(fx.BREAKS.encode())
    assert sorted(r["word"] for r in read_words_raw(spark, str(words)).collect()) == sorted(["one\r", "two", "three four\r", "\r", "five"])
    assert sorted(r["word"] for r in read_words_any_break(spark, str(words)).collect()) == sorted(["one", "two", "three four", "five"])


def test_cache_and_records(spark, tmp_path, parsed):
    calls = []
    build = lambda: calls.append(1) or d.bounded_dictionary(parsed)
    for _ in range(2):
        assert d.load_or_build(spark, str(tmp_path / "table"), build).count() == 8
    assert calls == [1]
    rows = d.bounded_dictionary(parsed)
    keys, lemmas = tmp_path / "k.bin", tmp_path / "v.bin"
    keys.write_bytes(records.pack_records(rows, "key", "key"))
    lemmas.write_bytes(records.pack_records(rows, "lemma", "key"))
    back = records.read_record_pairs(spark, str(keys), str(lemmas))
    assert {(r["key"], r["lemma"]) for r in back.collect()} == {(r["key"], r["lemma"]) for r in rows.collect()}
    lemmas.write_bytes(lemmas.read_bytes() + bytes(32))
    with pytest.raises(ValueError):
        records.read_record_pairs(spark, str(keys), str(lemmas))
    lemmas.write_bytes(b"short")
    with pytest.raises(ValueError):
        records.read_record_pairs(spark, str(keys), str(lemmas))


def test_counts(spark):
    runs = spark.createDataFrame([(100, 10.0), (100, 30.0)], "words long, ms double")
    assert tuple(m.loop_statistics(runs).first()) == (2, 20.0, 30.0, 5000.0)
    assert (m.throughput(5, 0), m.throughput(5, 500)) == (0.0, 10.0)
    lines = spark.createDataFrame([(1, " a  b\t"), (2, None)], "id int, line string")
    assert {r["id"]: r["words"] for r in m.line_word_counts(lines, ["id"]).collect()} == {1: 2, 2: 0}


def test_stream(spark, tmp_path, parsed):
    from morphlake.streaming.texts import lemmatize_batches

    fx.texts(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, text string").parquet(str(tmp_path / "in"))
    lemmatize_batches(stream, d.trie_dictionary(parsed).cache(), ["id"], str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    rows = {r["id"]: r["lemmatized"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows[1] == "теплий ходити" and 7 not in rows


def test_command_line(spark, tmp_path, capsys):
    from morphlake.cli import main

    source, text = tmp_path / "dict.csv", tmp_path / "in.txt"
    source.write_bytes(("form,lemma\n" + "\n".join(fx.LINES) + "\n").encode())
    text.write_bytes("Теплому ходив\n\nдвері\n".encode())
    assert main([str(source), str(text)]) == 0
    assert capsys.readouterr().out == "теплий ходити\n\nдвері\n"
    for variant in ("single_thread", "stride", "bounded"):
        assert main([str(source), str(text), str(tmp_path / variant), "--variant", variant]) == 0
        out = "".join(p.read_text() for p in sorted((tmp_path / variant).glob("part-*")))
        assert out == ("теплий ходити\n\n\n" if variant == "single_thread" else "теплий ходити\n\nдвері\n")
    assert main([str(source), str(text), "--seconds", "0"]) == 0
    assert "1 iterations" in capsys.readouterr().err


def test_split_files_keep_line_numbers(spark, tmp_path):
    """Files of many blocks, an empty one and one without a last line feed: numbers are those of the lines in order."""
    texts = {"a.txt": "".join(f"line {i}\n" * (1 + i % 3) for i in range(3000)), "b.txt": "", "c.txt": "one\r\n\n\nlast"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        assert read_lines(spark, str(tmp_path / "a.txt")).rdd.getNumPartitions() > 3
        found = sorted((r["file"].rsplit("/")[-1], r["line_no"], r["line"]) for r in read_lines(spark, str(tmp_path)).collect())
        ordered = [r["line"] for r in read_ordered_lines(spark, str(tmp_path)).orderBy("line_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    pieces = {name: text.split("\n")[: -1 if text.endswith("\n") or not text else None] for name, text in texts.items()}
    assert found == [(name, i, line) for name, lines in sorted(pieces.items()) for i, line in enumerate(lines)]
    assert ordered == [line for _, lines in sorted(pieces.items()) for line in lines]


def test_large_dictionaries_join(spark, monkeypatch):
    """Beyond the counted bound the forced Arrow plan raises and the automatic one joins."""
    texts = spark.createDataFrame([(1, "a  b"), (2, " "), (3, None)], "id int, text string")
    dictionary = spark.createDataFrame([("a", "x"), ("b", "y"), ("", "z")], "key string, lemma string")
    monkeypatch.setattr(z, "ARROW_ROWS", 2)
    with pytest.raises(ValueError, match="join plan"):
        z.lemmatize_texts(texts, dictionary, ["id"], plan="arrow")
    assert {r["id"]: r["lemmatized"] for r in z.lemmatize_texts(texts, dictionary, ["id"]).collect()} == {1: "x y"}
    for plan in ("auto", "join"):
        assert {r["id"]: r["text"] for r in z.lemmatize_lines(texts, dictionary, ["id"], line="text", plan=plan).collect()} == {1: "x y", 2: "", 3: ""}
        monkeypatch.setattr(z, "ARROW_ROWS", 9)


def test_metrics_and_demonstration(spark, tmp_path, capsys):
    from morphlake.cli import main

    source, text = tmp_path / "dict.csv", tmp_path / "in.txt"
    source.write_bytes(("form,lemma\n" + "\n".join(fx.LINES) + "\n").encode())
    text.write_bytes("Теплому ходив\n\nдвері\n".encode())
    assert main([str(source), str(text), "--metrics-only"]) == 0
    out = capsys.readouterr()
    assert out.out == "" and out.err.startswith("Words: 3\n") and all(name in out.err for name in ("dictionary", "scan", "tokenize", "lookup", "end_to_end"))
    assert main([str(source)]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert len(lines) == 24 and lines[0] == "теплому теплий" and lines[3] == "українська українська"
    took = m.phase_times({"one": lambda: spark.range(3), "two": lambda: spark.range(3)})
    assert took["total"] == took["one"] + took["two"] > 0


def test_arrow_plan_holds_little(spark, monkeypatch):
    """A dictionary is shared as columns, not as objects; texts are looked up in slices of bounded size, whatever the batches."""
    rows = pa.table({"key": pa.array([b"wordform%d" % i for i in range(100_000)]), "lemma": pa.array([b"lemma%d" % i for i in range(100_000)])})
    shared = z.shared_map(spark, rows)
    assert isinstance(shared.value, pa.Table) and shared.value.nbytes < 40 * rows.num_rows
    texts = ["a" * n for n in (3, 50, 4, 4, 0, 1, 9, 10, 11)] + [None, "b"]
    batch = pa.record_batch({"id": pa.array(range(11)), "text": pa.array(texts)})
    for given in ([batch], [batch.slice(i, 1) for i in range(11)], [batch.slice(0, 0), batch.slice(0, 7), batch.slice(7)]):
        made = list(z.sliced(iter(given), 1, 10))
        assert [r for b in made for r in b.to_pylist()] == batch.to_pylist()
        assert all(sum(len(t or "") for t in b["text"].to_pylist()) <= 10 or b.num_rows == 1 for b in made)
    monkeypatch.setattr(z, "SLICE_BYTES", 10)
    frame = spark.createDataFrame([(i, f"wordform{i} x  wordform{2 * i} ") for i in range(300)], "id int, text string")
    dictionary = spark.range(500).select(F.concat(F.lit("wordform"), "id").alias("key"), F.when(F.col("id") != 7, F.concat(F.lit("lemma"), "id")).alias("lemma"))
    lemma = lambda i: f"lemma{i}" if i < 500 and i != 7 else f"wordform{i}"
    for plan in ("join", "arrow"):
        found = {r["id"]: r["lemmatized"] for r in z.lemmatize_columnar(frame, dictionary, ["id"], plan=plan).collect()}
        assert found == {i: f"{lemma(i)} x  {lemma(2 * i)} " for i in range(300)}, plan


def _plain(text: str, dictionary: dict[str, str], variant: k.Variant) -> str | None:
    """One text by the variant's rules, white-space tokens, ASCII."""
    done = []
    for token in (text.lower() if variant.lower else text).split():
        cut = token if variant.token_bytes is None else token[: variant.token_bytes]
        if cut in dictionary:
            lemma = dictionary[cut]
            done.append(token if variant.empty_is_miss and not lemma else lemma if variant.lemma_bytes is None else lemma[: variant.lemma_bytes])
        elif variant.misses:
            done.append(cut)
    return " ".join(done) if done else None


def test_join_plan_makes_no_row_a_token(spark, monkeypatch):
    """Texts are exchanged once and nothing is regrouped token by token, whatever the size of the dictionary; all variants."""
    chance = random.Random(5)
    pieces = ["a", "Ab", "w" * 31, "w" * 32, "w" * 33, "none", "gone", "End"]
    rows = [(i, " ".join(chance.choices(pieces, k=chance.randint(0, 60)))) for i in range(200)] + [(200, "none gone"), (201, None)]
    texts = spark.createDataFrame(rows, "id int, text string")
    lemmas = {"a": "LEMMA", "Ab": "kept", "ab": "", "end": "e" * 40, "w" * 31: "slot", "w" * 32: "x" * 32}
    dictionary = spark.createDataFrame(list(lemmas.items()), "key string, lemma string")
    monkeypatch.setattr(z, "SLICE_BYTES", 300)
    monkeypatch.setattr(z, "CHUNK_BYTES", 1000)
    for large in (False, True):
        if large:
            monkeypatch.setattr(z, "sized", lambda d: d.hint("merge"))
        for variant in k.VARIANTS.values():
            found = z.lemmatize_texts(texts, dictionary, ["id"], variant=variant, plan="join")
            wanted = {i: t for i, text in rows if text is not None and (t := _plain(text, lemmas, variant)) is not None}
            assert {r["id"]: r["lemmatized"] for r in found.collect()} == wanted, (large, variant)
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "collect_list" not in plan and plan.count("REPARTITION_BY_COL") == 2 and plan.count("ReusedExchange") == 1
    none = dictionary.limit(0)
    assert {r["id"] for r in z.lemmatize_texts(texts, none, ["id"], variant=k.SINGLE_THREAD, plan="join").collect()} == {i for i, t in rows if t}
    assert z.lemmatize_texts(texts.limit(0), dictionary, ["id"], plan="join").count() == 0
