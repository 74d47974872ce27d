"""Deduplication, fingerprints, packing, token files, quality, mixing and chat against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from morphlake.llm import chat_format, exact_dedup, fuse_filter, mixing, packing, pu_quality, quality_rules, simhash, token_files, tokens
from morphlake.llm.common import store
from morphlake.llm.components import roots
from tests.conftest import compare
from tests.llm.conftest import SCHEMA, awkward, row

SPACES = "[\x20\x09-\x0d]+"
TOKENIZER = Tokenizer.from_file(tokens.vocabulary_path())


def words(text: str) -> list[str]:
    return [w for w in re.split(SPACES, text) if w]


def ids_of(text: str | None) -> list[int]:
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


# Exact deduplication ------------------------------------------------------------------------------------------------
def test_fuse_filter():
    for n in (0, 1, 2, 5, 1000, 20000):
        keys = np.random.default_rng(n).integers(-(2**63), 2**63 - 1, n)
        made = fuse_filter.build(keys)
        assert fuse_filter.probe(made, keys).all()
        assert fuse_filter.probe(made, np.random.default_rng(n + 1).integers(-(2**63), 2**63 - 1, 20000)).mean() < 0.01


def expected_groups(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(SPACES, "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    return sorted(repr((m[3], min(g)[3], len(g), hashlib.sha256(norm.encode()).hexdigest())) for norm, g in groups.items() for m in g)


COLLIDING = exact_dedup.Digests(lambda norm: F.lit(5).cast("long"), lambda norm: F.substring(norm, 1, 0).cast("binary"))


@pytest.mark.parametrize("names", [None, COLLIDING])
@pytest.mark.parametrize("split", [None, False, True])
def test_exact_groups(docs, names, split):
    incoming = None if split is None else F.lit(split)
    found = exact_dedup.groups(docs, incoming, names, salt_rows=2).collect()
    if names is None:
        assert sorted(repr((r["doc_id"], r["keep_id"], r["group_size"], bytes(r["sha"]).hex())) for r in found) == expected_groups((r[0], r[1]) for r in awkward())
    else:
        strip = lambda rows: sorted(x.rsplit(",", 1)[0] for x in rows)
        assert strip(repr((r["doc_id"], r["keep_id"], r["group_size"], "")) for r in found) == strip(expected_groups((r[0], r[1]) for r in awkward()))
    assert len({(r["keep_id"], r["group_size"]) for r in found}) <= sum(r["kept"] for r in found)


def test_exact_small_snapshot(spark):
    """A large batch against a snapshot of ten rows, and against none: the batch is dealt over salts, each with the filter."""
    docs = spark.createDataFrame([(i, f"text {i % 2000}" if i < 3000 else "the same text") for i in range(3200)], "doc_id long, text string")
    for snapshot in (10, 0):
        incoming = F.col("doc_id") >= snapshot
        found = exact_dedup.groups(docs, incoming, salt_rows=2, batch_rows=100).collect()
        assert sorted(repr((r["doc_id"], r["keep_id"], r["group_size"], bytes(r["sha"]).hex())) for r in found) == expected_groups((r["doc_id"], r["text"]) for r in docs.collect())
    rows = exact_dedup.Digests().rows(docs)
    snapshot = exact_dedup.build_snapshot(rows.filter("doc_id < 10"))
    classes = store(exact_dedup._classes(rows.filter("doc_id >= 10")), "classes").df
    dealt = exact_dedup._dealt(classes, snapshot, exact_dedup._salts(classes, snapshot, 100)).groupBy("bucket", "salt").count().collect()
    assert len(dealt) > 10 and max(r["count"] for r in dealt) < 200
    kept = exact_dedup.screen(classes, snapshot, 100)
    assert kept.count() == classes.count() and kept.filter("maybe").count() < 40


def test_clashing_names(spark, folder):
    """Operators keep columns whose names they might use inside."""
    names = ["odd_id", "odd_digest", "stays", "ODD_ID_", "row", "words", "hashes", "pairs", "windows", "no", "own_topic", "kept_", "size", "salt"]
    docs = spark.createDataFrame([(i, "one two three four five six seven " * 9 + str(i % 3), "s", "en", *range(len(names))) for i in range(9)], "doc_id long, text string, source string, lang string, " + ", ".join(f"{n} int" for n in names))
    assert exact_dedup.keep_one(docs).columns == simhash.keep_one(docs).columns == mixing.mix(docs).columns == docs.columns
    model = quality_rules.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert quality_rules.judge(docs, model).select(*docs.columns).first() == docs.first() and quality_rules.keep(docs, model).columns == docs.columns


def test_exact_keep_one(docs, none):
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [re.sub(SPACES, "", r["text"] or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(SPACES, "", r[1] or "") for r in awkward()})
    assert exact_dedup.groups(none).count() == 0 and exact_dedup.keep_one(none).count() == 0


def test_exact_sql(spark, sf):
    compare(spark, sf, exact_dedup.op9_exact_dedup, exact_dedup.ORACLES["op9_exact_dedup"])


# SimHash ------------------------------------------------------------------------------------------------------------
def fingerprint(text: str) -> int:
    found = words(re.sub("[A-Z]", lambda m: m.group().lower(), text))
    if not found:
        return 0
    shingles = [" ".join(found)] if len(found) < 3 else [" ".join(found[i : i + 3]) for i in range(len(found) - 2)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: dict) -> dict:
    values = sorted(set(prints.values()))
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    array = np.array(values, np.uint64)
    for v in values:
        for j in np.nonzero(np.bitwise_count(array ^ np.uint64(v)) <= 3)[0]:
            parent[find(v)] = find(values[j])
    least = {}
    for i, v in prints.items():
        least[find(v)] = min(least.get(find(v), i), i)
    return {i: least[find(v)] for i, v in prints.items()}


def test_simhash(spark, folder, texts, sf):
    for path, own in ((folder, texts), (sf, {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()})):
        found = {r["doc_id"]: r for r in simhash.op8_simhash(spark, path).collect()}
        prints = {i: fingerprint(t) for i, t in own.items()}
        near = components(prints | ({1008: int(found[1008]["fingerprint"], 16)} if 1008 in found and path == folder else {}))
        assert all(found[i]["fingerprint"] == f"{p:016x}" and found[i]["component_id"] == near[i] for i, p in prints.items())


def test_long_text_in_steps(monkeypatch):
    text = ("Ab cd ef gh " * 40).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_STEP", 7)
    assert simhash.fingerprint(text) == whole == np.uint64(fingerprint(text.decode())).astype(np.int64)


@pytest.mark.parametrize("crowd", [2, 1000])
def test_links_of_crowds(spark, crowd):
    chance, values = random.Random(3), set()
    for base in [chance.getrandbits(64) for _ in range(4)]:
        for _ in range(60):
            x = base
            for _ in range(chance.randint(0, 4)):
                x ^= 1 << chance.randint(0, 63)
            values.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    prints = dict(enumerate(sorted(values)))
    edges = simhash.links(spark.createDataFrame([(signed(x),) for x in values], "fp long"), crowd).cache()
    assert edges.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 3).count() == 0
    root = {r["node"]: r["root"] for r in roots(edges).collect()}
    groups = defaultdict(list)
    for i, x in prints.items():
        groups[root.get(signed(x), signed(x))].append(i)
    assert {i: min(g) for g in groups.values() for i in g} == components(prints)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r["node"]: r["root"] for r in roots(edges).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert roots(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_keep_one(spark, docs, none):
    kept = simhash.keep_one(docs)
    own = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(set(own.values()))
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def shingles(text: str) -> set:
    found = words(re.sub("[A-Z]", lambda m: m.group().lower(), text))
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def family_texts() -> list[str]:
    """Families of one text with more and more words changed, unrelated texts and odd ones."""
    chance = random.Random(12)
    word = lambda: "".join(chance.choices("abcdefgh", k=5))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(200)]
        for changed in (0, 0, 1, 2, 3, 4, 6, 9, 30):
            own = base.copy()
            for at in chance.sample(range(200), changed):
                own[at] = word()
            texts.append(" ".join(own))
    return texts + [" ".join(word() for _ in range(n)) for n in (1, 4, 5, 6, 300, 70_000)] + ["", None, " \n", "one two", "One  two"]


@pytest.mark.parametrize("crowd", [3, 100])
def test_similar_texts(spark, crowd):
    """Components against all pairs of fingerprints; against all pairs of shingle sets within the stated error."""
    texts = family_texts()
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), crowd=crowd).collect()}
    prints = [simhash.wide_fingerprint((t or "").encode()) for t in texts]
    nodes = sorted(set(prints))
    width = simhash.segment_width(len(nodes))
    bits = {p: int.from_bytes(p, "little") for p in nodes}
    most = int(simhash.BITS * simhash.differing_share(0.8))
    parent = {p: p for p in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(nodes, 2):
        differ = bits[a] ^ bits[b]
        meet = any((differ >> k * width & (1 << width) - 1).bit_count() <= 1 for k in range(simhash.BITS // width))
        if meet and differ.bit_count() <= most:
            parent[find(a)] = find(b)
    least = {}
    for i, p in enumerate(prints):
        least.setdefault(find(p), i)
    if crowd == 100:
        assert found == {i: least[find(p)] for i, p in enumerate(prints)}
    own = [shingles(t or "") for t in texts]
    for i, j in combinations(range(len(texts)), 2):
        similarity = jaccard(own[i], own[j])
        assert similarity < 0.9 or found[i] == found[j], (i, j)
        assert similarity > 0.4 or found[i] != found[j], (i, j)


def together(pairs) -> dict:
    """The smallest node of each node's component."""
    least = {x: x for pair in pairs for x in pair}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


def test_meeting_in_any_batches():
    """Entries of a segment meet and link the same however they are cut into batches."""
    chance = np.random.default_rng(3)
    key = np.sort(np.concatenate([chance.integers(0, 60, 400), chance.integers(100, 900, 500)]))
    node = chance.permutation(900).astype(np.int64)
    base = chance.integers(0, 2**63, (5, 12), dtype=np.uint64)
    words = base[node % 5] ^ np.array([[sum(1 << int(k) for k in set(chance.integers(0, 64, 7))) for _ in range(12)] for _ in range(900)], np.uint64)
    segment = key >> 1
    met = [i for i in range(900) if (segment == segment[i]).sum() > 1 and key[segment == segment[i]][0] % 2 == 0]
    assert 400 < len(met) < 900
    most = 140
    links, leading = [], []
    for i in met:
        for j in met:
            if i < j and segment[i] == segment[j] and key[i] % 2 == 0 and np.bitwise_count(words[i] ^ words[j]).sum() <= most:
                links.append((int(node[i]), int(node[j])))
                if i - int(np.nonzero(segment == segment[i])[0][0]) < 5:
                    leading.append(links[-1])
    assert 100 < len(leading) < len(links)
    for step in (1, 7, 64, 900):
        cut = [pa.RecordBatch.from_arrays([pa.array(key[i : i + step]), pa.array(node[i : i + step])], ["key", "node"]) for i in range(0, 900, step)]
        out = pa.Table.from_batches(list(simhash._shared(iter(cut))))
        assert [out["key"].to_pylist(), out["node"].to_pylist()] == [key[met].tolist(), node[met].tolist()], step
        cut = []
        for at in range(0, len(met), step):
            own = met[at : at + step]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * 12), pa.array(words[own].view(np.int64).ravel()))
            cut.append(pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(node[own]), lists], ["key", "node", "words"]))
        for crowd in (5, 1000):
            edges = [(a, b) for out in simhash._linked(most, crowd)(iter(cut)) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True)]
            got, want = together(edges), together(links)
            if crowd == 1000:
                assert got == want, step
            else:  # every link with one of a segment's first entries, and no component more than all links have
                assert all(got[a] == got[b] for a, b in leading) and all(want[a] == want[b] for a, b in edges), step
    assert simhash.found_share(0.8, 200_000) == pytest.approx(0.908, abs=1e-3) and simhash.found_share(0.9, 200_000) > 0.99


def crowded_prints() -> np.ndarray:
    """Fingerprints that meet others of theirs in the first 16 bits alone, where most have one value and some lack a bit of
    it: pairs, chains of three and families, in a crowd of fingerprints without a partner."""
    chance = np.random.default_rng(8)

    def near(bits: np.ndarray) -> np.ndarray:  # two bits changed in each other segment
        out = bits.copy()
        for at in range(16, 768, 16):
            out[at + chance.choice(16, 2, replace=False)] ^= 1
        return out

    rows = []
    for length in [1] * 60 + [2] * 30 + [3] * 10:
        rows.append(chance.integers(0, 2, 768).astype(np.uint8))
        rows[-1][:16] = 1
        for _ in range(length - 1):
            rows.append(near(rows[-1]))
            if len(rows) % 4 == 0 and length == 2:
                rows[-1][chance.integers(0, 16)] = 0
    base = rows[0]
    for _ in range(40):
        rows.append(base.copy())
        rows[-1][16 + chance.integers(0, 752, 30)] ^= 1
    return np.packbits(np.array(rows), axis=1, bitorder="little").view("<u8")


def links_in_segments(words: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows within one bit in a segment whose complete distance is small enough."""
    most, width = int(simhash.BITS * simhash.differing_share(0.8)), simhash.segment_width(len(words))
    bits = [int.from_bytes(w.tobytes(), "little") for w in words]
    meet = lambda x: any((x >> k * width & (1 << width) - 1).bit_count() <= 1 for k in range(simhash.BITS // width))
    return [(i, j) for i, j in combinations(range(len(bits)), 2) if (bits[i] ^ bits[j]).bit_count() <= most and meet(bits[i] ^ bits[j])]


@pytest.mark.parametrize(("crowd", "block"), [(2, 7), (2, 8192), (20, 50)])
def test_crowded_segments_lose_no_link(spark, crowd, block):
    words = crowded_prints()
    want = links_in_segments(words)
    nodes = spark.createDataFrame([(i, w.view("<i8").tolist()) for i, w in enumerate(words)], "node long, words array<bigint>")
    edges = [(r["a"], r["b"]) for r in simhash.similar_links(nodes, crowd=crowd, block=block).collect()]
    assert together(edges) == together(want) and len(want) > 100
    assert len(edges) < 3 * len(words)


# Tokens -------------------------------------------------------------------------------------------------------------
def test_encoder_equals_library():
    chance = random.Random(1)
    pieces = [*"aA1 .'\n\té́İıßσΣςẖH̱ǅŉªº'S'll\x0b\x0c\r\x1c　èﬁ가#$&*|,", "<|endoftext|>", "'re", "ther", "É"]
    own = [None if i % 50 == 0 else "".join(chance.choices(pieces, k=chance.randint(0, 14))) for i in range(5000)]
    own += [chr(i) + "a" + chr(i) + "." for i in range(1, 0x600)]
    at = 0
    for first, ids, ends in tokens.encode_texts(pa.array(own), tokens.Encoder(tokens.vocabulary_path(), limit=50), step=4000):
        assert first == at
        for a, b in zip([0, *ends.tolist()], ends.tolist()):  # noqa: B905
            assert ids[a:b].tolist() == ids_of(own[at]), repr(own[at])
            at += 1
    assert at == len(own)


def test_other_vocabularies_are_refused():
    """The fast path is one vocabulary's; another file raises rather than give wrong ids."""
    with pytest.raises(ValueError, match="fast path"):
        tokens.encoder(tokens.vocabulary_path("byte_bpe_50k.json"))


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 3000])
def test_shard_round_trip(n):
    chance = np.random.default_rng(n)
    for ids in (chance.integers(0, 49408, n).astype(np.uint32), chance.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32), np.full(n, 7, np.uint32)):
        ends = np.sort(chance.integers(0, n + 1, 3))
        ends[-1] = n
        shard = token_files.Shard(token_files.encode_shard(ids, [5, None, 7], ends))
        assert (shard.ids() == ids).all() and shard.doc_ids == [5, None, 7]
        assert (np.concatenate([shard.document(k) for k in range(3)]) == ids).all()
    with pytest.raises(ValueError):
        token_files.Shard(bytes(100))


def test_token_files(spark, docs, none):
    shards = token_files.write_shards(docs, shard_ids=5000)
    found = sorted(token_files.read_shards(shards.df).collect(), key=lambda r: r["start"])
    at, rows = 0, sorted(awkward(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert shards.df.count() > 3 and len(found) == len(rows)
    for r, own in zip(found, rows, strict=True):
        ids = ids_of(own[1])
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (own[0], at, len(ids), crc(ids), np.asarray(ids, "<u4").tobytes())
        at += len(ids)
    assert token_files.read_shards(token_files.write_shards(none).df).count() == 0


# Packing ------------------------------------------------------------------------------------------------------------
def test_least_squares():
    chance = np.random.default_rng(0)
    for _ in range(20):
        a, x = chance.random((8, 5)), np.maximum(0, chance.normal(size=5))
        found = packing.nonnegative_least_squares(a, a @ x)
        assert (found >= 0).all() and np.allclose(a @ found, a @ x, atol=1e-2)


@pytest.mark.parametrize("window,most", [(2, 5), (32, 60), (33, 60), (4096, 9000)])
def test_plan(window, most):
    chance = np.random.default_rng(window)
    for n in (0, 1, 7, 400):
        whole, left = np.divmod(chance.integers(1, most, n), window)
        plan = packing.make_plan(np.bincount(left, minlength=window), np.bincount(left, whole, window).astype(int), window)
        ranks = np.arange(plan.before[1], plan.before[window])
        fill, pieces = defaultdict(int), []
        for s, o, length in zip(*map(np.ndarray.tolist, (*plan.place(ranks), plan.lengths(ranks))), strict=True):
            while length:
                pieces.append((s, o, min(length, window - o)))
                length, s, o = length - pieces[-1][2], s + 1, 0
        for s, o, length in sorted(pieces):
            assert fill[s] == o
            fill[s] += length
        assert sorted(fill) == list(range(plan.sequences - int(whole.sum())))


def hold_packed(rows, texts, window):
    by_row, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_row[r["row"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(by_row) == len(texts)
    left = Counter(texts)
    for pieces in by_row.values():
        pieces.sort(key=lambda r: r["start"])
        ids = b"".join(bytes(r["ids"]) for r in pieces)
        starts = np.cumsum([0, *[r["length"] for r in pieces]])
        assert [r["start"] for r in pieces] == starts[:-1].tolist() and {r["doc_tokens"] for r in pieces} == {len(ids) // 4}
        left[pieces[0]["doc_id"], ids] -= 1
    assert not +left and not -left
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
    assert sorted(by_sequence) == list(range(len(by_sequence)))


@pytest.mark.parametrize("window", [64, 4096])
def test_pack(docs, none, window):
    texts = Counter((r[0], np.asarray(ids_of(r[1]), "<u4").tobytes()) for r in awkward())
    found = packing.pack(docs, window).collect()
    assert sum(texts.values()) == len(awkward())
    hold_packed(found, list(texts.elements()), window)
    total = sum(r["length"] for r in found)
    assert total / (window * len({r["sequence_id"] for r in found})) > 0.95
    assert packing.pack(none, window).count() == 0


def test_pack_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in packing.op1_packing(spark, sf).collect():
        ids = ids_of(texts[r["doc_id"]])
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]])


# Quality ------------------------------------------------------------------------------------------------------------
def base_rules(text: str) -> tuple:
    found = words(text)
    n = len(found)
    windows = Counter(tuple(found[i : i + 3]) for i in range(n - 2))
    covered = {i + k for i in range(n - 2) if windows[tuple(found[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return n, sum(map(len, found)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def likelihood(texts: dict, good: set) -> dict:
    """Scores from counters over the same buckets."""
    mask = (1 << 64) - 1
    half = quality_rules.BUCKETS // 2
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def grams(text):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words(text)]
        pair = lambda a, b: xxhash.xxh64_intdigest((b).to_bytes(8, "little"), xxhash.xxh64_intdigest((a).to_bytes(8, "little"), 42))
        return [signed(x) % half for x in h] + [half + signed(pair(a & mask, b & mask)) % half for a, b in zip(h, h[1:])]  # noqa: B905

    every = {i: grams(t) for i, t in texts.items()}
    raw, trusted = Counter(), Counter()
    for i, g in every.items():
        raw.update(g)
        trusted.update(g if i in good else ())
    a, out = quality_rules.SMOOTHING, {}
    sums = [[sum(v for k, v in c.items() if (k >= half) == upper) for upper in (False, True)] for c in (trusted, raw)]
    for i, g in every.items():
        ratios = (np.log((trusted[b] + a) / (raw[b] * sums[0][b >= half] / sums[1][b >= half] + a)) for b in g)
        total = sum(max(-127, min(127, round(x / quality_rules.STEP))) for x in ratios) * quality_rules.STEP
        out[i] = total / max(1, len(g))
    return out


def test_quality_rules(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    found = {r["doc_id"]: r for r in quality_rules.op3_quality_rules(spark, sf).collect()}
    scores = likelihood(texts, good)
    assert set(found) == set(texts)
    for i, t in texts.items():
        r, own = found[i], base_rules(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == own
        assert r["score"] == pytest.approx(scores[i], abs=1e-9)
        assert r["kept"] == (not own[-1] and r["score"] >= quality_rules.LEAST)


def test_quality_rules_held_out(spark):
    """The fixed threshold on labels that the ratios were not fitted on."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet") for name in ("documents", "labels"))
    held = pu_quality.fold() == pu_quality.HELD_OUT
    model = quality_rules.fit(docs, labels.filter(~held))
    found = quality_rules.judge(docs.filter(held), model).join(labels, "doc_id").filter("not base_failed").groupBy("quality", "kept").count().collect()
    count = {(r["quality"], r["kept"]): r["count"] for r in found}
    share = lambda quality: count.get((quality, True), 0) / sum(n for (q, _), n in count.items() if q == quality)
    assert sum(count.values()) > 700 and share(1) > 0.99 and share(0) < 0.05, count


def test_more_buckets(spark, sf):
    assert [quality_rules.buckets_for(n) for n in (0, 200_000, 300_000, 10**9)] == [1 << 16, 1 << 16, 1 << 17, 1 << 20]
    docs, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    model = quality_rules.fit(docs, labels, 1 << 18)
    assert len(model) == 1 << 18 and quality_rules.judge(docs, model).filter("kept").count() > 0


def test_quality_rules_awkward(spark, folder, texts, docs, none):
    for r in quality_rules.op3_quality_rules(spark, folder).collect():
        if r["doc_id"] in texts:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base_rules(texts[r["doc_id"]])
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_rules.fit(docs, no_labels)
    assert set(model) == {0} and quality_rules.judge(docs, model).filter("kept <> (not base_failed)").count() == 0
    assert quality_rules.judge(none, quality_rules.fit(none, no_labels)).count() == 0


def test_quality_classifier_held_out(spark):
    """Held-out accuracy, labels of bad documents unseen."""
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = pu_quality.op2_pu_quality(spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in held) / len(held) > 0.95


def test_risk_and_prior():
    chance = np.random.default_rng(0)
    good, bad = chance.normal(1.5, 1, (4000, 2)), chance.normal(-1.5, 1, (4000, 2))
    u = np.concatenate([good[:2100], bad[:900]])
    assert pu_quality.estimate_prior(good[2100:], u) == pytest.approx(0.7, abs=0.05)
    w = pu_quality.fit_risk(good[2100:], u, 0.7)
    hit = lambda x: x @ w[:-1] + w[-1] > 0
    assert hit(good).mean() > 0.97 and hit(bad[900:]).mean() < 0.2  # the exact minimum of this sample has 0.09


def test_quality_classifier_awkward(spark, folder, docs, none):
    found = pu_quality.op2_pu_quality(spark, folder).collect()
    assert len(found) == len(awkward()) and all(0 <= r["score"] <= 1 for r in found)
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    vectors = pu_quality.vectors(docs).cache()
    model = pu_quality.learn(vectors, no_labels)
    assert {r["score"] for r in pu_quality.score(vectors, model).collect()} == {0.5} and pu_quality.score(pu_quality.vectors(none), model).count() == 0
    assert pu_quality.learn(pu_quality.vectors(none), spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")).prior == 0.5


# Mixing -------------------------------------------------------------------------------------------------------------
def test_rake_meets_targets(docs):
    cells = [(s, lang, t) for s in "ab" for lang in ("x", None) for t in (0, 1, -1)]
    counts = np.random.default_rng(2).integers(1, 100, len(cells)).astype(float)
    targets = mixing.Targets(source={"a": 3, "b": 1}, lang={"x": 1, None: 1}, topic={0: 1, 1: 2, -1: 1})
    fitted = mixing.rake(cells, counts, targets)
    share = lambda d, v: sum(f for c, f in zip(cells, fitted, strict=True) if c[d] == v) / fitted.sum()
    assert [share(0, "a"), share(1, None), share(2, 1)] == pytest.approx([0.75, 0.5, 0.5])
    weight, chance = mixing.probabilities(counts, fitted, 0.5)
    assert (chance * counts).sum() == pytest.approx(counts.sum() / 2) and chance.max() <= 1
    assert mixing.rake(cells, counts * 0, targets).sum() == 0


def hold_marginals(found, dimensions):
    for d in dimensions:
        own, fitted = Counter(), Counter()
        for r in found:
            own[r[d]] += r["tokens"]
            fitted[r[d]] += r["tokens"] * r["weight"]
        goal = {v: n**mixing.TEMPER for v, n in own.items() if n}
        assert {v: fitted[v] / sum(fitted.values()) for v in goal} == pytest.approx({v: g / sum(goal.values()) for v, g in goal.items()}, abs=1e-4)


def test_weigh_and_mix_agree(spark, docs, none):
    found = mixing.weigh(docs).collect()
    texts = sorted((r[0] is None, r[0] or 0, len(words(r[1] or ""))) for r in awkward())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["tokens"]) for r in found) == texts
    kept = mixing.mix(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in found if r["kept"])
    hold_marginals(found, ["topic"])  # a topic holds one language here or there, so that the others cannot all be met
    assert mixing.weigh(none).count() == 0 and mixing.mix(none).count() == 0
    only = mixing.weigh(docs, mixing.Targets(source={"s": 1.0}))
    assert only.filter("kept and (source is null or source <> 's')").count() == 0


def test_topics_of_a_planted_corpus(spark):
    """Themes inside languages are found: nearly all documents of a topic are of one theme, whatever their language."""
    chance = random.Random(9)
    def word(lang, theme):
        return f"{lang}{theme}{chance.randint(0, 60):03}longword"
    rows = []
    for i in range(1600):
        lang, theme = chance.choice(["en", "fr"]), i % 4
        own = [word(lang, theme) if chance.random() < 0.5 else word(lang, "common") for _ in range(120)]
        rows.append((i, " ".join(own), lang, chance.choice("stt")))
    made = mixing.weigh(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)).collect()
    hold_marginals(made, ["source", "lang", "topic"])
    found = {r["doc_id"]: r["topic"] for r in made}
    by_topic = defaultdict(Counter)
    for i, (_, _, lang, _) in enumerate(rows):
        by_topic[found[i]][lang, i % 4] += 1
    pure = sum(max(sum(n for (_, theme), n in own.items() if theme == t) for t in range(4)) for own in by_topic.values()) / len(rows)
    assert pure > 0.9 and len(by_topic) >= 4


def test_topics_draw_and_cells(spark, docs):
    """Topics, cells, weights and draws against counters, and the same topic for a text in batches of any size."""
    counted = mixing.count_words(docs).cache()
    topics = mixing.fit_topics(counted, rounds=4)
    rows = [(r["doc_id"], r["text"] or "", r["lang"], r["source"]) for r in docs.collect()]
    def own(text, lang):
        found = [zlib.crc32(w.encode()) % mixing.WIDTH for w in text.split() if len(w.encode()) >= 6]
        if not found:
            return -1
        counts = Counter(found)
        shares = topics.shares[mixing._group(lang)]
        vector = [math.sqrt(counts[k]) - math.sqrt(len(found) * shares[k]) for k in range(mixing.WIDTH)]
        near = topics.directions @ np.array(vector)
        return int(near.argmax()) if np.sort(near)[-1] - np.sort(near)[-2] > 1e-3 * mixing.SCALE else None
    got = Counter((r["doc_id"], r["lang"], r["topic"]) for r in mixing.assign(counted, topics).collect())
    assert got == Counter((r["doc_id"], r["lang"], r["topic"]) for r in mixing.assign(counted.repartition(29), topics).collect())
    by_id = {r["doc_id"]: r["topic"] for r in mixing.assign(counted, topics).collect()}
    checked = [(i, own(t.replace("\x0b", " "), lang)) for i, t, lang, _ in rows if i not in (None, 1008) and t.isascii()]
    assert all(t is None or by_id[i] == t for i, t in checked) and sum(t is not None for _, t in checked) > 200
    found = mixing.weigh(docs).collect()
    cells = Counter()
    for r in found:
        cells[r["source"], r["lang"], r["topic"]] += r["tokens"]
    keys = sorted(cells, key=lambda c: tuple(map(str, c)))
    tokens = np.array([cells[c] for c in keys], float)
    weight, chance = mixing.probabilities(tokens, mixing.rake(keys, tokens, mixing.Targets()), mixing.KEEP)
    expected = {c: (w, p) for c, w, p in zip(keys, weight, chance, strict=True)}
    signed = lambda x: x + (1 << 64) if x < 0 else x
    draw = {r["doc_id"]: (signed(r["h"]) >> 11) / 2**53 for r in docs.select("doc_id", F.xxhash64(F.lit(7), "doc_id").alias("h")).collect()}
    for r in found:
        w, p = expected[r["source"], r["lang"], r["topic"]]
        assert (r["weight"], r["probability"]) == pytest.approx((w, p)) and r["kept"] == (draw[r["doc_id"]] < r["probability"])


def test_too_many_cells(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_CELLS", 3)
    docs = spark.createDataFrame([(i, "some longer words here", "en", f"s{i}") for i in range(9)], "doc_id long, text string, lang string, source string")
    with pytest.raises(ValueError, match="coarser"):
        mixing.weigh(docs)


# Chat ---------------------------------------------------------------------------------------------------------------
def test_chat_sql(spark, sf):
    compare(spark, sf, chat_format.op6_chat_format, chat_format.ORACLES["op6_chat_format"])


def test_chat_awkward(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "<|im_end|>"), (1, 2, "assistant", "<\\|x<|y\\<|"), (2, 0, "assistant", "first"), (3, 0, "user", None), (3, 1, "assistant", ""), (4, 0, None, "x"), (5, 0, "a\nb\\nc\\", "odd|role"), (6, 1, "user", "b"), (6, 1, "user", "a"), (6, None, "user", "z"), (None, 0, "user", "no id"), (7, 0, "user", "long " * 50_000)]
    data = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, segments string, valid int")
    found = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_conversations(data)).collect()}
    turns = lambda i: [(t["role"], t["text"]) for t in found[i]["turns"]]
    assert turns(1) == [("system", "s"), ("user", "<|im_end|>"), ("assistant", "<\\|x<|y\\<|")]
    assert {i: r["valid"] for i, r in found.items()} == {1: True, 2: False, 3: True, 4: False, 5: False, 6: False, None: False, 7: False}
    assert turns(3) == [("user", ""), ("assistant", "")] and turns(4) == [("", "x")] and turns(5) == [("a\nb\\nc\\", "odd|role")]
    assert turns(6) == [("user", "z"), ("user", "a"), ("user", "b")] and turns(None) == [("user", "no id")] and turns(7) == [("user", "long " * 50_000)]
    assert found[1]["loss_texts"] == ["<\\|x<|y\\<|"] and found[2]["loss_texts"] == ["first"] and found[7]["loss_texts"] == []
    assert "<|" not in found[1]["text"].replace("<|im_start|>", "").replace("<|im_end|>\n", "")
    assert chat_format.read_back(chat_format.format_conversations(data.limit(0))).count() == 0


# Pipeline -----------------------------------------------------------------------------------------------------------
def test_pipeline(spark, sf, folder, none, tmp_path):
    import corpus_pipeline as pipeline

    assert [name for name, _ in pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {r["doc_id"]: r["text"] for r in docs.collect()}
    for number, (_, stage) in enumerate(pipeline.STAGES):
        out, before = str(tmp_path / str(number)), docs
        stage(spark, docs, sf).write.parquet(out)
        docs = spark.read.parquet(out)
        own = {r["doc_id"] for r in docs.collect()}
        assert own <= set(seen) and own
        if number < 4:
            assert docs.columns == before.columns
            seen = {i: seen[i] for i in own}
            if number == 0:
                rules = {i: base_rules(t or "") for i, t in seen.items()}
                assert not any(r[-1] for r in rules.values())
            if number == 1:
                assert len({re.sub(SPACES, "", t or "") for t in seen.values()}) == len(seen)
            if number == 2:
                every = {r["doc_id"]: shingles(r["text"] or "") for r in before.collect()}
                assert not any(jaccard(every[i], every[j]) >= 0.88 for i, j in combinations(seen, 2))
                assert all(max(jaccard(x, every[j]) for j in every if j != i) >= 0.72 for i, x in every.items() if i not in seen)
        else:
            assert own == set(seen)
    assert pipeline.run(spark, sf).count() == docs.count()
    awkward_docs = spark.createDataFrame(awkward() + [row(i, " ".join(f"w{i}x{k}" for k in range(60))) for i in range(2000, 2010)], SCHEMA)
    for start in (awkward_docs, none):
        docs = start
        for number, (_, stage) in enumerate(pipeline.STAGES):
            docs = stage(spark, docs, folder)
            assert number == 4 or docs.columns == start.columns
        assert (docs.count() > 0) == (start is awkward_docs)
