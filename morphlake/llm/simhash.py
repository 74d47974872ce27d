"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits, each set if it is set in over half of the XXH64 hashes (seed 42) of the text's three-word
shingles, repeats included, ASCII letters in lower case. Fingerprints link at three or fewer differing bits.

Each fingerprint is cut into two segments of 32 bits. If two differ in at most three bits, one segment differs in at
most one, so a fingerprint is filed under both segments and probes, for each, the segment itself and the segment with
one of its set bits cleared: of two segments that differ in one bit, exactly one reaches the other so. What is met is
verified over all 64 bits. Only distinct fingerprints take part, so copies cost nothing.

A segment under which more than ``crowd`` distinct fingerprints are filed would make the square of their number; its
links come from stars instead. Every member names all values of the other segment near its own, and members that name
one value are tied to the least of them: values within one bit of both sides for a distance of two, within one bit of
one side and two of the other for three. The stars hold links alone and join all that are linked, in rows
proportional to the members.

``similar`` does the same for a similarity of five-word shingles: fingerprints of ``bits`` bits, over the set of a text's
shingles, differ in a share acos(2 J / (1 + J)) / pi of their bits at Jaccard similarity J, and texts link where the
complete distance is at most that share at ``similarity``. Segments are eight bits wider than the logarithm of the number
of distinct fingerprints, so chance candidates stay a few a text at any size; pairs at the threshold share a segment
within one bit with a probability that ``found_share`` gives (at 200,000 texts 0.91, and 0.99 for a similarity of 0.87), closer ones nearly always. A
segment's members are compared where they lie together and come out as edges to the smallest one linked, so a family of
many near copies, or of texts that are alike below the threshold, costs rows in proportion to its members. In a segment with
more than ``crowd`` filed members the first ``crowd``, others in every segment, meet all, and the rest meet within ``crowd``
places; a second pass then compares every two that are not in one component yet, a ``block`` of members against all others
at a time. So no link between two that meet in a segment is lost; that pass costs time with the square of the members of
a segment's different components, and rows with that square over ``block``.

Edge cases: null text is empty; texts without words have fingerprint zero and link like any other; texts of fewer words
than a shingle are one shingle; rows that repeat a doc_id are rows of their own; a null doc_id names a component only if
it has no other; empty tables give empty results; other columns pass through ``keep_one``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.llm.common import clean_text, free, small, store, table, trim
from morphlake.llm.components import roots

SHINGLE = 3
SEED = 42
CROWD = 1_024
_STEP = 1 << 16
_LOW = 0xFFFFFFFF


def _shingles(text: bytes | None, size: int) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, in steps of a fixed number."""
    from xxhash import xxh64_intdigest

    found = (text or b"").lower().split()
    for at in range(0, max(1, len(found) - size + 1) if found else 0, _STEP):
        part = found[at : at + _STEP + size - 1]
        shingles = [b" ".join(part)] if len(found) < size else map(b" ".join, zip(*[part[k:] for k in range(size)]))
        yield np.array([xxh64_intdigest(s, SEED) for s in shingles], "<u8")


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits set; 128 rows of bytes at a time are added as bytes."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 128 * 128
    total = bits[:whole].reshape(-1, 128, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return total + bits[whole:].sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text; long texts go through in steps of a fixed number of shingles."""
    count, total = 0, np.zeros(64, np.int64)
    for hashes in _shingles(text, size):
        count, total = count + len(hashes), total + _ones(hashes)
    return int(np.packbits(2 * total > count, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [fingerprint(text.as_py()) for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.int64())], ["doc_id", "fp"])
        trim()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", clean_text().cast("binary").alias("text")).mapInArrow(_fingerprints, f"doc_id {id_type}, fp long")


def _segments() -> Column:
    """(segment number, its bits, the other bits)"""
    low, high = F.col("fp").bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned("fp", 32)
    return F.array(F.struct(F.lit(0).cast("long").alias("no"), low.alias("own"), high.alias("other")), F.struct(F.lit(1).cast("long").alias("no"), high.alias("own"), low.alias("other")))


def _key(no: Column, own: Column) -> Column:
    return F.shiftleft(no, 32).bitwiseOR(own)


def _half_ball(own: Column) -> Column:
    """The segment itself and the segment with one of its set bits cleared."""
    bits = F.array(*[F.lit(1 << i).cast("long") for i in range(32)])
    return F.concat(F.array(own), F.transform(F.filter(bits, lambda b: own.bitwiseAND(b) != 0), lambda b: own.bitwiseXOR(b)))


def _met(filed: DataFrame, probes: DataFrame) -> DataFrame:
    pairs = filed.select("key", F.col("fp").alias("a")).join(probes.select("key", F.col("fp").alias("b")), "key")
    return pairs.filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 3)).select("a", "b")


def _masks(most: int) -> Column:
    values = [sum(1 << i for i in bits) for r in range(most + 1) for bits in combinations(range(32), r)]
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _stars(members: DataFrame) -> DataFrame:
    """Links of crowded segments. members: key (the crowded one), fp, bit (the probe's cleared bit, -1: none), other."""
    named = ["key", "bit"]
    centre = F.explode(F.transform(_masks(1), lambda m: F.col("other").bitwiseXOR(m))).alias("value")
    near = members.select(*named, "fp", centre)
    least = near.groupBy(*named, "value").agg(F.min("fp").alias("b"))
    far_value = F.explode(F.transform(_masks(2), lambda m: F.col("other").bitwiseXOR(m))).alias("value")
    far = members.filter("bit = -1").select(*named, F.col("fp").alias("a"), far_value)
    tied = near.filter("bit >= 0").withColumnRenamed("fp", "a").unionByName(far)
    return tied.join(least, [*named, "value"]).select("a", "b")


def links(nodes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that have the components of all links at three bits or fewer."""
    cut = nodes.select("fp", F.explode(_segments()).alias("s")).select("fp", "s.*")
    filed = cut.select(_key(F.col("no"), F.col("own")).alias("key"), "fp", "other")
    ball = F.explode(F.transform(_half_ball(F.col("own")), lambda v: F.struct(_key(F.col("no"), v).alias("key"), F.col("own").bitwiseXOR(v).alias("flipped"))))
    probes = cut.select("fp", "other", ball.alias("p")).select("fp", "other", "p.*")
    sizes = filed.select("key", F.lit(1).alias("n")).unionByName(probes.select("key", F.lit(0).alias("n"))).groupBy("key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("all"))
    crowded = store(sizes.filter((F.col("n") > 0) & (F.col("all") > 2 * crowd)).select("key"), "crowded").df
    if not crowded.limit(1).count():
        return _met(filed, probes)
    bit = F.when(F.col("flipped") == 0, -1).otherwise(F.log2(F.col("flipped").cast("double")).cast("int"))
    reached = probes.join(crowded, "key", "left_semi").select("key", "fp", "other", bit.alias("bit"))
    bits = reached.filter("bit >= 0").select("key", "bit").distinct()
    members = reached.unionByName(filed.join(crowded, "key", "left_semi").join(bits, "key").select("key", "fp", "other", "bit"))
    plain = _met(filed.join(crowded, "key", "left_anti"), probes.join(crowded, "key", "left_anti"))
    return plain.unionByName(_stars(members))


def near_duplicates(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reached over links) for every row."""
    found = store(fingerprints(docs), "fingerprints").df
    nodes = store(found.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes").df
    root = roots(links(nodes.select("fp"), crowd))
    return _named(found, nodes, root, "fp").select("doc_id", "fp", "component_id")


# Similar texts ------------------------------------------------------------------------------------------------------
SIMILARITY, SIMILAR_SHINGLE, BITS = 0.8, 5, 768
SIMILAR_CROWD = 512
#: Members of a crowded segment that are held while the others pass, and how many pass at a time.
BLOCK, _PASS = 8_192, 256
#: Parts that a component's members are dealt to where they meet its smallest doc_id.
SALTS = 16
#: Segments whose entries are dealt out in one job.
SEGMENTS_A_JOB = 8


def differing_share(similarity: float) -> float:
    """The share of bits in which fingerprints of two sets of about one size differ on average."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def segment_width(nodes: int) -> int:
    return min(40, max(16, math.ceil(math.log2(max(2, nodes))) + 8))


def found_share(similarity: float, nodes: int, bits: int = BITS) -> float:
    """The probability that two texts of that similarity meet in a segment."""
    p, width = differing_share(similarity), segment_width(nodes)
    one = (1 - p) ** width + width * p * (1 - p) ** (width - 1)
    return 1 - (1 - one) ** (bits // width)


_FACTOR = 0x9E3779B97F4A7C15


def _finished(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, wrapping."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, size: int = SIMILAR_SHINGLE) -> np.ndarray:
    """64-bit hashes of a text's different shingles, made of its words' hashes; a shorter text is one shingle."""
    from xxhash import xxh64_intdigest

    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    words = np.array([xxh64_intdigest(w, SEED) for w in found], np.uint64)
    size = min(size, len(words))
    total = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        total = total * np.uint64(_FACTOR) + words[k : len(words) - size + 1 + k]
    return np.unique(_finished(total + np.uint64(size)))


def _column_ones(x: np.ndarray) -> np.ndarray:
    """For each column of 64-bit numbers how many have each bit set: three rows are added, bit by bit, to a sum row and a
    carry row of twice the weight, until few rows are left."""

    def counted(rows: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
        return bits.reshape(len(rows), -1, 64).sum(axis=0, dtype=np.int64)

    total, weight = np.zeros((x.shape[1], 64), np.int64), 0
    while len(x) >= 24:
        carries = []
        while len(x) >= 3:
            n = len(x) // 3
            a, b, c = x[:n], x[n : 2 * n], x[2 * n : 3 * n]
            odd = a ^ b
            carries.append((a & b) | (odd & c))
            x = np.concatenate([odd ^ c, x[3 * n :]])
        total += counted(x) << weight
        x, weight = np.concatenate(carries), weight + 1
    return total + (counted(x) << weight)


def wide_fingerprint(text: bytes | None, size: int = SIMILAR_SHINGLE, bits: int = BITS) -> bytes:
    """The bits set in over half of the hashes of a text's different shingles; each hash is carried on to ``bits`` bits."""
    own = shingle_set(text, size)
    carried = np.arange(bits // 64, dtype=np.uint64) * np.uint64(_FACTOR)
    total = np.zeros((bits // 64, 64), np.int64)
    for at in range(0, len(own), _STEP // 8):
        total += _column_ones(_finished(own[at : at + _STEP // 8, None] + carried))
    return np.packbits(2 * total > len(own), axis=1, bitorder="little").tobytes()


def wide_fingerprints(docs: DataFrame, size: int = SIMILAR_SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, words: the fingerprint as an array of 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.frombuffer(b"".join(wide_fingerprint(t.as_py(), size, bits) for t in batch.column("text")), "<i8")
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * (bits // 64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "words"])
            trim()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", clean_text().cast("binary").alias("text")).mapInArrow(run, f"doc_id {id_type}, words array<bigint>")


def _entries(numbers: range, width: int):
    """A row a fingerprint and probe of these segments: key (twice the segment's number and value, odd for a probe) and node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node").to_numpy()
            words = _matrix(batch)
            for no in numbers:
                word, shift = divmod(no * width, 64)
                own = words[:, word] >> np.uint64(shift)
                if shift + width > 64:
                    own = own | (words[:, word + 1] << np.uint64(64 - shift))
                own = own & np.uint64((1 << width) - 1)
                keys, nodes = [own * np.uint64(2)], [node]
                for bit in range(width):
                    has = (own >> np.uint64(bit)) & np.uint64(1) > 0
                    keys.append((own[has] - np.uint64(1 << bit)) * np.uint64(2) + np.uint64(1))
                    nodes.append(node[has])
                key = np.concatenate(keys) + np.uint64(no << width + 1)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.concatenate(nodes))], ["key", "node"])

    return run


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The fingerprints of a batch, a row each."""
    return batch.column("words").flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries in order of key those that are not alone in a segment with a filed one; no row more than came in."""
    held, last, opened = (np.zeros(0, np.int64), np.zeros(0, np.int64)), -1, False  # a segment's first entry until a second is met
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node = (np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("key", "node"), strict=True))
        group = key >> 1
        begins = np.r_[group[0] != last, group[1:] != group[:-1]]
        first = np.maximum.accumulate(np.where(begins, np.arange(len(key)), -1))
        filed = np.where(first >= 0, key[first] & 1 == 0, opened)
        met = filed & (~begins | np.r_[group[1:] == group[:-1], False])
        yield pa.RecordBatch.from_arrays([pa.array(key[met]), pa.array(node[met])], ["key", "node"])
        alone = bool(begins[-1])
        held = (key[-1:], node[-1:]) if alone else (key[:0], node[:0])
        last, opened = (-1 if alone else group[-1]), bool(filed[-1])


def _linked(most: int, crowd: int):
    """From entries with fingerprints, in order of key, to edges (a, b): a node and the smallest one that links reach from it
    among the entries at hand. A filed entry meets all entries within ``crowd`` places, and each of a segment's first
    ``crowd`` meets all others of it; complete distances decide. At most one edge an entry and batch comes out, and no more
    than a batch and ``crowd`` entries are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node, words = batch.column("key").to_numpy(), batch.column("node").to_numpy(), _matrix(batch)
            if held:
                key, node, words = (np.concatenate(x) for x in zip(held, (key, node, words), strict=True))
            place = np.arange(len(key))
            starts = np.nonzero(np.r_[True, (key[1:] >> 1) != (key[:-1] >> 1)])[0]
            sizes = np.diff(np.r_[starts, len(key)])
            first, end = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)
            reach = np.where(place - first < crowd, end, np.minimum(end, place + crowd))
            least, tied, step = node.copy(), [], 1

            def tie(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> None:
                low = np.minimum(least[a], least[b])
                np.minimum.at(least, a, low)
                np.minimum.at(least, b, low)

            i = place[key & 1 == 0]
            while len(i := i[i + step < reach[i]]):
                apart = i[least[i] != least[i + step]]
                near = apart[np.bitwise_count(words[apart] ^ words[apart + step]).sum(axis=1, dtype=np.int64) <= most]
                if len(near):
                    tie(near, near + step, least)
                    tied.append(np.stack([near, near + step]))
                step += 1
            if tied:
                a, b = np.concatenate(tied, axis=1)
                while (least[a] != least[b]).any():
                    tie(a, b, least)
            edges = np.unique(np.stack([least, node], axis=1)[least != node], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])
            held = tuple(x[starts[-1] :][:crowd] for x in (key, node, words))

    return run


def _across(most: int):
    """From entries in order of segment, block and lead, leads first, to edges (a, b) between the roots that links join:
    each lead meets every entry of its block if one of the two is filed and their roots are still apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, up, held = None, {}, None

        def top(x: int) -> int:
            while (above := up.get(x, x)) != x:
                up[x] = up.get(above, above)
                x = above
            return x

        def tops(labels: np.ndarray) -> np.ndarray:
            values, at = np.unique(labels, return_inverse=True)
            return np.array([top(v) for v in values.tolist()], np.int64)[at]

        for batch in batches:
            if not batch.num_rows:
                continue
            segment, block, root = (batch.column(c).to_numpy() for c in ("segment", "block", "root"))
            lead, filed = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("lead", "filed"))
            words, edges = _matrix(batch), []
            begins = np.nonzero(np.r_[True, (segment[1:] != segment[:-1]) | (block[1:] != block[:-1])])[0].tolist()
            for start, end in zip(begins, [*begins[1:], len(segment)], strict=True):
                if group != (group := (segment[start], block[start])):
                    up.clear()
                    held = (np.zeros((0, words.shape[1] * 64), np.float32), np.zeros(0, bool), np.zeros(0, np.int64))
                for at in range(start, end, _PASS):
                    rows = np.arange(at, min(end, at + _PASS))
                    signs = np.unpackbits(words[rows].view(np.uint8), axis=1).astype(np.float32) * 2 - 1
                    new = (signs, filed[rows], tops(root[rows]))
                    if lead[rows].any():
                        held = tuple(np.concatenate([h, x[lead[rows]]]) for h, x in zip(held, new, strict=True))
                    own, is_filed, label = held
                    if len(label) and (label == label[0]).all():
                        new = tuple(x[new[2] != label[0]] for x in new)
                    near = own @ new[0].T >= own.shape[1] - 2 * most  # the product is the number of bits less twice the distance
                    near &= (label[:, None] != new[2]) & (is_filed[:, None] | new[1])
                    if near.any():
                        i, j = np.nonzero(near)
                        for a, b in np.unique(np.stack([label[i], new[2][j]], axis=1), axis=0).tolist():
                            a, b = sorted((top(a), top(b)))
                            if a != b:
                                up[b] = a
                                edges.append((a, b))
                        held = (own, is_filed, tops(label))
            a, b = np.array(edges, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _crowded_links(met: DataFrame, nodes: DataFrame, links: DataFrame, most: int, crowd: int, block: int) -> DataFrame:
    """``links`` (a, b) of all entries ``met`` (key, node), completed for the segments with more than ``crowd`` filed ones."""
    filed, others = F.col("filed").cast("int"), (~F.col("filed")).cast("int")
    entries = met.select(F.shiftright("key", 1).alias("segment"), (F.col("key").bitwiseAND(F.lit(1)) == 0).alias("filed"), "node")
    crowded = store(entries.groupBy("segment").agg(F.sum(filed).alias("n")).filter(F.col("n") > crowd).select("segment"), "crowded")
    if not crowded.df.limit(1).count():
        crowded.drop()
        return links
    root = roots(links)
    inside = entries.join(small(crowded.df, 16), "segment").join(root, "node", "left").select("segment", "filed", "node", F.coalesce("root", "node").alias("root"))
    inside = store(inside, "inside").df
    parts = inside.groupBy("segment", "root").agg(F.sum(filed).alias("filed"), F.sum(others).alias("others"))
    sums = parts.groupBy("segment").agg(F.max(F.struct("filed", "root", "others")).alias("most"), F.sum("filed").alias("filed"), F.sum("others").alias("others"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # All filed entries lead; or, where those of the largest component outnumber the other components' probes, these in their place.
    probes = F.col("others") - F.col("most.others")
    swap, leads = probes < F.col("most.filed"), F.least(F.col("filed"), F.col("filed") - F.col("most.filed") + probes)
    plan = store(sums.select("segment", F.col("most.root").alias("largest"), swap.alias("swap"), F.ceil(leads / block).alias("blocks")), "plan").df
    dealt = inside.join(nodes, "node").join(small(plan, 64), "segment")
    dealt = dealt.withColumn("lead", F.when(F.col("root") == F.col("largest"), F.col("filed") & ~F.col("swap")).otherwise(F.col("filed") | F.col("swap")))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), "blocks")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("lead"), F.col("own")).otherwise(F.col("blocks") - 1))))
    dealt = dealt.select("segment", "block", (F.col("lead") & (F.col("block") == F.col("own"))).alias("lead"), "filed", "root", "words")
    dealt = dealt.repartition("segment", "block").sortWithinPartitions("segment", "block", F.desc("lead"))
    more = store(dealt.mapInArrow(_across(most), "a long, b long").distinct(), "links").df
    return root.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(more)


def similar_links(nodes: DataFrame, similarity: float = SIMILARITY, bits: int = BITS, crowd: int = SIMILAR_CROWD, block: int = BLOCK) -> DataFrame:
    """a, b: edges, from a stored table of node and words, that have the components of all links between fingerprints that meet
    in a segment. What is alone in its segments falls away before the fingerprints are brought to the rest, and no candidate
    pair is ever a row."""
    width = segment_width(nodes.count())
    count, most, segment = bits // width, math.floor(bits * differing_share(similarity)), F.shiftright("key", 1)
    jobs = [range(at, min(count, at + SEGMENTS_A_JOB)) for at in range(0, count, SEGMENTS_A_JOB)]
    entries = [nodes.select("node", "words").mapInArrow(_entries(numbers, width), "key long, node long") for numbers in jobs]
    shared = [store(e.repartition(segment).sortWithinPartitions("key").mapInArrow(_shared, "key long, node long"), "shared") for e in entries]
    entered = shared[0].df
    for more in shared[1:]:
        entered = entered.unionByName(more.df)
    prints = small(nodes.select("node", "words"), 16 + bits // 8)
    met = entered.join(prints, "node").select("key", "node", "words")
    dealt = met.repartition(segment).sortWithinPartitions("key", F.xxhash64(segment, "node"))
    links = _crowded_links(entered, prints, store(dealt.mapInArrow(_linked(most, crowd), "a long, b long").distinct(), "links").df, most, crowd, block)
    for part in shared:
        part.drop()
    return links


def similar(docs: DataFrame, similarity: float = SIMILARITY, size: int = SIMILAR_SHINGLE, bits: int = BITS, crowd: int = SIMILAR_CROWD) -> DataFrame:
    """doc_id, component_id (the smallest doc_id reached over links of similar texts) for every row."""
    found = store(wide_fingerprints(docs, size, bits).withColumn("node", F.xxhash64("words")), "wide")
    nodes = store(found.df.groupBy("node", "words").agg(F.min("doc_id").alias("first_id")), "nodes")
    root = roots(similar_links(nodes.df.select("node", "words"), similarity, bits, crowd))
    return _named(found.df.select("doc_id", "node"), nodes.df.select("node", "first_id"), root, "node").select("doc_id", "component_id")


def _named(found: DataFrame, nodes: DataFrame, root: DataFrame, key: str) -> DataFrame:
    """Every row with the smallest doc_id of its component."""
    salt = F.when(F.col("root").isNull(), 0).otherwise(F.pmod(F.xxhash64(nodes[key]), F.lit(SALTS)).cast("int"))
    tied = nodes.join(root, nodes[key] == root["node"], "left").select(nodes[key], "first_id", F.coalesce("root", nodes[key]).alias("root"), salt.alias("salt"))
    least = tied.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    every = F.when(F.col("n") > 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return found.join(store(tied.join(least.select("root", "component_id", F.explode(every).alias("salt")), ["root", "salt"]).select(key, "component_id"), "components").df, key)


def keep_one(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Of each component of ``found`` (doc_id, component_id; default ``near_duplicates``) the row with the smallest doc_id,
    with all its columns; what repeats its doc_id goes as well."""
    found = near_duplicates(docs) if found is None else found
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = store(found.groupBy("doc_id").agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("times")), "stays")
    odd_id, flag = free(docs.columns, "odd_id", "stays")
    odd = store(ids.df.filter("not stays or times > 1").select(F.col("doc_id").alias(odd_id), F.col("stays").alias(flag)), "odd").df
    ids.drop()
    same = F.col("doc_id").eqNullSafe(F.col(odd_id))
    rest = docs.join(small(odd.drop(flag), 64), same, "left_anti")
    if not odd.filter(flag).limit(1).count():
        return rest
    return rest.unionByName(docs.join(odd.filter(flag).drop(flag), same, "left_semi").dropDuplicates(["doc_id"]))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash": op8_simhash}
ORACLES: dict[str, str] = {}
