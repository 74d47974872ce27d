"""Token-ID output in a block-compressed file format (patched frame of reference).

A shard is one self-contained byte string, about ``shard_ids`` ids of consecutive documents:

    header     magic "PFR1", block length, numbers of documents, ids, blocks and exceptions
    documents  doc_id (int64), is-null flag (uint8), end position of each document in the shard (int64)
    blocks     minimum (uint32), width (uint8), first payload word (int64), first exception (int64)
    payload    per block: values minus the block's minimum, ``width`` bits each, packed into uint64 words
    exceptions position in the block (uint8) and full difference (uint32) of values too wide for their block

A block's width is the bit length of its ``percentile``-th difference, so the widest few become exceptions, and the
index of block starts lets a reader decode one document without the rest. Shards are rows of a Parquet table in the
shared folder, because executors reach no common local file system; ``write_shards`` copies none of them to the driver.

Edge cases: a null or empty text is one end id; a document longer than a shard is a shard of its own; documents with
equal or null doc_id keep separate entries, null first, ties by text; an empty table gives an empty result; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from morphlake.llm.common import Stored, clean_text, store, table
from morphlake.llm.tokens import END_ID, encode_texts, encoder, vocabulary_path

BLOCK = 128
PERCENTILE = 0.9
SHARD_IDS = 1 << 20
_MAGIC = 0x31524650
_HEAD = np.dtype([("magic", "<u4"), ("block", "<u4"), ("docs", "<i8"), ("ids", "<i8"), ("blocks", "<i8"), ("exceptions", "<i8"), ("words", "<i8")])


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def encode_shard(ids: np.ndarray, doc_ids: list[int | None], ends: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    grid = np.empty(blocks * BLOCK, np.uint32)
    grid[:n] = ids
    if n:
        grid[n:] = ids[-1]
    grid = grid.reshape(blocks, BLOCK)
    low = grid.min(axis=1) if blocks else np.zeros(0, np.uint32)
    diff = grid - low[:, None]
    at = min(BLOCK - 1, int(BLOCK * percentile))
    width = _bit_length(np.partition(diff, at, axis=1)[:, at]) if blocks else np.zeros(0, np.int64)
    words = width * (BLOCK // 64)
    starts = np.concatenate([[0], np.cumsum(words)]).astype(np.int64)
    wide = (diff.astype(np.uint64) >> width.astype(np.uint64)[:, None]) > 0
    rows, where = np.nonzero(wide)
    exceptions = np.concatenate([[0], np.cumsum(wide.sum(axis=1))]).astype(np.int64)
    values = diff[rows, where].astype("<u4")
    payload = np.zeros(int(starts[-1]), np.uint64)
    kept = np.where(wide, 0, diff).astype(np.uint64)
    for w in np.unique(width[width > 0]):
        own = np.nonzero(width == w)[0]
        part, out = np.ascontiguousarray(kept[own].T), np.zeros((int(w) * BLOCK // 64, len(own)), np.uint64)
        for i in range(BLOCK):
            word, shift = divmod(i * int(w), 64)
            out[word] |= part[i] << np.uint64(shift)
            if shift + w > 64:
                out[word + 1] |= part[i] >> np.uint64(64 - shift)
        payload[(starts[own][:, None] + np.arange(out.shape[0])[None, :]).ravel()] = out.T.ravel()
    head = np.array([(_MAGIC, BLOCK, len(doc_ids), n, blocks, len(values), len(payload))], _HEAD)
    null = np.array([d is None for d in doc_ids], np.uint8)
    keys = np.array([d or 0 for d in doc_ids], "<i8")
    parts = (head, keys, null, ends.astype("<i8"), low.astype("<u4"), width.astype(np.uint8), starts.astype("<i8"), exceptions.astype("<i8"), payload.astype("<u8"), where.astype(np.uint8), values)
    return b"".join(x.tobytes() for x in parts)


class Shard:
    """A reader of one shard; ``ids(first, last)`` decodes only the blocks that hold these positions."""

    def __init__(self, data: bytes):
        self._data, self._at = data, 0
        head = self._take(_HEAD, 1)[0]
        if head["magic"] != _MAGIC or head["block"] != BLOCK:
            raise ValueError("not a shard of this format")
        docs, self.n_ids, blocks = int(head["docs"]), int(head["ids"]), int(head["blocks"])
        keys, null = self._take("<i8", docs), self._take("u1", docs)
        self.doc_ids = [None if x else int(k) for k, x in zip(keys, null, strict=True)]
        self.ends = self._take("<i8", docs)
        self._low, self._width = self._take("<u4", blocks), self._take("u1", blocks).astype(np.int64)
        self._starts, self._exceptions = self._take("<i8", blocks + 1), self._take("<i8", blocks + 1)
        self._payload = self._take("<u8", int(head["words"]))
        self._where, self._values = self._take("u1", int(head["exceptions"])), self._take("<u4", int(head["exceptions"]))

    def _take(self, kind, count: int) -> np.ndarray:
        out = np.frombuffer(self._data, kind, count, self._at)
        self._at += out.nbytes
        return out

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        last = self.n_ids if last is None else last
        if last <= first:
            return np.zeros(0, np.uint32)
        b0, b1 = first // BLOCK, -(-last // BLOCK)
        width, out = self._width[b0:b1], np.zeros((b1 - b0, BLOCK), np.uint32)
        for w in np.unique(width[width > 0]):
            own = np.nonzero(width == w)[0]
            n = int(w) * BLOCK // 64
            words = np.ascontiguousarray(self._payload[self._starts[b0 + own][:, None] + np.arange(n)[None, :]].T)
            part, mask = np.empty((BLOCK, len(own)), np.uint32), np.uint64((1 << int(w)) - 1)
            for i in range(BLOCK):
                word, shift = divmod(i * int(w), 64)
                x = words[word] >> np.uint64(shift)
                if shift + w > 64:
                    x = x | (words[word + 1] << np.uint64(64 - shift))
                part[i] = x & mask
            out[own] = part.T
        e0, e1 = self._exceptions[b0], self._exceptions[b1]
        rows = np.repeat(np.arange(b1 - b0), np.diff(self._exceptions[b0 : b1 + 1]))
        out[rows, self._where[e0:e1]] = self._values[e0:e1]
        out += self._low[b0:b1, None]
        return out.ravel()[first - b0 * BLOCK : last - b0 * BLOCK]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


_SHARDS = "part int, shard int, n_docs long, n_ids long, data binary"


def _shards(path: str, end_id: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, shard = encoder(path), TaskContext.get().partitionId(), 0
        keys, pieces, size = [], [], 0

        def flush() -> pa.RecordBatch:
            row = [[part], [shard], [len(keys)], [size], [encode_shard(np.concatenate(pieces), keys, np.cumsum([len(p) for p in pieces]))]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "shard", "n_docs", "n_ids", "data"])

        for batch in batches:
            own = batch.column("doc_id").to_pylist()
            for first, ids, ends in encode_texts(batch.column("text"), words, end_id):
                for key, a, b in zip(own[first:], [0, *ends.tolist()], ends.tolist()):  # noqa: B905  own is longer
                    if keys and size + b - a > shard_ids:
                        yield flush()
                        keys, pieces, size, shard = [], [], 0, shard + 1
                    keys.append(key)
                    pieces.append(ids[a:b].copy())
                    size += b - a
        if keys:
            yield flush()

    return run


def write_shards(docs: DataFrame, path: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> Stored:
    """Encodes whole documents and writes shards in ascending doc_id order: by part, then by shard.

    One range exchange deals out the texts. A task holds one shard at a time, never all its documents.
    """
    docs = docs.select("doc_id", clean_text().alias("text"))
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return store(ordered.mapInArrow(_shards(path or vocabulary_path(), end_id, shard_ids), _SHARDS), "shards")


_DOCS = "part int, shard int, doc_id long, first long, ids_crc32 long, n_tokens long, ids binary"


def _documents(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, data in zip(batch.column("part").to_pylist(), batch.column("shard").to_pylist(), batch.column("data"), strict=True):
                read = Shard(data.as_py())
                raw, ends = memoryview(read.ids().astype("<u4").tobytes()), read.ends.tolist()
                firsts = [0, *ends[:-1]]
                own = [raw[4 * a : 4 * b] for a, b in zip(firsts, ends, strict=True)]
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([shard] * n, pa.int32()), pa.array(read.doc_ids, pa.int64()), pa.array(firsts, pa.int64()), pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array([len(x) // 4 for x in own], pa.int64()), pa.array([x.tobytes() if with_ids else None for x in own], pa.binary())],
                    ["part", "shard", "doc_id", "first", "ids_crc32", "n_tokens", "ids"],
                )

    return run


def read_shards(shards: DataFrame, with_ids: bool = True) -> DataFrame:
    """Documents back from shards: doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, if asked, ids.

    Starts come from sums by part (a row a task of the writer) and, within a part, over its shards.
    """
    sizes = shards.select("part", "shard", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    own = sizes.withColumn("inside", F.sum("n_ids").over(W.partitionBy("part").orderBy("shard")) - F.col("n_ids"))
    starts = own.join(parts, "part").select("part", "shard", (F.col("before") + F.col("inside")).alias("base"))
    found = shards.select("part", "shard", "data").mapInArrow(_documents(with_ids), _DOCS).join(starts, ["part", "shard"])
    columns = ["doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"]
    return found.select(*columns, *["ids"] * with_ids)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(table(spark, sf_dir, "documents")).df, with_ids=False)


QUERIES = {"op10_token_files": op10_token_files}
ORACLES: dict[str, str] = {}
