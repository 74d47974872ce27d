"""Whole texts lemmatized: by a join plan of any dictionary size, or by an Arrow plan for dictionaries that fit a worker.

Both plans give equal rows. The join plan deals texts out by key into chunks, joins each chunk's different tokens with the
dictionary and hands the rows found to the chunk. The Arrow plan exchanges nothing: every batch looks its different tokens
up once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.functions.text import NOT_SPACE, cut_text, lines_of, tokens_single_space, tokens_whitespace
from morphlake.operators.lookup import COLUMNAR, SINGLE_THREAD, Variant, lookup, sized

#: Dictionary rows that the Arrow plan gives every worker at most; beyond them ``plan="auto"`` joins.
ARROW_ROWS = 1_000_000
#: Bytes of text that a worker looks up at a time at most; a longer text is looked up alone.
SLICE_BYTES = 8 << 20
#: Bytes of text, about, whose different tokens the join plan looks up together.
CHUNK_BYTES = 16 << 20
TOKENIZERS = {"whitespace": tokens_whitespace, "single_space": tokens_single_space}


def explode_tokens(texts: DataFrame, keys: list[str], text: str = "text", tokenizer: str = "whitespace") -> DataFrame:
    """The keys, pos (from 0) and token. Null texts give no rows."""
    return texts.select(*keys, F.posexplode(TOKENIZERS[tokenizer](F.col(text))).alias("pos", "token"))


def spread(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Texts of fewer files than there are cores are dealt out by key, since one file may be one task; many files stay as
    they are. Files are listed, nothing is run."""
    wanted = texts.sparkSession.sparkContext.defaultParallelism
    return texts.repartition(wanted, *[F.col(k) for k in keys]) if 0 < len(texts.inputFiles()) < wanted else texts


def collected(dictionary: DataFrame, variant: Variant, most: int = ARROW_ROWS) -> pa.Table | None:
    """The dictionary in bytes, lemmas cut as the variant has them; None if it has more rows than that. Evaluated once."""
    lemma = F.col("lemma") if variant.lemma_bytes is None else cut_text(F.col("lemma"), variant.lemma_bytes)
    rows = dictionary.select(F.col("key").cast("binary").alias("key"), lemma.cast("binary").alias("lemma"))
    found = rows.limit(most + 1).toArrow()
    return found if found.num_rows <= most else None


def shared_map(spark: SparkSession, rows: pa.Table) -> Broadcast:
    """The dictionary as Arrow columns: its bytes and offsets, where a dict would have objects of some 200 bytes a row in every worker."""
    return spark.sparkContext.broadcast(rows.combine_chunks())


def sliced(batches: Iterator[pa.RecordBatch], at: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows in order, in batches of at most so many bytes of column ``at`` or one row: large ones are cut, small ones put together."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < batch.num_rows:
            before = int(ends[first - 1]) if first else 0
            last = int(np.searchsorted(ends, before + most - size, "right"))
            if last <= first and held:
                yield pa.concat_batches(held)
                held, size = [], 0
                continue
            last = max(last, first + 1)
            held.append(batch.slice(first, last - first))
            size += int(ends[last - 1]) - before
            first = last
    if held:
        yield pa.concat_batches(held)


def places(tokens: pa.Array, keys: pa.ChunkedArray) -> pa.Array:
    """Each token's row among the keys, null where it is none. The tokens, which are fewer and different, are hashed."""
    met = pc.fill_null(pc.index_in(keys, value_set=tokens), -1).to_numpy()
    rows = np.flatnonzero(met >= 0)
    found = np.full(len(tokens), -1, np.int64)
    found[met[rows]] = rows
    return pa.array(found, mask=found < 0)


def _prepared(texts: DataFrame, keys: list[str], text: str, tokenizer: str, variant: Variant, blank: bool) -> DataFrame:
    """The keys and the text as it is looked up; null texts and those without tokens go, or, with ``blank``, stay."""
    value = F.coalesce(text, F.lit("")) if blank else F.col(text)
    given = texts.select(*keys, (F.lower(value) if variant.lower else value).alias(text))
    return given.filter(F.regexp_like(text, F.lit(NOT_SPACE))) if tokenizer == "whitespace" and not blank else given


def _replaced(batch: pa.RecordBatch, rows: pa.Table, keys: list[str], tokenizer: str, variant: Variant, out: str, blank: bool) -> pa.RecordBatch:
    """The keys and the lemmas of the text behind them, joined by spaces. The rows' lemmas are cut already."""
    texts = batch.column(len(keys))
    pieces = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts)) if tokenizer == "whitespace" else pc.split_pattern(texts, " ")
    tokens = pieces.flatten().dictionary_encode()
    known = tokens.dictionary.cast(pa.binary())
    cut = known if variant.token_bytes is None else pc.binary_slice(known, 0, variant.token_bytes)
    slots = cut.dictionary_encode()
    at = places(slots.dictionary, rows["key"]).take(slots.indices)
    hits = rows["lemma"].take(at).combine_chunks()
    if variant.empty_is_miss:
        hits = pc.if_else(pc.fill_null(pc.equal(hits, b""), False), known, hits)
    lemmas, offsets = pc.coalesce(hits, cut).take(tokens.indices), pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
    if not variant.misses:
        kept = pc.is_valid(at).take(tokens.indices)
        lemmas, offsets = lemmas.filter(kept), np.append(0, np.cumsum(kept.to_numpy(zero_copy_only=False)))[offsets]
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), lemmas), b" ")
    if blank:
        bare = pc.equal(pc.binary_length(pc.ascii_trim_whitespace(texts)), 0)
        joined = pc.if_else(bare, pa.scalar(b"", joined.type), joined)
    made = pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], joined], [*keys, out])
    return made if variant.misses else made.filter(pa.array(np.diff(offsets) > 0))


def by_arrow(texts: DataFrame, shared: Broadcast, keys: list[str], text: str, tokenizer: str, variant: Variant, out: str, blank: bool = False) -> DataFrame:
    """The Arrow plan with a dictionary from ``shared_map``."""
    most = SLICE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, len(keys), most):
            yield _replaced(batch, shared.value, keys, tokenizer, variant, out, blank)

    given = _prepared(spread(texts if blank else texts.filter(F.col(text).isNotNull()), keys), keys, text, tokenizer, variant, blank)
    return given.mapInArrow(run, _kinds(given, keys, out)).withColumn(out, F.col(out).cast("string"))


def _kinds(given: DataFrame, keys: list[str], out: str) -> str:
    return ", ".join(f"`{k}` {given.schema[k].dataType.simpleString()}" for k in keys) + f", `{out}` binary"


def _by_join(texts: DataFrame, dictionary: DataFrame, keys: list[str], text: str, tokenizer: str, variant: Variant, out: str, blank: bool) -> DataFrame:
    """Texts are dealt out by key into chunks; a chunk's different tokens are joined with the dictionary, and its texts
    meet the rows found. So texts are exchanged once and no row is made for each token of each text."""
    spark = texts.sparkSession
    known = texts if blank else texts.filter(F.col(text).isNotNull())
    size = known.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunk = F.pmod(F.xxhash64(*keys), F.lit(max(size // CHUNK_BYTES + 1, spark.sparkContext.defaultParallelism)))
    given = _prepared(known, keys, text, tokenizer, variant, blank)
    dealt = given.repartition(chunk).select(chunk.alias("__chunk"), *keys, text)
    token = F.col("__token") if variant.token_bytes is None else cut_text(F.col("__token"), variant.token_bytes)
    tokens = dealt.select("__chunk", F.explode(F.array_distinct(TOKENIZERS[tokenizer](F.col(text)))).alias("__token")).select(F.col("__chunk").alias("__of"), token.alias("__token")).distinct()
    lemma = F.col("lemma") if variant.lemma_bytes is None else cut_text(F.col("lemma"), variant.lemma_bytes)
    rows = sized(dictionary).select(F.col("key").alias("__key"), lemma.alias("__lemma"))
    found = tokens.join(rows, F.col("__token") == F.col("__key")).select("__of", F.col("__key").cast("binary").alias("key"), F.col("__lemma").cast("binary").alias("lemma"))
    most = SLICE_BYTES

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        batches = sliced(iter(left.drop_columns("__chunk").to_batches()), len(keys), most)
        return pa.Table.from_batches([_replaced(batch, right, keys, tokenizer, variant, out, blank) for batch in batches])

    made = dealt.groupBy("__chunk").cogroup(found.groupBy("__of")).applyInArrow(run, _kinds(given, keys, out))
    return made.withColumn(out, F.col(out).cast("string"))


def lemmatize_texts(texts: DataFrame, dictionary: DataFrame, keys: list[str], text: str = "text", tokenizer: str = "whitespace", variant: Variant = SINGLE_THREAD, plan: str = "auto", out: str = "lemmatized", blank: bool = False) -> DataFrame:
    """The keys, which must be unique, and the lemmatized text. Texts without tokens have no row, or, with ``blank``, an
    empty one. The Arrow plan is for dictionaries of at most ARROW_ROWS rows, which are counted: ``plan="arrow"`` raises
    beyond them, ``"auto"`` joins."""
    given = (keys, text, tokenizer, variant, out, blank)
    possible = variant.token_bytes is None and variant.misses
    if blank and not variant.misses:
        raise ValueError("blank texts need a variant that keeps misses")
    if plan == "arrow" or (plan == "auto" and possible):
        if not possible:
            raise ValueError("the Arrow plan neither cuts tokens nor drops misses")
        rows = collected(dictionary, variant, ARROW_ROWS)
        if rows is not None:
            return by_arrow(texts, shared_map(texts.sparkSession, rows), *given)
        if plan == "arrow":
            raise ValueError(f"the dictionary has more than {ARROW_ROWS} rows; use the join plan")
    return _by_join(texts, dictionary, *given)


def lemmatize_columnar(texts: DataFrame, dictionary: DataFrame, keys: list[str], text: str = "text", plan: str = "auto", out: str = "lemmatized") -> DataFrame:
    """Single spaces, case kept, lemmas of at most 32 bytes, empty lemmas stay; null texts have no row."""
    return lemmatize_texts(texts, dictionary, keys, text, "single_space", COLUMNAR, plan, out)


def lemmatize_column(words: DataFrame, column: str, dictionary: DataFrame, variant: Variant = COLUMNAR, out: str = "lemma") -> DataFrame:
    """One token a row: all columns and its lemma."""
    found = lookup(words.withColumn("token", F.col(column)), sized(dictionary), variant)
    return (found if column == "token" else found.drop("token")).withColumnRenamed("lemma", out)


def split_lines(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The keys, line_no (from 0) and line of every line of every text."""
    return texts.select(*keys, F.posexplode(lines_of(F.col(text))).alias("line_no", "line"))


def lemmatize_lines(lines: DataFrame, dictionary: DataFrame, keys: list[str], line: str = "line", variant: Variant = SINGLE_THREAD, plan: str = "auto", out: str = "text") -> DataFrame:
    """A row a line, blank ones included: white-space tokens looked up and joined by single spaces."""
    return lemmatize_texts(lines, dictionary, keys, line, "whitespace", variant, plan, out, blank=True)
