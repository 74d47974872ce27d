"""Registered queries of the lemmatizer and their SQL counterparts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.functions.text import tokens_whitespace
from morphlake.operators import dictionary as d
from morphlake.operators import lemmatize as z
from morphlake.operators import lookup as k
from morphlake.operators import metrics as m
from morphlake.plans import fixtures as fx
from morphlake.sources import records
from morphlake.sources.dictionary_csv import parse_lines, read_dictionary_lines
from morphlake.sources.text import read_ordered_lines, words_any_break, words_raw, write_lines

QUERIES = {}
ORACLES = {}

# Pieces of SQL ------------------------------------------------------------------------------------------------------
_SPACE = "[ \\t\\n\\v\\f\\r]+"
_PARSED = f"""f as (select column0 line_no, string_split(column1, ',') p from {fx.values(fx.LINES, 1)} t(column0, column1)),
parsed as (select line_no, p[1] wordform, coalesce(p[2], '') lemma, len(p) >= 3 or (len(p) = 2 and p[2] <> '') ok from f)"""
_TRIE = f"""{_PARSED}, trie as (select lower(wordform) key, arg_min(lemma, line_no) lemma from parsed where ok and not contains(wordform, '-') group by 1)"""
_BOUNDED = f"""{_PARSED}, bounded as (select lower(wordform) key, arg_min(lemma, line_no) lemma from parsed
  where wordform <> '' and lemma <> '' and not contains(wordform, '-') and strlen(lower(wordform)) < 32 and strlen(lemma) < 32 group by 1)"""
_PAIRS = f"""{_PARSED}, pairs as (select wordform, lemma, min(line_no) line_no from parsed where wordform <> '' and lemma <> '' group by 1, 2)"""
_ENTRIES = f"""{_PARSED}, entries as (select distinct lower(wordform) key, lemma from parsed where wordform <> '' and lemma <> '' and not contains(wordform, '-'))"""
_TOKENS = f"tok as (select i, token from {fx.values(fx.TOKENS)} t(i, token))"
_TEXTS = f"texts as (select id, text from {fx.values(fx.TEXTS)} t(id, text))"
_DOCS = f"tok as (select doc_id, list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda t: t <> '') ws from documents)"
_EXPLODED = f"{_DOCS}, e as (select doc_id, i - 1 pos, ws[i] token from (select doc_id, ws, unnest(range(1, len(ws) + 1)) i from tok))"
_CORPUS = """c as (select distinct lower(token) k from e), dict as (select k, regexp_replace(k, '(s|en|tion)$', '') lemma from c where not contains(k, '-') and regexp_matches(k, '(s|en|tion)$'))"""


def _cut(column: str, size: int) -> str:
    return f"substr(hex(encode({column})), 1, {2 * size})"


def _query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parsed(spark: SparkSession) -> DataFrame:
    return parse_lines(fx.lines(spark))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt out where they are few files."""
    return z.spread(_table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


def _corpus_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.corpus_dictionary(_documents(spark, sf_dir))


def _stored_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a table, so that counting and joining it read files and not the corpus again."""
    return d.load_or_build(spark, _scratch(spark), lambda: _corpus_dictionary(spark, sf_dir))


def _scratch(spark: SparkSession) -> str:
    """A folder all executors share where the cluster names one; a local one for a local master alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="morphlake-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def _hexed(found: DataFrame) -> DataFrame:
    return found.select("i", F.hex(F.col("lemma").cast("binary")).alias("lemma_hex"))


# Dictionaries -------------------------------------------------------------------------------------------------------
@_query("dict_trie", f"with {_TRIE} select key, lemma from trie")
def dict_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.trie_dictionary(_parsed(spark))


@_query("dict_bounded_sorted", f"with {_BOUNDED} select key, lemma from bounded order by key")
def dict_bounded_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.bounded_dictionary(_parsed(spark)).orderBy("key")


def _pairs_sql(most: str) -> str:
    return f"with {_PAIRS} select line_no, {_cut('wordform', 32)} key_hex, {_cut('lemma', 32)} lemma_hex from pairs order by line_no {most}"


def _pairs(spark: SparkSession, most: int | None) -> DataFrame:
    return d.pair_dictionary(_parsed(spark), most).select("line_no", F.hex("key_bytes").alias("key_hex"), F.hex("lemma_bytes").alias("lemma_hex"))


@_query("dict_pairs", _pairs_sql(""))
def dict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, None)


@_query("dict_pairs_limit", _pairs_sql("limit 5"))
def dict_pairs_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, 5)


@_query("dict_dawg_entries", f"with {_ENTRIES} select key, lemma from entries")
def dict_dawg_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.automaton_entries(_parsed(spark))


@_query("dict_dawg_resolved", f"with {_ENTRIES} select key, max(lemma) lemma from entries group by 1")
def dict_dawg_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.resolve(d.automaton_entries(_parsed(spark)))


@_query(
    "trie_stats",
    f"""with {_TRIE}, h as (select hex(encode(key)) h from trie where key <> ''), n as (select unnest(range(1, (len(h) // 2) + 1)) i, h from h)
select 1 + (select count(distinct substr(h, 1, 2 * i)) from n) states, (select count(distinct substr(h, 1, 2 * i)) from n) transitions, (select sum(strlen(lemma) + 1)::bigint from trie) lemma_bytes""",
)
def trie_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.trie_statistics(d.trie_dictionary(_parsed(spark)))


@_query("corpus_dictionary", f"with {_EXPLODED}, {_CORPUS} select k as key, lemma from dict")
def corpus_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus_dictionary(spark, sf_dir)


@_query("dict_roundtrip", ORACLES["dict_trie"])
def dict_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.load_or_build(spark, _scratch(spark), lambda: d.trie_dictionary(_parsed(spark)))


@_query("dict_dawg_roundtrip", ORACLES["dict_dawg_entries"])
def dict_dawg_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.load_or_build(spark, _scratch(spark), lambda: d.automaton_entries(_parsed(spark)))


@_query("dict_csv_scan", f"select column0::bigint as line_no, column1 as line from {fx.values(fx.LINES, 1)} t(column0, column1)")
def dict_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    header = spark.createDataFrame([(0, "form,lemma")], "line_no int, line string")
    write_lines(header.unionByName(fx.lines(spark)).coalesce(1), path, column="line")
    return read_dictionary_lines(spark, path)


@_query("dict_trie_corpus", f"with {_EXPLODED}, {_CORPUS}, g as (select lower(token) w, min(doc_id * 1000000 + pos) o from e group by 1) select w as key, arg_min(regexp_replace(w, '(s|en|tion)$', ''), o) lemma from g where not contains(w, '-') and not contains(w, ',') group by 1")
def dict_trie_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie dictionary of a CSV made of all different words of the corpus: written, scanned, parsed, first line wins."""
    tokens = z.explode_tokens(_documents(spark, sf_dir), ["doc_id"])
    words = tokens.groupBy(F.lower("token").alias("w")).agg(F.min(F.col("doc_id") * 1_000_000 + F.col("pos")).alias("line_no")).filter(~F.contains("w", F.lit(",")))
    path = _scratch(spark)
    write_lines(words.select("line_no", F.concat("w", F.lit(","), F.regexp_replace("w", "(s|en|tion)$", ""), F.lit(",x")).alias("line")), path, column="line")
    lines = read_ordered_lines(spark, path)
    return d.trie_dictionary(parse_lines(lines))


@_query("flat_record_roundtrip", f"with {_BOUNDED} select row_number() over (order by encode(key)) - 1 as at, key, lemma from bounded")
def flat_record_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    rows = d.bounded_dictionary(_parsed(spark))
    for name in ("key", "lemma"):
        data = records.pack_records(rows, name, "key")
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}.bin")
        out = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(target)
        out.write(data)
        out.close()
    return records.read_record_pairs(spark, f"{path}/key.bin", f"{path}/lemma.bin").select(F.col("at").cast("long").alias("at"), "key", "lemma")


# Tokens -------------------------------------------------------------------------------------------------------------
@_query("tokens_whitespace", f"with {_EXPLODED} select doc_id, pos, token from e")
def tokens_whitespace_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return z.explode_tokens(_table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", F.col("pos").cast("long").alias("pos"), "token")


@_query("tokens_single_space", "with s as (select doc_id, string_split(text, ' ') ws from documents) select doc_id, i - 1 pos, ws[i] token from (select doc_id, ws, unnest(range(1, len(ws) + 1)) i from s)")
def tokens_single_space_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return z.explode_tokens(_table(spark, sf_dir, "documents"), ["doc_id"], tokenizer="single_space").select("doc_id", F.col("pos").cast("long").alias("pos"), "token")


@_query("tokens_lower", f"with {_EXPLODED} select lower(token) token, count(*) n from e group by 1")
def tokens_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = z.explode_tokens(_documents(spark, sf_dir), ["doc_id"])
    return tokens.groupBy(F.lower("token").alias("token")).agg(F.count(F.lit(1)).alias("n"))


def _breaks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(fx.BREAKS,)], "text string")


@_query("words_raw_lf", f"select word from (select unnest(string_split({fx.literal(fx.BREAKS)}, chr(10))) word) where word <> ''")
def words_raw_lf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words_raw(_breaks(spark))


@_query("words_raw_crlf", f"select word from (select unnest(regexp_split_to_array({fx.literal(fx.BREAKS)}, '[\\r\\n]+')) word) where word <> ''")
def words_raw_crlf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words_any_break(_breaks(spark))


@_query("truncated_tokens_hex", f"with {_TOKENS} select i, {_cut('lower(token)', 31)} slot_hex, strlen(lower(token)) >= 32 as truncated from tok")
def truncated_tokens_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.lower("token")
    return fx.tokens(spark).select("i", F.hex(F.substring(F.encode(token, "UTF-8"), 1, 31)).alias("slot_hex"), (F.octet_length(token) >= 32).alias("truncated"))


# Lookups ------------------------------------------------------------------------------------------------------------
def _lookup_sql(dictionary: str, name: str, lower: bool, slot: int | None, lemma: int | None, empty_is_miss: bool) -> str:
    token = "lower(token)" if lower else "token"
    key = f"hex(encode({token}))" if slot is None else _cut(token, slot)
    hit = "hex(encode(lemma))" if lemma is None else _cut("lemma", lemma)
    if empty_is_miss:
        hit = f"case when lemma = '' then hex(encode({token})) else {hit} end"
    return f"with {dictionary}, {_TOKENS} select i, case when lemma is null then {key} else {hit} end lemma_hex from tok left join {name} on hex(encode(key)) = {key}"


def _looked_up(spark: SparkSession, builder, variant: k.Variant) -> DataFrame:
    return _hexed(k.lookup(fx.tokens(spark), k.sized(builder(_parsed(spark))), variant))


@_query("lookup_columnar", _lookup_sql(_TRIE, "trie", False, None, 32, False))
def lookup_columnar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _looked_up(spark, d.trie_dictionary, k.COLUMNAR)


@_query("lookup_trie", _lookup_sql(_TRIE, "trie", True, None, 32, True))
def lookup_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _looked_up(spark, d.trie_dictionary, k.PACKED)


@_query("lookup_cpu", _lookup_sql(_TRIE, "trie", True, None, 32, False))
def lookup_cpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _looked_up(spark, d.trie_dictionary, k.SINGLE_THREAD)


@_query("lookup_stride", _lookup_sql(_TRIE, "trie", True, 31, 31, True))
def lookup_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _looked_up(spark, d.trie_dictionary, k.STRIDE)


@_query("lookup_bounded", _lookup_sql(_BOUNDED, "bounded", True, 31, None, True))
def lookup_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _looked_up(spark, d.bounded_dictionary, k.BOUNDED)


@_query(
    "lookup_linear",
    f"""with {_PAIRS}, lin as (select {_cut('wordform', 32)} k, arg_min({_cut('lemma', 32)}, line_no) l from pairs group by 1), {_TOKENS}
select i, coalesce(l, {_cut('token', 32)}) lemma_hex from tok left join lin on k = {_cut('token', 32)}""",
)
def lookup_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hexed(k.lookup(fx.tokens(spark), k.linear_dictionary(d.pair_dictionary(_parsed(spark))), k.LINEAR))


@_query("lookup_exact", f"with {_ENTRIES}, r as (select key, max(lemma) lemma from entries group by 1), {_TOKENS} select i, {_cut('lemma', 32)} lemma_hex from tok join r on key = token")
def lookup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _looked_up(spark, lambda p: d.resolve(d.automaton_entries(p)), k.EXACT)


@_query("lookup_missing", f"with {_ENTRIES}, {_TOKENS} select i, token from tok where token not in (select key from entries)")
def lookup_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.missing(fx.tokens(spark), d.automaton_entries(_parsed(spark)))


@_query(
    "lookup_corpus_tokens",
    f"with {_EXPLODED}, {_CORPUS} select coalesce(lemma, lower(token)) lemma, count(*) n from e left join dict on k = lower(token) group by 1",
)
def lookup_corpus_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = z.explode_tokens(_documents(spark, sf_dir), ["doc_id"])
    counted = tokens.groupBy(F.lower("token").alias("token")).agg(F.count(F.lit(1)).alias("n"))
    found = k.lookup(counted, k.sized(_stored_dictionary(spark, sf_dir)), k.Variant(lemma_bytes=None))
    return found.groupBy("lemma").agg(F.sum("n").alias("n"))


@_query("lookup_demo", f"with {_TRIE} select i, token, coalesce(nullif(lemma, ''), token) lemma from {fx.values(fx.DEMO)} t(i, token) left join trie on key = token")
def lookup_demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.lookup(fx.demo(spark), k.sized(d.trie_dictionary(_parsed(spark))), k.PACKED)


@_query("lookup_column", f"with {_EXPLODED}, {_CORPUS}, w as (select distinct token from e) select token, coalesce(lemma, token) lemma from w left join dict on k = token")
def lookup_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column entry point over all different tokens of the corpus, case kept."""
    words = z.explode_tokens(_documents(spark, sf_dir), ["doc_id"]).select("token").distinct()
    return z.lemmatize_column(words, "token", _stored_dictionary(spark, sf_dir), k.Variant(lemma_bytes=None))


# Whole texts --------------------------------------------------------------------------------------------------------
def _columnar_sql(source: str, keys: str, dictionary: str, name: str, cut: bool) -> str:
    lemma = f"coalesce({'substr(lemma, 1, 16)' if cut else 'lemma'}, token)"
    return f"""with {dictionary}, s as (select {keys}, string_split(text, ' ') ws from {source} where text is not null),
e as (select {keys}, i pos, ws[i] token from (select {keys}, ws, unnest(range(1, len(ws) + 1)) i from s))
select {keys}, string_agg({lemma}, ' ' order by pos) lemmatized from e left join {name} on key = token group by all"""


@_query("lemmatize_columnar", _columnar_sql("texts", "id", f"{_TRIE}, {_TEXTS}", "trie", True))
def lemmatize_columnar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture's lemmas of over 32 bytes are Cyrillic alone, so 32 bytes are 16 letters in SQL."""
    return z.lemmatize_columnar(fx.texts(spark), d.trie_dictionary(_parsed(spark)), ["id"])


_FLAGSHIP = f"with {_EXPLODED}, {_CORPUS} select doc_id, string_agg(coalesce(lemma, lower(token)), ' ' order by pos) lemmatized from e left join dict on k = lower(token) group by 1"
_WHOLE = k.Variant(lower=True, lemma_bytes=None)


@_query("lemmatize_documents_ws", _FLAGSHIP)
def lemmatize_documents_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return z.lemmatize_texts(_table(spark, sf_dir, "documents"), _corpus_dictionary(spark, sf_dir), ["doc_id"], variant=_WHOLE)


@_query("lemmatize_fast", _FLAGSHIP)
def lemmatize_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return z.lemmatize_texts(_table(spark, sf_dir, "documents"), _corpus_dictionary(spark, sf_dir), ["doc_id"], variant=_WHOLE, plan="arrow")


@_query("lemmatize_joined", _FLAGSHIP)
def lemmatize_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return z.lemmatize_texts(_table(spark, sf_dir, "documents"), _stored_dictionary(spark, sf_dir), ["doc_id"], variant=_WHOLE, plan="join")


@_query(
    "lemmatize_documents_columnar",
    f"with {_EXPLODED}, {_CORPUS}, " + _columnar_sql("documents", "doc_id", "x as (select 1)", "(select k as key, lemma from dict)", False).removeprefix("with x as (select 1), ").replace("\ne as", "\ne2 as").replace("from e left", "from e2 left"),
)
def lemmatize_documents_columnar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return z.lemmatize_texts(_table(spark, sf_dir, "documents"), _corpus_dictionary(spark, sf_dir), ["doc_id"], tokenizer="single_space", variant=k.Variant(lemma_bytes=None))


@_query(
    "lemmatize_conversations",
    f"with {_EXPLODED}, {_CORPUS}, " + _columnar_sql("conversations", "conv_id, turn", "x as (select 1)", "(select k as key, lemma from dict)", False).removeprefix("with x as (select 1), ").replace("\ne as", "\ne2 as").replace("from e left", "from e2 left"),
)
def lemmatize_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return z.lemmatize_texts(_table(spark, sf_dir, "conversations"), _corpus_dictionary(spark, sf_dir), ["conv_id", "turn"], tokenizer="single_space", variant=k.Variant(lemma_bytes=None))


_LINES = """l as (select {key}, string_split(text, chr(10)) p from {source} where text is not null),
l2 as (select {key}, case when p[len(p)] = '' then p[1:len(p) - 1] else p end p from l),
ln as (select {key}, i - 1 line_no, p[i] line from (select {key}, p, unnest(range(1, len(p) + 1)) i from l2)),
w as (select {key}, line_no, list_filter(regexp_split_to_array(line, '{space}'), lambda t: t <> '') ws from ln),
le as (select {key}, line_no, i pos, lower(ws[i]) token from (select {key}, line_no, ws, unnest(range(1, len(ws) + 1)) i from w))"""


@_query(
    "lemmatize_lines",
    f"with {_EXPLODED}, {_CORPUS}, {_LINES.format(key='doc_id', source='documents', space=_SPACE)},\ng as (select doc_id, line_no, string_agg(coalesce(lemma, token), ' ' order by pos) t from le left join dict on k = token group by 1, 2)\nselect doc_id, line_no, coalesce(t, '') as text from ln left join g using (doc_id, line_no)",
)
def lemmatize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = z.split_lines(_documents(spark, sf_dir), ["doc_id"])
    found = z.lemmatize_lines(lines, _corpus_dictionary(spark, sf_dir), ["doc_id", "line_no"], variant=_WHOLE)
    return found.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "text")


@_query(
    "lemmatize_fixture_lines",
    f"with {_TRIE}, {_TEXTS}, {_LINES.format(key='id', source='texts', space=_SPACE)},\ng as (select id, line_no, string_agg(coalesce(substr(lemma, 1, 16), token), ' ' order by pos) t from le left join trie on key = token group by 1, 2)\nselect id, line_no, coalesce(t, '') as text from ln left join g using (id, line_no)",
)
def lemmatize_fixture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = z.lemmatize_lines(z.split_lines(fx.texts(spark), ["id"]), d.trie_dictionary(_parsed(spark)), ["id", "line_no"])
    return found.select("id", F.col("line_no").cast("long").alias("line_no"), "text")


def _fixture_lines_sql(dictionary: str, name: str, slot: int | None, lemma: int | None) -> str:
    key = "hex(encode(token))" if slot is None else _cut("token", slot)
    hit = "hex(encode(lemma))" if lemma is None else _cut("lemma", lemma)
    token = f"case when lemma is null then {key} when lemma = '' then hex(encode(token)) else {hit} end"
    return (
        f"with {dictionary}, {_TEXTS}, {_LINES.format(key='id', source='texts', space=_SPACE)},\ng as (select id, line_no, string_agg({token}, '20' order by pos) t from le left join {name} on hex(encode(key)) = {key} group by 1, 2)\n"
        "select id, line_no, coalesce(t, '') text_hex from ln left join g using (id, line_no)"
    )


def _fixture_lines(spark: SparkSession, dictionary: DataFrame, variant: k.Variant) -> DataFrame:
    found = z.lemmatize_lines(z.split_lines(fx.texts(spark), ["id"]), dictionary, ["id", "line_no"], variant=variant)
    return found.select("id", F.col("line_no").cast("long").alias("line_no"), F.hex(F.col("text").cast("binary")).alias("text_hex"))


@_query("lemmatize_lines_packed", _fixture_lines_sql(_TRIE, "trie", None, 32))
def lemmatize_lines_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixture_lines(spark, d.trie_dictionary(_parsed(spark)), k.PACKED)


@_query("lemmatize_lines_stride", _fixture_lines_sql(_TRIE, "trie", 31, 31))
def lemmatize_lines_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixture_lines(spark, d.trie_dictionary(_parsed(spark)), k.STRIDE)


@_query("lemmatize_lines_bounded", _fixture_lines_sql(_BOUNDED, "bounded", 31, None))
def lemmatize_lines_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixture_lines(spark, d.bounded_dictionary(_parsed(spark)), k.BOUNDED)


@_query("lines_roundtrip", f"with {_LINES.format(key='doc_id', source='documents', space=_SPACE)} select row_number() over (order by doc_id, line_no) - 1 as line_no, line from ln")
def lines_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of the documents through the ordered sink into part files, scanned in splits and numbered over the files."""
    lines = z.split_lines(_documents(spark, sf_dir), ["doc_id"]).withColumn("order", F.struct("doc_id", "line_no"))
    path = _scratch(spark)
    write_lines(lines, path, order="order", column="line")
    return read_ordered_lines(spark, path)


# Counts -------------------------------------------------------------------------------------------------------------
@_query(
    "line_word_count",
    f"with {_LINES.format(key='doc_id', source='documents', space=_SPACE)} select doc_id, line_no, len(ws)::bigint words from w",
)
def line_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = z.split_lines(_table(spark, sf_dir, "documents"), ["doc_id"]).withColumn("line_no", F.col("line_no").cast("long"))
    return m.line_word_counts(lines, ["doc_id", "line_no"])


@_query("word_count", f"with {_DOCS} select sum(len(ws))::bigint words from tok")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.word_count(_table(spark, sf_dir, "documents"))


@_query("truncated_words", f"with {_EXPLODED} select count(*) truncated from e where strlen(lower(token)) >= 32")
def truncated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _table(spark, sf_dir, "documents").select(F.explode(tokens_whitespace(F.col("text"))).alias("token"))
    return m.truncated_words(tokens.select(F.lower("token").alias("token")))


@_query("cardinalities", f"with {_EXPLODED}, {_CORPUS} select count(*) words, count(*) filter (coalesce(lemma, token) <> '') lemmas, count(distinct doc_id) texts from e left join dict on k = lower(token)")
def cardinalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = z.explode_tokens(_documents(spark, sf_dir), ["doc_id"])
    return m.cardinalities(k.lookup(tokens, k.sized(_stored_dictionary(spark, sf_dir)), _WHOLE), ["doc_id"])


@_query("loop_statistics", "select count(*) iterations, avg(ms) mean_ms, max(ms) longest_ms, sum(words) / (sum(ms) / 1000) words_per_second from (values " + ", ".join(f"({w}, {t}::double)" for w, t in fx.RUNS) + ") t(words, ms)")
def loop_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.loop_statistics(spark.createDataFrame(fx.RUNS, "words long, ms double"))
