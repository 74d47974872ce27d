"""Personal data: fixed patterns, and terms that reveal what the patterns protect.

The patterns' values are the protected entities: each address or number itself, and the class it belongs to (the domain
of a mail address, the network of an IP address, the issuer digits of a card, the area digits of a phone number). A term
t, a word of a document with an entity e, reveals part of e: PMI(e; t) = log(N n(e,t) / (n(e) n(t))) out of the
information IC(e) = log(N / n(e)), with n(t), n(e), n(e,t) and N the different texts that hold t, e, both, and in all.
Copies of a text count once, so a copied text alone does not make its words revealing.

A term is marked where its share PMI / IC reaches ``generalise`` and chance cannot explain it: it meets e in two texts or
more, and n(e,t) of n(e) texts have, at a rate of n(t) / N, a probability (bounded by Chernoff's exp(-n(e) KL)) of at
most ``alpha`` over the number of all terms that are met twice. So an entity has a term marked by chance with
probability ``alpha`` at most. The term gets a general mark at all its places in the texts with e; from ``remove`` of IC
on it is taken out of them. A word that the corpus shows with e alone is revealing by this measure whatever it means, a
function word too: a corpus too small to show it elsewhere lacks the background, and a larger one supplies it.

All counts cover all documents and whole texts. Frequencies are added up before their one exchange; terms meet entities
only within the texts that hold both, after terms that cannot reach the threshold are gone.

Edge cases: null text is empty; a word that is itself inside an entity is no term; rows that repeat doc_id and text get
the same spans, rows that repeat only doc_id their own; empty tables give empty results; other columns pass through
``sanitise``, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.llm import spans
from morphlake.llm.common import clean_text, free, small, store, table

KINDS = ("email", "ip", "card", "phone")
#: Possessive repeats and the run-start conditions change no match; they keep long runs linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A run of two or more letters, marks, digits and low lines, so short names and account numbers are terms too.
TERM = r"[\p{L}\p{M}\p{N}_]{2,}+"
GENERALISE, REMOVE = 0.6, 0.9
#: Probability that an entity has a term marked by chance.
ALPHA = 0.05


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the check of alternately doubled digits, counted from the right."""
    values = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda c: c != "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, b: a + b) % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the patterns by kind as listed, then by start. Texts without the sign a kind needs are not searched."""

    def within(count: Column, least: int, most: int) -> Column:
        return (count >= least) & (count <= most)

    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    email = F.when(F.contains(text, F.lit("@")), spans.find(text, EMAIL)).otherwise(none)
    ip = F.filter(spans.find(text, IP), lambda s: F.forall(F.split(s["match"], r"\."), lambda p: F.regexp_like(p, F.lit("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))))
    card = F.filter(spans.find(text, CARD), lambda s: within(F.length(_digits(s["match"])), 16, 19) & _luhn(_digits(s["match"])))
    phone = F.when(F.contains(text, F.lit("+")), F.filter(spans.find(text, PHONE), lambda s: within(F.length(_digits(s["match"])), 8, 15))).otherwise(none)
    return spans.by_kind(F.concat(*[spans.listed(x, kind, i) for i, (x, kind) in enumerate(zip((email, ip, card, phone), KINDS, strict=True))]))


def _entities(span: Column) -> Column:
    """The entity a span holds and the class it belongs to: mail domain, first two parts of an IP address, first six digits
    of a card, first four of a phone number."""
    digits, lower = _digits(span["match"]), F.lower(span["match"])
    value = F.when(span["kind"].isin("card", "phone"), digits).otherwise(lower)
    part = F.when(span["kind"] == "email", F.substring_index(lower, "@", -1)).when(span["kind"] == "ip", F.substring_index(lower, ".", 2))
    part = part.when(span["kind"] == "card", F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 4))
    return F.array(F.concat_ws(":", span["kind"], value), F.concat_ws(":", F.lit("class"), span["kind"], part))


def _masked(text: Column, base: Column) -> Column:
    """The text with blanks over its base spans, so that positions stay."""
    return spans.replaced(text, F.sort_array(base), lambda s: F.repeat(F.lit(" "), s["end"] - s["start"]))


def _codes(text: Column) -> Column:
    """Hashes of the different terms of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda t: F.xxhash64(F.lower(t))))


def _frequencies(docs: DataFrame) -> tuple[DataFrame, int]:
    """code, n_term (the different texts that hold the term) and the number of different texts. A copy counts a part of one."""
    texts = docs.select(clean_text().alias("text")).select(F.xxhash64("text").alias("key"), _codes(F.col("text")).alias("codes"))
    keys = docs.select(F.xxhash64(clean_text()).alias("copied")).groupBy("copied").agg(F.count(F.lit(1)).alias("times"))
    copies = small(store(keys.filter("times > 1"), "copies").df, 16)
    parts = texts.join(copies, F.col("key") == F.col("copied"), "left").select(F.explode("codes").alias("code"), (1 / F.coalesce("times", F.lit(1))).alias("part"))
    return parts.groupBy("code").agg(F.round(F.sum("part")).cast("long").alias("n_term")), keys.count()


def log_chance(n_pair: Column, n_entity: Column, n_term: Column, total: int) -> Column:
    """Chernoff's bound on the log probability that n_pair or more of n_entity texts hold a term of n_term among all."""
    x, q = n_pair / n_entity, F.least(n_term, F.lit(total - 0.5)) / F.lit(float(total))
    other = F.when(n_pair >= n_entity, 0.0).otherwise((n_entity - n_pair) * F.log((1 - x) / (1 - q)))
    return F.when(x <= q, 0.0).otherwise(-(n_pair * F.log(x / q) + other))


def revealing_terms(docs: DataFrame, rows: DataFrame, generalise: float = GENERALISE, alpha: float = ALPHA) -> DataFrame:
    """key (of a text with entities), code (a term in it), share: the largest PMI over IC with one of the text's entities.

    Terms and entities of a single text, and terms so frequent that no entity can reach the threshold with them, are left
    out before pairs are made; neither changes the result: share >= g needs n(t) <= n(e) (N / n(e))^(1 - g).
    """
    frequency, total = _frequencies(docs)
    terms = store(frequency.filter("n_term >= 2"), "terms").df
    least = math.log(alpha / max(1, terms.count()))
    own = F.array_distinct(F.flatten(F.transform("base", _entities)))
    held = rows.filter(F.size("base") > 0).select("key", F.explode(own).alias("entity")).distinct()
    entities = held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).filter((F.col("n_entity") >= 2) & (F.col("n_entity") < total))
    entities = store(entities, "entities").df
    most = entities.agg(F.max("n_entity")).first()[0] or 1
    bound = lambda n: n * F.pow(F.lit(float(total)) / n, F.lit(1 - generalise)) * (1 + 1e-9)
    known = terms.filter(F.col("n_term") <= bound(F.lit(float(most))))
    codes = rows.filter(F.size("base") > 0).select("key", F.explode(_codes(_masked(F.col("text"), F.col("base")))).alias("code")).distinct()
    pairs = held.join(small(entities, 80), "entity").join(codes.join(known, "code"), "key").filter(F.col("n_term") <= bound(F.col("n_entity")))
    pairs = store(pairs.select("key", "entity", "code", "n_entity", "n_term"), "pairs").df
    counted = pairs.groupBy("entity", "code").agg(F.count(F.lit(1)).alias("n_pair"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"))
    counted = counted.withColumn("n_term", F.greatest("n_term", "n_pair")).filter("n_pair >= 2")
    information = F.log(F.lit(float(max(total, 2))) / F.col("n_entity"))
    share = (information + F.log(F.col("n_pair") / F.col("n_term"))) / information
    chance = log_chance(F.col("n_pair"), F.col("n_entity"), F.col("n_term"), total)
    flagged = counted.filter((share >= generalise) & (chance <= least)).select("entity", "code", share.alias("share"))
    flagged = store(flagged, "flagged").df
    return pairs.join(small(flagged, 80), ["entity", "code"]).groupBy("key", "code").agg(F.max("share").alias("share"))


def find_personal_data(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, alpha: float = ALPHA) -> DataFrame:
    """doc_id, key (a hash of the text), pii_spans: base spans by kind as listed, then terms, kind ``term`` or ``removed``."""
    texts = docs.select("doc_id", clean_text().alias("text"))
    rows = texts.select("doc_id", F.xxhash64("text").alias("key"), base_spans(F.col("text")).alias("base"), "text")
    rows = store(rows.select("doc_id", "key", "base", F.when(F.size("base") > 0, F.col("text")).alias("text")), "patterns").df
    shares = revealing_terms(docs, rows, generalise, alpha)
    marks = shares.groupBy(F.col("key").alias("k")).agg(F.map_from_entries(F.collect_list(F.struct("code", "share"))).alias("shares"))
    found = rows.join(marks, F.col("key") == F.col("k"), "left")

    def terms(shares: Column) -> Column:
        every = F.transform(spans.find(_masked(F.col("text"), F.col("base")), TERM), lambda t: F.struct(t.alias("t"), F.element_at(shares, F.xxhash64(F.lower(t["match"]))).alias("share")))
        kind = lambda x: F.when(x["share"] >= remove, "removed").otherwise("term")
        return F.transform(F.filter(every, lambda x: x["share"].isNotNull()), lambda x: F.struct(x["t"]["start"].alias("start"), F.lit(len(KINDS)).alias("order"), x["t"]["end"].alias("end"), kind(x).alias("kind"), F.lower(x["t"]["match"]).alias("match")))

    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string,match:string>>")
    outside = F.when(F.col("shares").isNull(), none).otherwise(F.filter(terms(F.col("shares")), lambda t: ~spans.overlaps(t, F.col("base"))))
    return found.select("doc_id", "key", F.concat("base", outside).alias("pii_spans"))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """The documents with entities and revealing terms replaced by a general mark, and strongly revealing terms removed."""
    no, key, held = free(docs.columns, "id", "key", "spans")
    found = find_personal_data(docs, **options).filter(F.size("pii_spans") > 0)
    found = found.select(F.col("doc_id").alias(no), F.col("key").alias(key), F.col("pii_spans").alias(held)).dropDuplicates([no, key])
    both = docs.join(found, F.col("doc_id").eqNullSafe(F.col(no)) & (F.xxhash64(clean_text()) == F.col(key)), "left")
    mark = lambda s: F.when(s["kind"] == "removed", "").otherwise(F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
    text = F.when(F.col(held).isNull(), F.col("text")).otherwise(spans.replaced(clean_text(), F.sort_array(held), mark))
    return both.withColumn("text", text).drop(no, key, held)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    every = F.col("pii_spans")
    base = F.filter(every, lambda s: s["order"] < len(KINDS))
    return found.select(
        "doc_id",
        *[spans.count(every, kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(spans.text_of(base), 256).alias("base_sha256"),
        spans.text_of(every).alias("spans"),
    )


QUERIES = {"op5_personal_data": op5_personal_data}
ORACLES: dict[str, str] = {}
