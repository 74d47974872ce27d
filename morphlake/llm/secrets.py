"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

The patterns find assignments, access keys and long hexadecimal runs. The models look at every run of 20 or more
characters of the token alphabet, those within a pattern's span too: one first-order model of random strings, one of
ordinary identifiers, both trained from labelled samples; a run is a secret, of kind ``markov``, where
log p(run | random) - log p(run | ordinary) reaches ``least``. A value that pattern and models both find has both spans.

Samples labelled random are the values that the patterns find in the corpus and generated strings in four common
encodings; samples labelled ordinary are the corpus's letter-only runs of 12 or more characters outside the patterns'
matches and identifiers generated from common words in the usual spellings, with numbers and dates. Every sample weighs
the same whatever its length, and the corpus's samples of a label together at most as much as the generated ones, so
neither one long run nor a corpus with few samples makes the model. Counts of pairs of characters come from all
documents and are added up before the exchange; the fitted table has a fixed size.

Edge cases: null text is empty and has no spans; a corpus without samples leaves the generated ones, and no samples at
all equal shares, whose ratio is zero everywhere, so that no run is a secret; rows that repeat a doc_id keep rows of
their own; other columns pass through ``find_secrets``, whatever their names, but for a ``secret_spans`` it replaces.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.llm import spans
from morphlake.llm.common import clean_text, free, literal_doubles, table

KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
WORD = r"(?<![A-Za-z0-9+/_=-])[A-Za-z_-]{12,}+(?![0-9+/=])"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET) + 1
#: Log-likelihood ratio, in nats, that makes a run a secret.
LEAST = 12.0
#: Generated samples of each label, and what a sample's pairs of characters weigh together.
GENERATED, WEIGHT = 4_000, 100_000
#: Common words of identifiers, for generated ordinary samples.
COMMON = (
    "account action address after agent all animation application argument array assert attribute background balance base batch before begin between block "
    "border branch browser buffer build button bytes cache call callback cancel category change channel character check child class client close cluster "
    "collection color column command common company complete component config connection constructor container content context control cookie copy count "
    "country create current customer data database date debug default delete department description device dictionary directory disable display document "
    "download element enable encoding engine entry environment error event example exception expected export extension factory failure feature field "
    "file filter first folder for format forward from function gateway general generator get global group handle header height history host house http "
    "identifier image implementation import index information initialize input insert instance integer interface internal international item iterator job journal key keyboard "
    "language last layout length level library license line link list listener local location logger machine manager mapping master maximum "
    "measure member memory message metadata method middle minimum model module month move name navigation network next node normal not notification number "
    "object of offset operation option order organisation original output package page parameter parent parser partition password path pattern payment performance "
    "permission person picture platform policy position previous primary private process product profile project property protocol provider public "
    "quality query queue question random range read record reference region register relation release remove render report request require resource response "
    "result return right route row sample schedule schema science screen search section security select sequence server service session set settings "
    "shadow single size software source standard start state static status storage stream string structure style subject supported system table target "
    "task template test text the thread time timeout title to total transaction transfer transform translation tree type unique update upload user util valid "
    "value variable vector version view visible warning web wide width window with word world write year zone"
)


def base_spans(text: Column) -> Column:
    """Spans of the patterns by start, then by kind as listed."""
    assign = F.filter(spans.find(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 1)) >= 8)
    found = (assign, spans.find(text, ACCESS), spans.find(text, HEX))
    return F.sort_array(F.concat(*[spans.listed(x, kind, i) for i, (x, kind) in enumerate(zip(found, KINDS, strict=True))]))


def _pairs(run: Column) -> Column:
    """A number for each pair of neighbouring characters, the first one's neighbour being the start; from 0."""
    codes = F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    before = F.slice(F.concat(F.array(F.lit(0)), codes), F.lit(1), F.size(codes))
    return F.zip_with(before, codes, lambda a, b: a * SIZE + b)


def generated_samples(spark: SparkSession, count: int = GENERATED) -> DataFrame:
    """token, secret, corpus (false): ``count`` random strings and as many ordinary identifiers, from hashes of numbers.

    Random: hexadecimal of either case, base 64, and base 64 without its marks. Ordinary: two to four common words,
    joined by low lines, hyphens, slashes, capitals or nothing, some with a number or a date.
    """
    number = F.col("id")
    digest = F.sha2(F.concat(F.lit("sample "), number.cast("string")), 256)
    packed = F.base64(F.unhex(digest))
    plain = F.regexp_replace(packed, "[+/=]", "")
    random = F.element_at(F.array(F.substring(digest, 1, 40), packed, plain, plain, F.upper(F.substring(digest, 1, 40)), packed), (number % 6 + 1).cast("int"))
    known = COMMON.split()
    pick = [F.element_at(F.split(F.lit(COMMON), " "), (F.pmod(F.xxhash64(number, F.lit(k)), F.lit(len(known))) + 1).cast("int")) for k in range(4)]
    own = F.slice(F.array(*pick), F.lit(1), (F.pmod(F.xxhash64(number, F.lit(9)), F.lit(3)) + 2).cast("int"))
    figure = F.pmod(F.xxhash64(number, F.lit(10)), F.lit(10_000)).cast("string")
    date = F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), F.pmod(F.xxhash64(number, F.lit(11)), F.lit(10_000)).cast("int")), "yyyy-MM-dd")
    camel = F.array_join(F.transform(own, lambda w: F.initcap(w)), "")
    spelled = (F.array_join(own, "_"), F.array_join(own, "-"), camel, F.concat(F.lower(F.substring(camel, 1, 1)), F.substring(camel, 2, 99)), F.upper(F.array_join(own, "_")), F.array_join(own, "/"), F.array_join(own, ""), F.concat_ws("_", F.array_join(own, "_"), figure), F.concat_ws("-", F.array_join(own, "-"), date), F.concat(camel, figure))
    ordinary = F.element_at(F.array(*spelled), (number % len(spelled) + 1).cast("int"))
    both = F.explode(F.array(F.struct(random.alias("token"), F.lit(True).alias("secret")), F.struct(ordinary.alias("token"), F.lit(False).alias("secret"))))
    return spark.range(count).select(both.alias("s")).select("s.*", F.lit(False).alias("corpus"))


def labelled_samples(docs: DataFrame) -> DataFrame:
    """token, secret, corpus: what the patterns find, letter-only runs of the whole corpus outside that, and generated strings."""
    text = docs.select(clean_text().alias("text"))
    value = F.when(F.col("s.kind") == "assign", F.regexp_extract("s.match", ASSIGN, 1)).otherwise(F.col("s.match"))
    hits = text.select(F.explode(base_spans(F.col("text"))).alias("s")).select(value.alias("token"), F.lit(True).alias("secret"))
    rest = F.regexp_replace("text", f"{ASSIGN}|{ACCESS}|{HEX}", " ")
    plain = text.select(F.explode(F.regexp_extract_all(rest, F.lit(WORD), F.lit(0))).alias("token"), F.lit(False).alias("secret"))
    return hits.unionByName(plain).withColumn("corpus", F.lit(True)).unionByName(generated_samples(docs.sparkSession))


def fit(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """log p(b | a, random) - log p(b | a, ordinary) for every pair of characters, at a * SIZE + b.

    The sums are at most SIZE squared rows a label and origin, whatever the corpus, and come to the driver. They are
    whole numbers, so their order does not matter; in the ratio a sample counts as 20 pairs of characters.
    """
    made = samples.select("secret", "corpus", _pairs(F.col("token")).alias("pairs")).filter(F.size("pairs") > 0)
    made = made.select("secret", "corpus", F.greatest(F.floor(F.lit(WEIGHT) / F.size("pairs")), F.lit(1)).alias("weight"), F.explode("pairs").alias("pair"))
    sums = {(r["secret"], r["corpus"], r["pair"]): r["weight"] for r in made.groupBy("secret", "corpus", "pair").agg(F.sum("weight").alias("weight")).collect()}
    models = []
    for secret in (True, False):
        total = {c: sum(v for (s, own, _), v in sums.items() if (s, own) == (secret, c)) for c in (False, True)}
        share = min(1.0, total[False] / total[True]) if total[False] and total[True] else 1.0
        models.append([20 / WEIGHT * (sums.get((secret, False, pair), 0) + share * sums.get((secret, True, pair), 0)) for pair in range(SIZE * SIZE)])
    table = []
    for a in range(0, SIZE * SIZE, SIZE):
        random, ordinary = (m[a : a + SIZE] for m in models)
        totals = [sum(x) + smoothing * SIZE for x in (random, ordinary)]
        table += [math.log((r + smoothing) / totals[0]) - math.log((o + smoothing) / totals[1]) for r, o in zip(random, ordinary, strict=True)]
    return table


def likelihood_ratio(run: Column, model: list[float]) -> Column:
    weights = literal_doubles(model)
    return F.aggregate(_pairs(run), F.lit(0.0), lambda total, pair: total + F.element_at(weights, pair + 1))


def find_secrets(docs: DataFrame, model: list[float] | None = None, least: float = LEAST) -> DataFrame:
    """The documents with ``secret_spans``: array of (start, order, end, kind, match) by start, then kind as listed."""
    model = fit(labelled_samples(docs)) if model is None else model
    own = [docs[c] for c in docs.columns if c != "secret_spans"]
    base, runs = free(docs.columns, "base", "runs")
    found = docs.select(*own, base_spans(clean_text()).alias(base), spans.listed(spans.find(clean_text(), RUN), "markov", len(KINDS)).alias(runs))
    scored = F.filter(F.col(runs), lambda s: F.regexp_like(s["match"], F.lit("[A-Za-z]")) & (likelihood_ratio(s["match"], model) >= least))
    return found.withColumn("secret_spans", F.sort_array(F.concat(base, scored))).drop(base, runs)


def redact(docs: DataFrame, mark: str = "<SECRET>") -> DataFrame:
    """Documents of ``find_secrets`` with each span's text replaced."""
    return docs.withColumn("text", spans.replaced(clean_text(), F.col("secret_spans"), lambda s: F.lit(mark)))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    every = F.col("secret_spans")
    base = F.filter(every, lambda s: s["kind"] != "markov")
    return found.select(
        "doc_id",
        *[spans.count(every, kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(spans.text_of(base), 256).alias("base_sha256"),
        spans.text_of(every).alias("spans"),
    )


QUERIES = {"op4_secret_scan": op4_secret_scan}
ORACLES: dict[str, str] = {}
