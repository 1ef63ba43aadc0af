"""One query per operator over the whole tables, with the equivalent SQL where there is any."""

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railtempo.llm import ann, bpe, chat, decontaminate, licenses, negatives, packing, quality, runs, secrets, simhash, url_filter, warc

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def public_bpe() -> bpe.ByteBpe:
    """The multilingual vocabulary; ``TOKENIZER_DIR`` names another folder that holds it and its pattern."""
    import public_tokenizers

    folder = os.environ.get("TOKENIZER_DIR")
    name = "byte_bpe_multi_50k.tiktoken"
    return bpe.ByteBpe.load(os.path.join(folder, name) if folder else public_tokenizers.path(name), public_tokenizers.PATTERN)


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

# lists are built from pages on which junk was found: words with runs of marks
JUNK = "[#%&*$]{3}"


def _sql_case(rules, value):
    text = "null"
    for action, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = f"(host = '{name}' or ends_with(host, '.{name}')) and starts_with(path, '/{rest}')"
        text = f"case when {fits} then '{rule if value == 'rule' else action}' else {text} end"
    return text


URL_SQL = rf"""
with cut as (
  select page_id, html, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest from pages),
parts as (
  select page_id, html, rest,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path,
    list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
      lambda p: p <> '' and not starts_with(p, 'ref=') and not starts_with(p, 'utm_'))) as params
  from cut),
named as (
  select page_id, html, host, path, case when rest is not null then
    host || rtrim(path, '/') || case when len(params) > 0 then '?' || array_to_string(params, '&') else '' end end as canonical
  from parts),
listed as (select distinct canonical from named where regexp_matches(html, '{JUNK}') and canonical is not null)
select page_id, host, path, {_sql_case(RULES, "rule")} as rule,
  coalesce({_sql_case(RULES, "verdict")}, case when canonical in (from listed) then 'block' else 'allow' end) as verdict
from named"""


@query("op1_url_filter", URL_SQL)
def op1_url_filter(spark, sf_dir):
    """Verdict on every page's URL; the list holds the URLs of all pages with junk."""
    pages = table(spark, sf_dir, "pages")
    found = url_filter.judge(pages.select("page_id", "url"), pages.filter(F.col("html").rlike(JUNK)).select("url"), RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


@query("op2_ann")
def op2_ann(spark, sf_dir):
    """The five nearest vectors of every fiftieth one, among all."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter("vec_id % 50 = 0"), k=5).select("query_id", "rank", "vec_id", "score")


@query("op3_simhash")
def op3_simhash(spark, sf_dir):
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_digits("fingerprint").alias("fingerprint"), "component_id")


@query("op4_secrets")
def op4_secrets(spark, sf_dir):
    """Every secret in every document, with its score."""
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(docs), ["doc_id"]).select("doc_id", "value", "before", "after", F.round("score", 6).alias("score"))


@query("op5_decontamination")
def op5_decontamination(spark, sf_dir):
    """Every document with a passage of a test item, and the item."""
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


@query("op6_warc")
def op6_warc(spark, sf_dir):
    """All pages as WARC records, read back; lengths and digests are those of the decoded payloads."""
    return warc.round_trip(table(spark, sf_dir, "pages"), least=0).drop("intact")


@query("op7_licenses")
def op7_licenses(spark, sf_dir):
    """Every paragraph of every document that states a licence."""
    docs = table(spark, sf_dir, "documents")
    found = licenses.scan(docs, licenses.train(docs), ["doc_id"])
    return found.withColumn("probability", F.round("probability", 6)).withColumn("similarity", F.round("similarity", 6))


def quality_scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with held_out, score and predicted; learnt from the labels that are not held out."""
    model = quality.train(docs, labels.filter(~quality.held_out("doc_id")))
    return quality.with_quality(docs, model).withColumn("held_out", quality.held_out("doc_id")).withColumn(
        "predicted", (F.col("score") >= 0.3).cast("int"))


@query("op8_quality")
def op8_quality(spark, sf_dir):
    """Probability of good quality of every document."""
    scored = quality_scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query("op9_bpe")
def op9_bpe(spark, sf_dir):
    """Token ids of every document, and what they decode to, as digests."""
    coder = public_bpe()
    encoded = bpe.with_ids(table(spark, sf_dir, "documents"), coder).select("doc_id", "ids")
    return bpe.with_bytes(encoded, coder).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op10_chat")
def op10_chat(spark, sf_dir):
    """All conversations and one that holds control strings, formatted as prefix trees and read back."""
    hard = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text").union(extra)
    return chat.digests(rows, public_bpe())


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of one document in ten the words from some place on are made periodic; null counts as empty."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    split = docs.select("doc_id", "text", h.alias("h"), g.alias("g")).withColumn(
        "words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)))
    placed = split.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    placed = placed.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    whole = F.slice("words", F.col("a") + 1, F.col("p"))
    turns = F.expr("cast((n - a) div p + 1 as int)")
    periodic = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(F.flatten(F.array_repeat(whole, turns)), F.lit(1), F.col("n") - F.col("a")))
    return placed.select("doc_id", F.when(F.col("n") > 0, F.array_join(periodic, " ")).otherwise(F.coalesce("text", F.lit(""))).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """What the contract wants of texts with their runs."""
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query("op11_runs")
def op11_runs(spark, sf_dir):
    """Periodic runs of words in every document, and the documents without their repetitions, as digests."""
    return run_digests(runs.with_runs(with_planted_runs(table(spark, sf_dir, "documents"))))


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(id, label, vector): components as whole 256ths, the label of every seventh row moved on; without incomplete rows."""
    x = F.col("embedding")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~odd)
    return rows.select(F.col("vec_id").alias("id"), label.alias("label"), F.transform(x, lambda v: F.floor(256 * v.cast("double"))).alias("vector"))


@query("op12_hard_negatives")
def op12_hard_negatives(spark, sf_dir):
    """Rows of other labels that score nearly as high as an anchor's positives."""
    rows = whole_vectors(table(spark, sf_dir, "embeddings"))
    return negatives.hard_negatives(rows, rows.filter("id % 100 = 0"))


def public_words() -> packing.WordBpe:
    """The lower-case word vocabulary; ``TOKENIZER_DIR`` names another folder that holds it."""
    import public_tokenizers

    folder, name = os.environ.get("TOKENIZER_DIR"), "word_bpe_49k.json"
    return packing.WordBpe.load(os.path.join(folder, name) if folder else public_tokenizers.path(name))


@query("op13_packing")
def op13_packing(spark, sf_dir):
    """All documents in windows of 4,096 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_words(), end=2)
    return pieces.select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
