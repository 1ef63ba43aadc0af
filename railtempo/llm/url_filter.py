"""URL verdicts: host rules, then a list of canonical URLs behind a blocked Bloom filter. DataFrame functions only."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 4  # longs of a block; each key sets two bits in each


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("_url")))


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, path (both empty without a URL or ``://``) and canonical (then null), replacing columns of these names.

    Canonical: host in lower case, path without trailing slashes, query parameters sorted and without ``ref`` and ``utm_``
    ones, no fragment.
    """
    rest = df.withColumn("_url", F.col(url)).withColumn("_rest", _rest(F.col("_url")))
    host = F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0), UPPER, LOWER)
    parts = rest.withColumn("host", F.coalesce(host, F.lit(""))).withColumn(
        "path", F.coalesce(F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1), F.lit("")))
    kept = F.array_sort(F.filter(
        F.split(F.regexp_extract("_rest", r"^[^?#]*\?([^#]*)", 1), "&"),
        lambda p: (p != "") & ~p.startswith("ref=") & ~p.startswith("utm_")))
    return parts.withColumn("_query", kept).withColumn("canonical", F.when(F.col("_rest").isNotNull(), F.concat(
        "host", F.rtrim("path", F.lit("/")), F.when(F.size("_query") > 0, F.concat(F.lit("?"), F.array_join("_query", "&"))).otherwise(
            "")))).drop("_url", "_rest", "_query")


def _hashed(df: DataFrame, blocks: int) -> DataFrame:
    """Adds the block of ``canonical`` and the two bits it sets in each long of it."""
    hashed = df.withColumn("_block", F.pmod(F.xxhash64("canonical"), F.lit(blocks)).cast("int")).withColumn(
        "_bits", F.xxhash64("canonical", F.lit(1)))
    one = "shiftleft(1L, cast(shiftrightunsigned(_bits, {}) & 63 as int))"
    return hashed.select("*", *(F.expr(f"{one.format(12 * k)} | {one.format(12 * k + 6)}").alias(f"_mask{k}") for k in range(WORDS))).drop("_bits")


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, one long per word) of the canonical URLs in ``listed``: at most ``blocks`` rows, whatever the list's length."""
    return _hashed(listed.select("canonical"), blocks).groupBy(F.col("_block").alias("_at")).agg(
        *(F.bit_or(f"_mask{k}").alias(f"_word{k}") for k in range(WORDS)))


def with_listed(df: DataFrame, listed: DataFrame, blocks: int = 65_536) -> DataFrame:
    """Adds ``listed``: whether ``canonical`` is in the list (false for null).

    The Bloom filter has 32 bytes a block, so its broadcast is bound by ``blocks`` (2 MB of bits). Rows it rules out are done
    without a shuffle. The others meet the list in a hash join on the URL itself, which removes false positives; a longer
    list makes that join larger and never the result wrong. Hot URLs on the left are split by adaptive execution.
    """
    exact = listed.select(F.col("canonical").alias("_listed")).filter("_listed is not null").distinct()
    probed = _hashed(df, blocks).join(F.broadcast(bloom(listed.filter("canonical is not null"), blocks)), F.col("_block") == F.col("_at"), "left")
    possible = F.coalesce(F.expr(" and ".join(f"_word{k} & _mask{k} = _mask{k}" for k in range(WORDS))), F.lit(False)) & F.col("canonical").isNotNull()
    columns = [c for c in df.columns if c != "listed"]
    out = probed.filter(~possible).select(*columns, F.lit(False).alias("listed"))
    hits = probed.filter(possible).select(*columns).join(
        exact.hint("shuffle_hash"), F.col("canonical") == F.col("_listed"), "left")
    return out.unionByName(hits.select(*columns, F.col("_listed").isNotNull().alias("listed")))


def rule_of(rules: list[tuple[str, str]], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """(rule, verdict) columns of the longest fitting rule, null without one. A rule is (``allow`` or ``block``, ``host/path``) and fits
    its host and all subdomains where the path starts with the rule's. Rules are a handful of settings, not data."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((F.col(host) == name) | F.col(host).endswith("." + name)) & F.col(path).startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], url: str = "url", blocks: int = 65_536) -> DataFrame:
    """Every row of ``pages`` with host, path, canonical, listed, rule and verdict.

    The longest fitting rule decides; without one, listed URLs are blocked and others allowed. Null or malformed URLs, which
    fit no rule and no list, are allowed. Repeated rows stay; ``listed`` needs a column ``url`` and may repeat URLs.
    Columns of ``pages`` with the names added are replaced.
    """
    rule, verdict = rule_of(rules)
    found = with_listed(with_parts(pages, url), with_parts(listed.select("url")), blocks)
    return found.withColumn("rule", rule).withColumn(
        "verdict", F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")))
