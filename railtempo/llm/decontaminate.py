"""Benchmark passages in training text by spaced seeds. DataFrame functions only.

A seed mask looks at some positions of a short token window and ignores the others, so a window with a substituted word at an
ignored place still hashes alike in test and training text. Hits are verified on the tokens around them.
"""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railtempo.session import checkpointed

WINDOW, SHARE = 13, 0.8
MASKS = ("11101011", "1101001101")  # one of them fits between any two substitutions in 13 tokens
# four of five tokens: a passage of n tokens with at most n / 5 substitutions has five in a row with at most one
SHORT = ("1111", "10111", "11011", "11101")
FILTER_WORDS = 1 << 18  # longs of the bit filter: 2 MB


def tokens(text: str) -> Column:
    """Hashes of the words (runs of letters and digits, lower case) of a whole text; none for null."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seed(mask: str, name: str = "_tokens", at: str = "_at") -> Column:
    """Hash of the tokens that a mask looks at from a position on; null where it runs over the end."""
    looks = [i for i, c in enumerate(mask) if c == "1"]
    whole = f"{at} + {len(mask)} <= size({name})"
    return F.expr(f"case when {whole} then xxhash64({', '.join(f'get({name}, {at} + {i})' for i in looks)}, {len(mask)}) end")


def _around(window: int, longest: int) -> Column:
    """Tokens from ``window`` - 1 before a position to as many after the longest mask; null outside the text."""
    return F.transform(F.sequence(F.lit(1 - window), F.lit(longest + window - 2)), lambda k: F.get(F.col("_tokens"), F.col("_at") + k))


def _word(seed: str) -> str:
    return f"({seed} & {FILTER_WORDS - 1})"


def _bits(seed: str) -> str:
    """The three bits that a seed sets in its word."""
    return "(" + " | ".join(f"shiftleft(1L, cast(shiftrightunsigned({seed}, {shift}) & 63 as int))" for shift in (20, 26, 32)) + ")"


def _filter(seeds: DataFrame, name: str) -> DataFrame:
    """Blocked Bloom filter as a table: (word number, bits), at most FILTER_WORDS rows however long the benchmark is."""
    return seeds.groupBy(F.expr(_word("seed")).alias(f"_id{name}")).agg(F.expr(f"bit_or({_bits('seed')})").alias(f"_bits{name}"))


def overlaps(
    docs: DataFrame, benchmark: DataFrame, keys: list[str], text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, share: float = SHARE, least: int = 5,
) -> DataFrame:
    """(keys, item, matched, position): every document and test item with a common passage.

    Passage: aligned windows of ``window`` tokens (or the whole item, if that is shorter), at least ``share`` of whose tokens are equal,
    around a seed hit; ``matched`` is the largest number of equal tokens and ``position`` the first token hit. Items under
    ``least`` tokens (null and empty ones too) can't tell a leak from chance and take no part. Seeds
    reach every such passage for shares of 0.8 or more: items shorter than ``window``, or all of them at another window than 13, are looked
    for by ``SHORT``, those under five tokens whole, the others by ``MASKS``. Rows of documents with equal keys count as one, also null keys.

    Documents are scanned once: seeds are tested against a bit filter of bounded size within the scan, and only possible hits
    with the tokens around them are shuffled to the benchmark's seeds.
    """
    items = checkpointed(benchmark.select(F.col(item).alias("_item"), tokens(item_text).alias("_tokens")).filter(
        F.size("_tokens") >= least).distinct())
    if share < SHARE or window < 5:
        raise ValueError(f"seeds reach passages of a share of {SHARE} or more and windows of 5 or more")
    size = F.size("_tokens")
    usual = window == WINDOW
    kind = F.when(size < 5, size).when((size < WINDOW) | F.lit(not usual), 5).otherwise(WINDOW)
    kinds = items.select(kind.alias("n")).distinct()
    looked_for = {r.n: MASKS if r.n == WINDOW else SHORT if r.n == 5 else ("1" * r.n,) for r in kinds.collect()}
    masks = sorted({m for own in looked_for.values() for m in own}) or list(MASKS)
    longest = max(map(len, masks))

    def suits(mask: str) -> Column:
        """Whether items of this many tokens are looked for by a mask."""
        return kind.isin([n for n, own in looked_for.items() if mask in own])

    def placed(df: DataFrame) -> DataFrame:
        # a filter on the tokens would be moved below and compute them twice; a text without any has no seed at 0 either
        return df.withColumn("_at", F.explode(F.expr("sequence(0, greatest(size(_tokens) - 1, 0))")))

    def seeds(df: DataFrame, *columns: str) -> DataFrame:
        own = F.array(*(F.when(suits(m), _seed(m)) for m in masks))
        return df.select(*columns, "_at", "_tokens", F.explode(own).alias("seed")).filter("seed is not null")

    tests = checkpointed(seeds(placed(items), "_item").select(
        "_item", "seed", _around(window, longest).alias("_test"), F.size("_tokens").alias("_length")).distinct())
    own = [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]
    names = [f"_key{i}" for i in range(len(keys))]
    scanned = placed(docs.select(*own, tokens(text).alias("_tokens")))
    # every mask's seed in columns of one row: no second explode over all positions. Up to the filter all is one generated
    # loop, in which the tokens are not copied
    marked = scanned.select(*names, "_at", "_tokens", *(_seed(m).alias(f"_seed{i}") for i, m in enumerate(masks)))
    may = []
    for i in range(len(masks)):
        # bounded by FILTER_WORDS, so every task gets it
        marked = marked.join(F.broadcast(_filter(tests, str(i))), F.expr(f"{_word(f'_seed{i}')} = _id{i}"), "left")
        may.append(F.expr(f"coalesce(_bits{i} & {_bits(f'_seed{i}')} = {_bits(f'_seed{i}')}, false)"))
    seeds_met = F.array(*(F.when(m, F.col(f"_seed{i}")) for i, m in enumerate(may)))
    possible = marked.filter(reduce(or_, may)).select(*names, "_at", "_tokens", F.explode(seeds_met).alias("seed")).filter("seed is not null")
    hits = possible.select(*names, "_at", _around(window, longest).alias("_near"), "seed").join(tests, "seed")
    equal = F.zip_with("_near", "_test", lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
    sums = F.transform(F.sequence(F.lit(1), F.size("_equal") - window + 1), lambda i: F.aggregate(
        F.slice("_equal", i, window), F.lit(0), lambda s, e: s + e))
    checked = hits.select(*names, "_item", "_at", "_length", equal.alias("_equal")).withColumn("matched", F.array_max(sums))
    verified = checked.filter(F.col("matched") >= F.ceil(F.lit(share) * F.least(F.lit(window), F.col("_length"))))
    return verified.groupBy(*names, "_item").agg(F.max("matched").alias("matched"), F.min("_at").alias("position")).select(
        *(F.col(n).alias(k) for n, k in zip(names, keys)), F.col("_item").alias(item), "matched", "position")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no test passage; told apart by id and text, so documents without id are judged one by one."""
    hashed = docs.withColumn("_hash", F.xxhash64("text"))
    found = overlaps(hashed, benchmark, ["doc_id", "_hash"]).select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_leak")).distinct()
    return hashed.join(found, hashed["doc_id"].eqNullSafe(found["_id"]) & (hashed["_hash"] == found["_leak"]), "left_anti").select(*docs.columns)
