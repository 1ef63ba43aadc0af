"""Exact global ranks, percentiles and row positions without a single-task sort.

All follow one pattern: cut the order into buckets by a monotone expression, count per bucket with an ordinary
(partially aggregated) ``groupBy``, turn the small bucket table into running totals, and rank only inside buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from railtempo.functions.scalar import floor_div, micros
from railtempo.session import checkpointed


STEPS, FINER = 512, 4096  # magnitude buckets per power of two, and fine buckets in each


def magnitude_bucket(value: Column, steps: int = STEPS) -> Column:
    """Monotone bucket of a number: ``steps`` buckets per power of two, about 2 million at the very most."""
    size = F.floor((F.log2(F.abs(value)) + 1100) * steps)
    return F.when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size).cast("long")


def _with_offsets(buckets: DataFrame) -> DataFrame:
    """Rows before each bucket. The bucket table is small by construction, so one ordered pass is fine."""
    earlier = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    return buckets.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))


def exact_percentiles(df: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row with exact linearly interpolated percentiles of ``column`` (nulls ignored)."""
    return exact_percentiles_of(df, {name: (column, share) for name, share in shares.items()})


def exact_percentiles_of(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row with an exact percentile per name, given as (column, share), from three passes for all of them.

    First pass: rows per column and magnitude bucket, reduced to the buckets that hold the wanted ranks. Second: rows of those
    buckets per fine bucket, a 4096th of it. Third: only the fine buckets needed are counted by value and ranked, so values
    that crowd into one magnitude are not ranked in one task. The values are written out once for the passes.
    """
    columns = list(dict.fromkeys(column for column, _ in wanted.values()))
    values = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)
    ])).alias("e")).selectExpr("e.c as _c", "e.v as _v") if len(columns) > 1 else df.select(
        F.lit(0).alias("_c"), F.col(columns[0]).cast("double").alias("_v"))
    bucketed = checkpointed(values.filter("_v is not null")).withColumn("_bucket", magnitude_bucket(F.col("_v")))
    # one row per column and bucket, a few thousand in practice
    counts = bucketed.groupBy("_c", "_bucket").agg(F.count("*").alias("_rows")).selectExpr(
        "*",
        "coalesce(sum(_rows) over (partition by _c order by _bucket rows between unbounded preceding and 1 preceding), 0) as _before",
        "sum(_rows) over (partition by _c) as _n",
    )
    spots = []
    for i, (column, share) in enumerate(wanted.values()):
        c, at = columns.index(column), f"(_n - 1) * {share!r}D"
        for side, rank in (("l", f"floor({at})"), ("h", f"ceil({at})")):
            spots.append(F.expr(f"max(if(_c = {c} and {rank} between _before and _before + _rows - 1, "
                                f"struct(_bucket as b, _before as s, {rank} as r, {at} as p), null)) as {side}{i}"))
    found = counts.agg(*spots).select(F.struct("*").alias("t")).scalar()
    sides = [(i, columns.index(column), side) for i, (column, _) in enumerate(wanted.values()) for side in "lh"]
    needed = " or ".join(f"(_c = {c} and _bucket = _t.{side}{i}.b)" for i, c, side in sides)
    narrow = bucketed.withColumn("_t", found).filter(needed).drop("_t").withColumn("_fine", magnitude_bucket(F.col("_v"), STEPS * FINER))
    finer = narrow.groupBy("_c", "_bucket", "_fine").agg(F.count("*").alias("_rows")).selectExpr(
        "*", "coalesce(sum(_rows) over (partition by _c, _bucket order by _fine rows between unbounded preceding and 1 preceding), 0) as _before",
    ).withColumn("_t", found)
    places = [
        F.expr(f"max(if(_c = {c} and _bucket = _t.{side}{i}.b and _t.{side}{i}.r between _t.{side}{i}.s + _before and "
               f"_t.{side}{i}.s + _before + _rows - 1, struct(_fine as b, _t.{side}{i}.s + _before as s, _t.{side}{i}.r as r, "
               f"_t.{side}{i}.p as p), null)) as {side}{i}")
        for i, c, side in sides
    ]
    found = finer.agg(*places).select(F.struct("*").alias("t")).scalar()
    needed = " or ".join(f"(_c = {c} and _fine = _t.{side}{i}.b)" for i, c, side in sides)
    ranked = (
        narrow.withColumn("_t", found).filter(needed).groupBy("_c", "_fine", "_v").agg(F.count("*").alias("_rows"))
        .selectExpr("*", "sum(_rows) over (partition by _c, _fine order by _v rows between unbounded preceding and current row) as _upto")
        .withColumn("_t", found)
    )
    picks = [
        F.expr(f"max(if(_c = {c} and _fine = _t.{side}{i}.b and _t.{side}{i}.r between _t.{side}{i}.s + _upto - _rows and "
               f"_t.{side}{i}.s + _upto - 1, _v, null)) as v{side}{i}")
        for i, c, side in sides
    ] + [F.expr(f"max(_t.l{i}.p - _t.l{i}.r) as f{i}") for i in range(len(wanted))]
    return ranked.agg(*picks).selectExpr(*[f"vl{i} + (vh{i} - vl{i}) * f{i} as `{name}`" for i, name in enumerate(wanted)])


def average_rank_share(df: DataFrame, column: str, out: str) -> DataFrame:
    """Average rank of each value divided by the number of non-null values.

    Different values are ranked inside fine buckets; what lies before a fine bucket is summed inside its magnitude bucket, and
    before that over the table of these.
    """
    value = F.col("_value").cast("double")
    by_value = (
        df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_value"))
        .agg(F.count("*").alias("_count"))
        .withColumns({"_bucket": magnitude_bucket(value), "_fine": magnitude_bucket(value, STEPS * FINER)})
    )
    finer = by_value.groupBy("_bucket", "_fine").agg(F.sum("_count").alias("_rows"))
    offsets = _with_offsets(finer.groupBy("_bucket").agg(F.sum("_rows").alias("_rows"))).select("_bucket", "_before")
    earlier = W.partitionBy("_bucket").orderBy("_fine").rowsBetween(W.unboundedPreceding, -1)
    starts = finer.withColumn("_inner", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).join(offsets, "_bucket").select(
        F.col("_fine").alias("_at"), (F.col("_before") + F.col("_inner")).alias("_before"))
    total = by_value.agg(F.sum("_count")).scalar()
    inside = W.partitionBy("_fine").orderBy("_value").rowsBetween(W.unboundedPreceding, 0)
    ranks = (
        by_value.withColumn("_upto", F.sum("_count").over(inside))
        .join(starts, F.col("_fine") == F.col("_at"))
        .select("_value", ((F.col("_before") + F.col("_upto") - (F.col("_count") - 1) / 2) / total).alias(out))
    )
    return df.join(ranks, F.col(column) == F.col("_value"), "left").drop("_value")


def time_bucket(ts: Column | str, seconds: int) -> Column:
    return floor_div(micros(ts), seconds * 1_000_000)


def row_at(df: DataFrame, ts: str, tie: str, position: Column, bucket_seconds: int = 60) -> DataFrame:
    """The (time, id) of the row at zero-based ``position`` in (time, id) order, as one row."""
    keyed = df.select(micros(ts).alias("_us"), F.col(tie).alias("_id"), time_bucket(ts, bucket_seconds).alias("_bucket"))
    counts = _with_offsets(keyed.groupBy("_bucket").agg(F.count("*").alias("_rows")))
    target = counts.filter((F.col("_before") <= position) & (position < F.col("_before") + F.col("_rows")))
    rank = F.row_number().over(W.partitionBy("_bucket").orderBy("_us", "_id"))
    return (
        keyed.join(F.broadcast(target), "_bucket")
        .withColumn("_at", F.col("_before") + rank - 1)
        .filter(F.col("_at") == position)
        .select("_us", "_id")
    )


def with_temporal_split(df: DataFrame, train_share: float = 0.8, ts: str = "timestamp", tie: str = "id") -> DataFrame:
    """Adds ``is_train``: true for the first ``int(n * train_share)`` rows in (time, id) order."""
    keep = df.agg(F.floor(F.count("*") * F.lit(train_share))).scalar()
    cut = row_at(df, ts, tie, keep)
    # a cut past the last row gives no row: then everything is training data
    edge = cut.agg(F.struct(F.max("_us").alias("us"), F.max("_id").alias("id"))).scalar()
    before = (micros(ts) < edge.getField("us")) | ((micros(ts) == edge.getField("us")) & (F.col(tie) < edge.getField("id")))
    return df.withColumn("is_train", F.coalesce(before, F.lit(True)))


def with_position(
    df: DataFrame, keys: list[str], ts: str, tie: str, out: str = "position", bucket_seconds: int = 3600
) -> DataFrame:
    """Zero-based row position per key in (time, id) order.

    Rows are numbered per (key, time bucket); a carry row per bucket brings in the number of earlier rows, so no task
    holds a whole key and no join is needed.
    """
    rows = df.withColumns({
        "_bucket": time_bucket(ts, bucket_seconds), "_us": micros(ts), "_step": F.lit(1).cast("long"), "_carry": F.lit(False),
    })
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_rows"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_step"), F.lit(True).alias("_carry"))
    )
    order = W.partitionBy(*keys, "_bucket").orderBy(F.col("_carry").desc(), "_us", tie).rowsBetween(W.unboundedPreceding, 0)
    return (
        rows.unionByName(carry, allowMissingColumns=True)
        .withColumn(out, F.sum("_step").over(order) - 1)
        .filter(~F.col("_carry"))
        .select(*df.columns, out)
    )
