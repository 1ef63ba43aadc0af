"""Headway: seconds since the previous arrival at the same station and direction.

One busy station may hold a large share of all rows, so no rows are partitioned by the key alone. Time is cut into
slices; what a slice must know of those before it travels as a carry row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from railtempo.functions.scalar import SECOND, floor_div, micros
from railtempo.operators.segments import map_sorted_groups

KEYS = ["current_station", "direction"]


def with_headway(df: DataFrame, horizon_minutes: int = 30, keys: list[str] | None = None,
                 out: str = "headway_seconds", slice_minutes: int | None = None) -> DataFrame:
    """Headway in arrival order; ties broken by id. Null arrival or a gap of the horizon or more gives null.

    A gap under the horizon reaches back one horizon at most, and of the slices there only the latest arrival matters:
    one carry row per (key, slice), from slice maxima found with a partial aggregate. ``slice_minutes`` (default: the
    horizon, which it must divide) spreads dense keys more finely.
    """
    keys = keys or KEYS
    horizon = horizon_minutes * 60 * SECOND
    width = (slice_minutes or horizon_minutes) * 60 * SECOND
    if horizon % width:
        raise ValueError("the horizon must be a whole number of slices")
    payload = [c for c in df.columns if c != out]
    arrival = micros("arrival_time")
    rows = df.select(
        *payload,
        arrival.alias("_us"),
        # rows without arrival take no part; spread them so that they form no hot group
        F.coalesce(floor_div(arrival, width), F.pmod(F.xxhash64("id"), F.lit(1024))).alias("_slice"),
        F.lit(False).alias("_carry"),
    )
    before = W.partitionBy(*keys).orderBy("_slice").rangeBetween(-(horizon // width), -1)
    carry = (
        rows.filter("_us is not null").groupBy(*keys, "_slice").agg(F.max("_us").alias("_top"))
        .select(*keys, "_slice", F.max("_top").over(before).alias("_us"), F.lit(True).alias("_carry"))
        .filter("_us is not null")
    )
    merged = rows.unionByName(carry, allowMissingColumns=True)
    order = W.partitionBy(*keys, F.col("_us").isNull(), "_slice").orderBy("_us", F.col("_carry").desc(), "id")
    gap = F.col("_us") - F.lag("_us").over(order)
    return (
        merged.withColumn(out, F.when(gap < horizon, floor_div(gap, SECOND).cast("int")))
        .filter(~F.col("_carry"))
        .select(*payload, out)
    )


def latest_above(values: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """For each row i the latest j < i with ``values[j] > bound[i]``, or -1. Doubling block maxima, O(n log n)."""
    n = len(values)
    maxima = [values]
    while (2 << (len(maxima) - 1)) <= n:
        step = 1 << (len(maxima) - 1)
        wider = maxima[-1].copy()
        wider[step:] = np.maximum(maxima[-1][step:], maxima[-1][:-step])
        maxima.append(wider)
    at = np.arange(n) - 1
    for level in range(len(maxima) - 1, -1, -1):
        skip = (at >= 0) & (maxima[level][np.maximum(at, 0)] <= bound)
        at = np.where(skip, at - (1 << level), at)
    return np.maximum(at, -1)


def with_headway_by_processing(df: DataFrame, horizon_minutes: int = 30, keys: list[str] | None = None,
                               out: str = "headway_seconds", slice_minutes: int | None = None) -> DataFrame:
    """Headway in processing order: the newest row processed within the horizon whose gap is under the horizon.

    Gaps may be negative when trains are reported out of order. Rows are processed in (timestamp, id) order and
    forgotten ``horizon_minutes`` after their timestamp. Each (key, slice) also receives, from the slices one horizon
    back, the rows that no later row of their slice outdoes (a later report with a later arrival always wins): few rows,
    however busy the key is.
    """
    keys = keys or KEYS
    horizon = horizon_minutes * 60 * SECOND
    width = (slice_minutes or horizon_minutes) * 60 * SECOND
    if horizon % width:
        raise ValueError("the horizon must be a whole number of slices")
    payload = [c for c in df.columns if c != out]
    rows = df.select(*payload, micros("timestamp").alias("_us"), micros("arrival_time").alias("_arrival")).withColumn(
        "_slice", floor_div(F.col("_us"), width))
    later = W.partitionBy(*keys, "_slice").orderBy(F.desc("_us"), F.desc("id")).rowsBetween(W.unboundedPreceding, -1)
    leading = (
        rows.filter("_arrival is not null")
        .select(*keys, "id", "_us", "_arrival", "_slice", F.max("_arrival").over(later).alias("_later"))
        .filter("_later is null or _arrival > _later")
        .withColumn("_slice", F.explode(F.sequence(F.col("_slice") + 1, F.col("_slice") + horizon // width)))
        .drop("_later").withColumn("_home", F.lit(False))
    )
    merged = rows.withColumn("_home", F.lit(True)).unionByName(leading, allowMissingColumns=True)
    schema = T.StructType(df.select(*payload).schema.fields + [T.StructField(out, T.IntegerType())])
    missing = np.iinfo(np.int64).min // 2

    def previous(table: pa.Table, starts: np.ndarray) -> pa.Table:
        segment = np.zeros(table.num_rows, dtype="int64")
        segment[starts] = 1
        segment = np.cumsum(segment) - 1
        seen = table["_us"].to_numpy()
        known = table["_arrival"].is_valid().to_numpy()
        arrival = table["_arrival"].fill_null(missing).to_numpy()
        # group number and time since the earliest moment the group can hold, in one sortable number
        clock = segment * (4 * horizon) + seen - table["_slice"].to_numpy() * width + 2 * horizon
        first = np.searchsorted(clock, clock - horizon, side="right")
        at = latest_above(arrival, np.maximum(arrival - horizon, missing))
        found = known & (at >= np.maximum(first, starts[segment]))
        gap = (arrival - arrival[np.maximum(at, 0)]) / SECOND
        value = pa.array(np.trunc(np.where(found, gap, 0)).astype("int32"), mask=~found)
        return table.select(payload).append_column(out, value).filter(table["_home"])

    def undefeated(table: pa.Table) -> pa.Table:
        arrival = table["_arrival"].fill_null(missing).to_numpy()
        later = np.concatenate([np.maximum.accumulate(arrival[::-1])[::-1][1:], [missing]])
        seen = table["_us"].to_numpy()
        keep = (arrival > later) & (seen > seen[-1] - horizon)
        kept = table.filter(pa.array(keep))
        at = kept.schema.get_field_index("_home")
        return kept.set_column(at, kept.schema.field(at), pa.array(np.zeros(kept.num_rows, dtype=bool)))

    return map_sorted_groups(merged, [*keys, "_slice"], ["_us", "id"], previous, schema, undefeated)
