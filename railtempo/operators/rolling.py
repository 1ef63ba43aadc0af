"""Rolling statistics over a time frame ``(t - length, t]`` per key.

A sliding SQL frame re-reads its whole frame for each row and puts a key into one task. Here time is cut into slices, and a
frame is put together from three parts: the rows so far in the row's own slice, whole slices before it, and what the slice where
the frame begins still has after that moment. The first and the last are running aggregates, forwards and backwards, over the rows of one
(key, slice); the slice that the frame leaves is sent along, shifted by the frame's length. Parts are counts, sums and sums of squared
deviations, and are only ever added: nothing is subtracted again, so a large value leaves no trace in frames without it. Work is
linear, and a busy key is spread over all its slices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railtempo.functions.scalar import HOUR, floor_div, micros
from railtempo.operators.segments import map_sorted_groups
from railtempo.schemas import METRIC_COLUMNS

KEYS = ["current_station", "direction"]
EPSILON = 1e-7
ROWS_PER_TASK = 250_000  # of frames, payload and copies: two sorts of them lie in a task's memory at once


def _whole(df: DataFrame, columns: list[str]) -> list[bool]:
    """Whether each column holds whole numbers."""
    kinds, whole = dict(df.dtypes), ("tinyint", "smallint", "int", "bigint")
    for c in columns:
        if not (kinds[c] in (*whole, "float", "double") or kinds[c].startswith("decimal")):
            raise TypeError(f"{c} is {kinds[c]}, not a number")
    return [kinds[c] in whole for c in columns]


def _whole_slices(totals: DataFrame, columns: int, slices: list[int], keys: list[str]) -> DataFrame:
    """Per key and slice the array ``_between``: for each frame and column the moments of the whole slices before it that the frame holds."""
    key_list = ", ".join(f"`{k}`" for k in keys)
    parts = ", ".join(f"_{p}{i}" for i in range(columns) for p in "nsq")
    lists = [
        f"collect_list(struct({parts})) over (partition by {key_list} order by _slice range between {m - 1} preceding and 1 preceding) as _l{f}"
        if m > 1 else f"filter(array(struct({parts})), v -> false) as _l{f}" for f, m in enumerate(slices)]
    added = [f"aggregate(_l{f}, 0D, (a, v) -> a + v._{p}{i}) as _{p}{f}_{i}" for f in range(len(slices)) for i in range(columns) for p in "ns"]
    merged = ", ".join(
        f"""struct(_n{f}_{i} as n, _s{f}_{i} as s, aggregate(_l{f}, 0D,
          (a, v) -> a + v._q{i} + if(v._n{i} > 0, v._n{i} * pow(v._s{i} / v._n{i} - _s{f}_{i} / _n{f}_{i}, 2), 0D)) as q)"""
        for f in range(len(slices)) for i in range(columns))
    named = [f"`{k}`" for k in keys] + ["_slice"]
    listed = totals.selectExpr(*named, *lists)
    return listed.selectExpr(*named, *[f"_l{f}" for f in range(len(slices))], *added).selectExpr(*named, f"array({merged}) as _between")


def _frame_moments(df: DataFrame, columns: list[str], frames: dict[str, int], keys: list[str], ts: str,
                   slice_micros: int) -> DataFrame:
    """Rows of ``df`` with ``_n_<frame>_<i>``, ``_m_...`` and ``_q_...``: count, mean and sum of squared deviations of each column in
    each frame."""
    if any(length % slice_micros for length in frames.values()):
        raise ValueError("each frame length must be a whole number of slices")
    _whole(df, columns)
    key_list, few = ", ".join(f"`{k}`" for k in keys), range(len(columns))
    timed = df.selectExpr("*", *[f"double(`{c}`) as _x{i}" for i, c in enumerate(columns)]).withColumn("_t0", micros(ts))
    values = [f"_x{i}" for i in few]
    # own row (kind 0) and one narrow copy per frame (kind 1, 2, ...) at the moment the row leaves that frame
    shifts = ", ".join(f"{length}L" for length in frames.values())
    emitted = timed.selectExpr("*", f"posexplode(array(0L, {shifts})) as (_kind, _shift)").selectExpr(
        *[f"`{k}`" for k in keys], *[f"if(_kind = 0, `{c}`, null) as `{c}`" for c in df.columns if c not in keys], *values,
        "_kind", "_t0 + _shift as _t",
    ).withColumn("_slice", floor_div(F.col("_t"), slice_micros))
    totals = timed.withColumn("_slice", floor_div(F.col("_t0"), slice_micros)).groupBy(*keys, "_slice").agg(
        *[agg for i in few for agg in (
            F.count(f"_x{i}").cast("double").alias(f"_n{i}"), F.coalesce(F.sum(f"_x{i}"), F.lit(0.0)).alias(f"_s{i}"),
            F.coalesce(F.var_pop(f"_x{i}") * F.count(f"_x{i}"), F.lit(0.0)).alias(f"_q{i}"))])
    between = _whole_slices(totals, len(columns), [length // slice_micros for length in frames.values()], keys)
    carry = between.selectExpr(*[f"`{k}`" for k in keys], "-1 as _kind", f"_slice * {slice_micros}L - 1 as _t", "_slice", "_between")
    merged = emitted.unionByName(carry, allowMissingColumns=True)
    # a number of partitions that follows the rows keeps a task's share the same; Spark only ever merges the session's
    tasks = -(-df.count() * (1 + len(frames)) // ROWS_PER_TASK)
    if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        merged = merged.repartition(tasks, *keys, "_slice")
    forwards = f"(partition by {key_list}, _slice order by _t range between unbounded preceding and current row)"
    backwards = f"(partition by {key_list}, _slice order by _t desc range between unbounded preceding and 1 preceding)"

    def running(kind: int, over: str) -> list[str]:
        own = [f"if(_kind = {kind}, {x}, null)" for x in values]
        return [text for i, x in enumerate(own) for text in (
            f"count({x}) over {over} as _n{kind}_{i}", f"sum({x}) over {over} as _s{kind}_{i}", f"var_pop({x}) over {over} as _v{kind}_{i}")]

    seen = merged.selectExpr("*", f"first(_between, true) over {forwards} as _whole", *running(0, forwards), *[
        text for kind in range(1, len(frames) + 1) for text in running(kind, backwards)]).filter("_kind = 0")

    def parts(kind: int, i: int) -> list[tuple[str, str, str]]:
        """(count, sum, squared deviations) of a frame's three parts."""
        whole = f"_whole[{(kind - 1) * len(columns) + i}]"
        ends = [(f"_n{k}_{i}", f"coalesce(_s{k}_{i}, 0D)", f"coalesce(_v{k}_{i} * _n{k}_{i}, 0D)") for k in (0, kind)]
        return [*ends, (f"{whole}.n", f"{whole}.s", f"{whole}.q")]

    each = [(label, kind, i) for kind, label in enumerate(frames, start=1) for i in few]
    counted = seen.selectExpr("*", *[f"{' + '.join(n for n, _, _ in parts(kind, i))} as _n_{label}_{i}" for label, kind, i in each])
    meant = counted.selectExpr("*", *[
        f"if(_n_{label}_{i} > 0, ({' + '.join(s for _, s, _ in parts(kind, i))}) / _n_{label}_{i}, null) as _m_{label}_{i}" for label, kind, i in each])
    apart = "{q} + if({n} > 0, {n} * pow({s} / {n} - {m}, 2), 0D)".format
    return meant.selectExpr(*[f"`{c}`" for c in df.columns], *[f"_{p}_{label}_{i}" for label, _, i in each for p in "nm"], *[
        f"{' + '.join(apart(n=n, s=s, q=q, m=f'_m_{label}_{i}') for n, s, q in parts(kind, i))} as _q_{label}_{i}" for label, kind, i in each])


def _slice_length(frames: dict[str, int], slice_minutes: int | None) -> int:
    if slice_minutes:
        return slice_minutes * 60_000_000
    return int(np.gcd.reduce(list(frames.values())))


def with_rolling(
    df: DataFrame,
    columns: list[str] | None = None,
    zscore_hours: int | None = 1,
    stat_hours: tuple[int, ...] = (3, 6, 12, 24),
    keys: list[str] | None = None,
    ts: str = "timestamp",
    slice_minutes: int | None = None,
) -> DataFrame:
    """Z-score over ``zscore_hours`` and mean and deviation over each of ``stat_hours``, of numbers of any kind and size.

    Nulls don't count; NaN, infinity and squares beyond a double spoil the frames that hold them and no others. Rows with a null key get null features. ``slice_minutes`` (default: the frames' common divisor) sets how finely a
    busy key is spread; it must divide every frame.
    """
    columns = columns or METRIC_COLUMNS
    keys = keys or KEYS
    hours = ([zscore_hours] if zscore_hours else []) + [h for h in stat_hours if h != zscore_hours]
    frames = {f"{h}h": h * HOUR for h in hours}
    width = _slice_length(frames, slice_minutes)
    rows = _frame_moments(df, columns, frames, keys, ts, width)
    keyed = " and ".join(f"`{k}` is not null" for k in keys)
    std = "if(_n_{0}h_{1} > 1, sqrt(_q_{0}h_{1} / (_n_{0}h_{1} - 1)), null)".format
    out = []
    for i, c in enumerate(columns):
        if zscore_hours:
            z = f"(`{c}` - _m_{zscore_hours}h_{i}) / ({std(zscore_hours, i)} + {EPSILON!r}D)"
            out.append(f"if({keyed}, {z}, null) as `{c}_zscore`")
        for h in stat_hours:
            out.append(f"if({keyed}, _m_{h}h_{i}, null) as `{c}_rolling_{h}h_mean`")
            out.append(f"if({keyed}, {std(h, i)}, null) as `{c}_rolling_{h}h_std`")
    return rows.selectExpr(*[f"`{c}`" for c in df.columns], *out)


def with_station_rolling(df: DataFrame, columns: list[str] | None = None, hours: int = 1, ts: str = "timestamp",
                         slice_minutes: int | None = None) -> DataFrame:
    """Mean and deviation per station alone."""
    columns = columns or METRIC_COLUMNS
    wide = with_rolling(df, columns, None, (hours,), ["current_station"], ts, slice_minutes)
    for c in columns:
        wide = wide.withColumnRenamed(f"{c}_rolling_{hours}h_mean", f"{c}_rolling_mean")
        wide = wide.withColumnRenamed(f"{c}_rolling_{hours}h_std", f"{c}_rolling_std")
    return wide


def weighted_counts_before(segment: np.ndarray, values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per element, the weight of earlier elements of its segment with a smaller and with an equal value.

    ``segment`` is ascending. Bottom-up over blocks of doubling width inside each segment: at each width the left half of
    every pair is counted for the right half.
    """
    n = len(values)
    smaller, equal = np.zeros(n), np.zeros(n)
    if n == 0:
        return smaller, equal
    order = np.lexsort((values, segment))
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (np.diff(segment[order]) != 0) | (np.diff(values[order]) != 0)
    rank = np.empty(n, dtype="int64")
    rank[order] = np.cumsum(fresh) - 1
    lowest = np.full(int(segment.max()) + 1, n, dtype="int64")
    np.minimum.at(lowest, segment, rank)
    lowest = lowest[segment]
    span = n + 1
    at = np.arange(n) - np.searchsorted(segment, segment)
    width = 1
    while width <= at.max():
        pair = at // (2 * width)
        right = (at // width) % 2 == 1
        code = pair * span + rank
        order = np.argsort(code, kind="stable")
        ordered = code[order]
        left_weight = np.concatenate(([0.0], np.cumsum(np.where(right, 0.0, weights)[order])))
        begin = left_weight[np.searchsorted(ordered, (pair * span + lowest)[right])]
        low = left_weight[np.searchsorted(ordered, code[right])]
        high = left_weight[np.searchsorted(ordered, code[right], side="right")]
        smaller[right] += low - begin
        equal[right] += high - low
        width *= 2
    return smaller, equal


def with_rolling_percentile(
    df: DataFrame,
    columns: list[str] | None = None,
    hours: int = 1,
    keys: list[str] | None = None,
    ts: str = "timestamp",
    slice_minutes: int | None = None,
) -> DataFrame:
    """Average rank of the current value among the non-null values of the frame, divided by their number.

    Work is grouped by (key, slice). A group sees, in order of time, what is in the frame when the slice begins (rows of
    the slice one frame back, and for slices shorter than the frame a histogram of those in between), then its own rows
    as they enter and the earlier ones as they leave. A long group is ranked piece by piece; between pieces only the
    distinct values in the frame are kept. ``slice_minutes`` spreads a busy key over more tasks.
    """
    columns = columns or METRIC_COLUMNS
    keys = keys or KEYS
    length = hours * HOUR
    width = _slice_length({"f": length}, slice_minutes)
    if length % width:
        raise ValueError("the frame length must be a whole number of slices")
    reach = length // width
    at = micros(ts)
    home_slice = floor_div(at, width)
    payload = df.columns
    measures = [f"_v{i}" for i in range(len(columns))]
    keyed = ~F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    rows = df.select(
        *payload, at.alias("_t0"), home_slice.alias("_slice0"),
        *[F.col(c).cast("long" if whole else "double").alias(m) for c, m, whole in zip(columns, measures, _whole(df, columns))],
    )
    # own rows, and the same rows where they leave the frame: there once from the slice's begin and once when they go.
    # Null keys get null results and need no copy
    own, leaves, there = 0, 1, 2
    kinds = F.when(keyed, F.array(F.lit(own), F.lit(leaves), F.lit(there))).otherwise(F.array(F.lit(own)))
    spread = rows.withColumn("_kind", F.explode(kinds))
    others = [c for c in payload if c not in keys]
    kind = F.col("_kind")
    moved = F.when(kind == own, F.col("_slice0")).otherwise(F.col("_slice0") + reach)
    merged = spread.select(
        *keys, *[F.when(kind == own, F.col(c)).alias(c) for c in others],
        F.when(kind == own, F.col("_t0")).when(kind == leaves, F.col("_t0") + length).otherwise(moved * width - 1).alias("_t"),
        moved.alias("_slice"), "_kind", F.lit(1).cast("long").alias("_w"), *measures,
    )
    if reach > 1:
        long = rows.filter(keyed).select(
            *keys, F.col("_slice0").alias("_slice"),
            F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(m).alias("v")) for i, m in enumerate(measures)])).alias("_m"),
        ).filter("_m.v is not null")
        between = (
            long.groupBy(*keys, "_slice", "_m").agg(F.count("*").alias("_w"))
            .withColumn("_step", F.explode(F.sequence(F.lit(1), F.lit(int(reach) - 1))))
            .select(
                *keys, (F.col("_slice") + F.col("_step")).alias("_slice"), F.lit(there).alias("_kind"), "_w",
                ((F.col("_slice") + F.col("_step")) * width - 1).alias("_t"),
                *[F.when(F.col("_m.i") == i, F.col("_m.v")).alias(m) for i, m in enumerate(measures)],
            )
        )
        # only slices that hold rows need a histogram
        occupied = rows.filter(keyed).select(*keys, F.col("_slice0").alias("_slice")).distinct()
        between = between.join(occupied, [*keys, "_slice"], "left_semi")
        merged = merged.unionByName(between, allowMissingColumns=True)
    names = [f"{c}_percentile" for c in columns]
    schema = T.StructType(df.schema.fields + [T.StructField(n, T.DoubleType()) for n in names])

    def keyed_rows(table: pa.Table) -> np.ndarray:
        found = np.ones(table.num_rows, dtype=bool)
        for k in keys:
            found &= table[k].is_valid().to_numpy()
        return found

    def rank_groups(table: pa.Table, starts: np.ndarray) -> pa.Table:
        segment = np.zeros(table.num_rows, dtype="int64")
        segment[starts] = 1
        segment = np.cumsum(segment) - 1
        kind = table["_kind"].to_numpy()
        in_key = keyed_rows(table)
        t = table["_t"].fill_null(0).to_numpy()
        w = table["_w"].to_numpy().astype("float64")
        result = table.select(payload).filter(pa.array(kind == own))
        for name, measure in zip(names, measures):
            known = table[measure].is_valid().to_numpy() & in_key
            v = table[measure].fill_null(0).to_numpy()
            enter, gone, begun = (np.flatnonzero(known & (kind == k)) for k in (own, leaves, there))
            # own rows enter, others leave, and only then own rows ask, so that rows of the same instant count
            source = np.concatenate([begun, gone, enter, enter])
            stage = np.repeat([0, 1, 1, 2], [len(begun), len(gone), len(enter), len(enter)])
            moment = np.where(stage == 0, np.iinfo(np.int64).min, t[source])
            weight = np.concatenate([w[begun], -w[gone], w[enter], np.zeros(len(enter))])
            order = np.lexsort((stage, moment, segment[source]))
            source, weight, asks = source[order], weight[order], stage[order] == 2
            part = segment[source]
            smaller, equal = weighted_counts_before(part, v[source], weight)
            running = np.cumsum(weight)
            begins = np.searchsorted(part, part)
            present = running - np.where(begins > 0, running[np.maximum(begins - 1, 0)], 0.0)
            share = np.full(table.num_rows, np.nan)
            share[source[asks]] = (smaller[asks] + (equal[asks] + 1) / 2) / present[asks]
            own_share = share[kind == own]
            result = result.append_column(name, pa.array(own_share, mask=np.isnan(own_share)))
        return result

    def in_frame(table: pa.Table) -> pa.Table:
        """The values in the frame after the rows of one group, with how often each is there."""
        kind = table["_kind"].to_numpy()
        weight = np.where(kind == leaves, -1, 1) * table["_w"].to_numpy()
        in_key = keyed_rows(table)
        pieces = []
        for measure in measures:
            known = table[measure].is_valid().to_numpy() & in_key
            values, place = np.unique(table[measure].fill_null(0).to_numpy()[known], return_inverse=True)
            count = np.bincount(place, weights=weight[known], minlength=len(values)).astype("int64")
            pieces.append((measure, values[count != 0], count[count != 0]))
        n = sum(len(values) for _, values, _ in pieces)
        last = table.slice(table.num_rows - 1)
        columns_of = {}
        for field in table.schema:
            if field.name in (*keys, "_slice", "_task"):
                columns_of[field.name] = pa.chunked_array([last[field.name].combine_chunks().take(pa.array(np.zeros(n, dtype="int64")))], field.type)
            elif field.name == "_kind":
                columns_of[field.name] = pa.array(np.full(n, there), field.type)
            elif field.name == "_t":
                columns_of[field.name] = pa.array(np.full(n, last["_slice"][0].as_py() * width - 1), field.type) if n else pa.array([], field.type)
            elif field.name == "_w":
                columns_of[field.name] = pa.array(np.concatenate([count for _, _, count in pieces]), field.type)
            elif field.name in measures:
                parts = [pa.array(values, field.type) if m == field.name else pa.nulls(len(values), field.type) for m, values, _ in pieces]
                columns_of[field.name] = pa.concat_arrays(parts)
            else:
                columns_of[field.name] = pa.nulls(n, field.type)
        return pa.table(columns_of, schema=table.schema)

    return map_sorted_groups(merged, [*keys, "_slice"], ["_t"], rank_groups, schema, in_frame, "_t")


def with_global_zscore(df: DataFrame, column: str) -> DataFrame:
    """Fallback z-score over all rows with the sample deviation."""
    stats = df.agg(F.struct(F.avg(column).alias("m"), F.stddev_samp(column).alias("s"))).scalar()
    return df.withColumn(f"{column}_zscore", (F.col(column) - stats.getField("m")) / (stats.getField("s") + EPSILON))
