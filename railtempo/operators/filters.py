"""Row selection: optional filters, time ranges, validation, newest rows and pages."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from railtempo.functions import scalar as fx

# Named time ranges in hours.
PRESETS = {"1H": 1, "6H": 6, "24H": 24, "7D": 168}


def anomaly_filter(
    df: DataFrame,
    line: str | None = None,
    station_id: str | None = None,
    resolved: bool | None = None,
    start: datetime | Column | None = None,
    end: datetime | Column | None = None,
    ts: str = "detected_at",
) -> DataFrame:
    """Conjunction of the given conditions; absent ones do not filter; time bounds are inclusive."""
    conditions = []
    if line:
        conditions.append(F.col("line") == line)
    if station_id:
        conditions.append(F.col("station_id") == station_id)
    if resolved is not None:
        conditions.append(F.col("resolved") == F.lit(resolved))
    if start is not None:
        conditions.append(F.col(ts) >= _bound(start, df, ts))
    if end is not None:
        conditions.append(F.col(ts) <= _bound(end, df, ts))
    return df.filter(reduce(lambda a, b: a & b, conditions)) if conditions else df


def _bound(value: datetime | Column, df: DataFrame, ts: str) -> Column:
    # same type on both sides: otherwise the column is cast and the predicate cannot reach the file scan
    kind = df.schema[ts].dataType.simpleString()
    return (F.lit(value) if not isinstance(value, Column) else value).cast(kind)


def latest(df: DataFrame, ts: str, minus: str | None = None) -> Column:
    """Newest timestamp, optionally less an interval, as a scalar subquery computed in one pass."""
    newest = F.max(ts)
    return df.agg((newest - F.expr(f"interval {minus}") if minus else newest).alias("t")).scalar()


def by_id(df: DataFrame, key: int) -> DataFrame:
    return df.filter(F.col("id") == key)


def since(df: DataFrame, start: datetime | Column, line: str | None = None, ts: str = "timestamp") -> DataFrame:
    """Rows from ``start`` on, of one line if given. Sort the (small) result with :func:`time_ordered` if needed."""
    out = df.filter(F.col(ts) >= _bound(start, df, ts))
    return out.filter(F.col("line") == line) if line else out


def time_ordered(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.orderBy(ts, "id")


def training_range(df: DataFrame, start: datetime | Column, end: datetime | Column, ts: str = "timestamp") -> DataFrame:
    inside = (F.col(ts) >= _bound(start, df, ts)) & (F.col(ts) <= _bound(end, df, ts))
    return df.filter(inside & F.col("headway_seconds").isNotNull())


def last_hours(df: DataFrame, hours: int = 24, ts: str = "timestamp", as_of: datetime | None = None) -> DataFrame:
    """Rows of the last ``hours`` before ``as_of`` (default: the newest row), both ends inclusive."""
    if as_of is None:
        return df.filter(F.col(ts) >= latest(df, ts, f"{hours} hours"))
    end = F.lit(as_of)
    return df.filter((F.col(ts) >= _bound(end - F.expr(f"interval {hours} hours"), df, ts)) & (F.col(ts) <= _bound(end, df, ts)))


def lookback(df: DataFrame, minutes: int = 60, ts: str = "timestamp", as_of: datetime | Column | None = None) -> DataFrame:
    if not 10 <= minutes <= 360:
        raise ValueError("lookback must be 10 to 360 minutes")
    return last_minutes(df, minutes, ts, as_of)


def last_minutes(df: DataFrame, minutes: int, ts: str = "timestamp", as_of: datetime | Column | None = None) -> DataFrame:
    """Rows of the last ``minutes`` before ``as_of`` (default: the newest row), both ends inclusive."""
    if as_of is None:
        return df.filter(F.col(ts) >= latest(df, ts, f"{minutes} minutes"))
    end = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return df.filter((F.col(ts) >= _bound(end - F.expr(f"interval {minutes} minutes"), df, ts)) & (F.col(ts) <= _bound(end, df, ts)))


def preset(df: DataFrame, name: str, ts: str = "detected_at", as_of: datetime | None = None) -> DataFrame:
    return last_hours(df, PRESETS[name], ts, as_of)


def preset_counts(df: DataFrame, ts: str = "detected_at") -> DataFrame:
    """(preset, n): rows of the last hours of every preset before the newest row, in one pass: rows are counted by the preset that first
    holds them, and presets add up from the shortest. The newest row's instant is a scalar subquery."""
    hours = sorted(PRESETS.items(), key=lambda p: p[1])
    age = latest(df, ts, "0 hours")
    first = F.coalesce(*[F.when(F.col(ts) >= age - F.expr(f"interval {h} hours"), F.lit(i)) for i, (_, h) in enumerate(hours)])
    counted = df.groupBy(first.alias("_first")).agg(F.count("*").alias("_n")).agg(
        *[F.coalesce(F.sum(F.when(F.col("_first") <= i, F.col("_n"))), F.lit(0)).alias(name) for i, (name, _) in enumerate(hours)])
    return counted.select(F.explode(F.map_from_arrays(
        F.array(*[F.lit(n) for n, _ in hours]), F.array(*[F.col(f"`{n}`") for n, _ in hours]))).alias("preset", "n"))


def with_violations(df: DataFrame) -> DataFrame:
    """Array of the names of violated rules; only rules whose columns exist are checked."""
    rules = {
        "lat": ("lat", lambda c: c.between(-90, 90)),
        "lon": ("lon", lambda c: c.between(-180, 180)),
        "direction": ("direction", lambda c: c.between(0, 1)),
        "severity": ("severity", lambda c: c.between(0, 1)),
        "id": ("id", lambda c: c.isNotNull()),
        "trip_id": ("trip_id", lambda c: c.isNotNull()),
        "route_id": ("route_id", lambda c: c.isNotNull()),
        "line_required": ("line", lambda c: c.isNotNull()),
        "type_required": ("anomaly_type", lambda c: c.isNotNull()),
    }
    if "trip_id" not in df.columns:
        rules.pop("line_required")
    checks = [F.when(~F.coalesce(ok(F.col(c)), F.lit(False)), F.lit(name)) for name, (c, ok) in rules.items() if c in df.columns]
    return df.withColumn("violations", F.array_compact(F.array(*checks)))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = with_violations(df)
    return checked.filter(F.size("violations") == 0).drop("violations"), checked.filter(F.size("violations") > 0)


def enough_samples(df: DataFrame, sequence_length: int | None = None, least: int = 100) -> bool:
    """At least ``least`` rows, and ten times the sequence length for sequence models. Reads no more than needed."""
    wanted = max(least, 10 * sequence_length) if sequence_length else least
    return df.limit(wanted).count() >= wanted


def newest(df: DataFrame, n: int, ts: str = "timestamp") -> DataFrame:
    return df.orderBy(F.desc(ts), F.desc("id")).limit(n)


def newest_of_line(df: DataFrame, line: str, n: int = 50, ts: str = "timestamp") -> DataFrame:
    return newest(df.filter(fx.same_line("line", F.lit(line))), n, ts)


def newest_per_line(df: DataFrame, n: int = 50, ts: str = "timestamp") -> DataFrame:
    """Newest ``n`` rows of every line; the rank limit is applied before the shuffle as well."""
    order = W.partitionBy("line").orderBy(F.desc(ts), F.desc("id"))
    return df.withColumn("line_rank", F.row_number().over(order)).filter(F.col("line_rank") <= n)


def page(df: DataFrame, number: int = 1, size: int = 50, ts: str = "detected_at") -> DataFrame:
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("page starts at 1 and size is 1 to 100")
    return df.orderBy(F.desc(ts), F.desc("id")).offset((number - 1) * size).limit(size)


def _instant(value: int, df: DataFrame, ts: str) -> Column:
    return _bound(F.timestamp_micros(F.lit(value)), df, ts)


def located_page(df: DataFrame, number: int = 1, size: int = 50, ts: str = "detected_at", enough: int = 10_000) -> DataFrame:
    """The rows of :func:`page`, found by counts instead of a sort of all rows before them.

    Rows are counted by day, then by hour, minute and second inside the days, hours and minutes that hold the page, until those hold no
    more than ``enough`` rows. Only these counts reach the driver: days once, then at most 60 for each of the buckets that
    one page can touch. The result's plan has a time range and a bounded sort, for page 1 as for page 100,000. Rows without a time
    are on no page; a page behind the last row is empty.
    """
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("page starts at 1 and size is 1 to 100")
    skip, inside, rows = (number - 1) * size, df.filter(F.col(ts).isNotNull()), None
    for seconds in (86_400, 3_600, 60, 1):
        width = seconds * 1_000_000
        bucket = fx.floor_div(fx.micros(ts), width)
        counts = sorted(((r["b"], r["n"]) for r in inside.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
        held, before = [], 0
        for b, n in counts:
            if before + n > skip and before < skip + size:
                held.append((b, n, before))
            before += n
        if not held:
            return df.limit(0)
        skip, rows = skip - held[0][2], sum(n for _, n, _ in held)
        inside = df.filter((F.col(ts) >= _instant(held[-1][0] * width, df, ts)) & (F.col(ts) < _instant((held[0][0] + 1) * width, df, ts)))
        if rows <= enough:
            break
    first = inside.orderBy(F.desc(ts), F.desc("id")).limit(skip + size)
    order = W.orderBy(F.desc(ts), F.desc("id"))  # over the few rows up to the page's end
    return first.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") > skip).drop("_at")


def page_after(df: DataFrame, last_ts: datetime | Column, last_id: int, size: int = 50, ts: str = "detected_at") -> DataFrame:
    """The page after the row (``last_ts``, ``last_id``): nothing is counted or skipped, whatever lies before."""
    at = _bound(last_ts, df, ts)
    older = (F.col(ts) < at) | ((F.col(ts) == at) & (F.col("id") < last_id))
    return newest(df.filter((F.col(ts) <= at) & older), size, ts)
