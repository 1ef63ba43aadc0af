"""Dashboard aggregates over the anomaly table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railtempo.functions import scalar as fx
from railtempo.operators.filters import anomaly_filter, latest

BANDS = ["low", "medium", "high"]


def _range(df: DataFrame, hours: int, as_of: datetime | None):
    if not 1 <= hours <= 168:
        raise ValueError("hours must be 1 to 168")
    if as_of is None:
        return latest(df, "detected_at", f"{hours} hours"), latest(df, "detected_at")
    return F.lit(as_of) - F.expr(f"interval {hours} hours"), F.lit(as_of)


def in_range(df: DataFrame, hours: int = 24, as_of: datetime | None = None) -> DataFrame:
    start, end = _range(df, hours, as_of)
    return anomaly_filter(df, start=start, end=end)


def count_today(df: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Detected since midnight of the reference day, whatever the range."""
    day = fx.day_floor(F.lit(as_of) if as_of else latest(df, "detected_at"))
    return df.agg(F.count_if(F.col("detected_at") >= day.cast(df.schema["detected_at"].dataType)).alias("total_today"))


def count_active(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(~F.col("resolved")).alias("total_active"))


def count_by_type(df: DataFrame) -> DataFrame:
    return df.groupBy("anomaly_type").agg(F.count("*").alias("n"))


def count_by_line(df: DataFrame) -> DataFrame:
    return df.filter("line is not null").groupBy("line").agg(F.count("*").alias("n"))


def severity_histogram(df: DataFrame) -> DataFrame:
    """Count per severity band; bands without rows appear with 0."""
    counted = df.agg(*[F.count_if(fx.severity_class("severity") == b).alias(b) for b in BANDS])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("n")) for b in BANDS])).alias("r")).select("r.*")


def hourly_trend(df: DataFrame) -> DataFrame:
    return df.groupBy(fx.hour_floor("detected_at").alias("hour")).agg(
        F.count("*").alias("n"), F.coalesce(F.avg("severity"), F.lit(0.0)).alias("avg_severity"))


def dashboard_summary(df: DataFrame, hours: int = 24, as_of: datetime | None = None) -> DataFrame:
    """All dashboard figures as (section, label, n, avg_severity) from one scan.

    The scan is reduced to cells of (day or older, hour, type, line, band, resolved) counts before grouping sets spread
    them over the sections, so the expansion works on few rows.
    """
    start, end = _range(df, hours, as_of)
    kind = df.schema["detected_at"].dataType
    at = F.col("detected_at")
    today = fx.day_floor(end).cast(kind)
    marked = df.select(
        ((at >= start.cast(kind)) & (at <= end.cast(kind))).alias("inside"),
        (at >= today).alias("today"),
        (~F.col("resolved")).alias("active"),
        "anomaly_type", "line", fx.severity_class("severity").alias("band"), fx.hour_floor(at).alias("hour"), "severity",
    )
    cells = marked.groupBy("inside", "today", "active", "anomaly_type", "line", "band",
                           F.when(F.col("inside"), F.col("hour")).alias("hour")).agg(
        F.count("*").alias("n"), F.sum("severity").alias("s"), F.count("severity").alias("k"))
    inside = F.col("inside")
    entries = [
        F.when(F.col("today"), F.struct(F.lit("total_today").alias("section"), F.lit("").alias("label"))),
        F.when(F.col("active"), F.struct(F.lit("total_active").alias("section"), F.lit("").alias("label"))),
        F.when(inside, F.struct(F.lit("by_type").alias("section"), F.col("anomaly_type").alias("label"))),
        F.when(inside & F.col("line").isNotNull(), F.struct(F.lit("by_line").alias("section"), F.col("line").alias("label"))),
        F.when(inside, F.struct(F.lit("severity").alias("section"), F.col("band").alias("label"))),
        F.when(inside, F.struct(F.lit("trend").alias("section"), F.date_format("hour", "yyyy-MM-dd HH").alias("label"))),
    ]
    spread = cells.select(F.explode(F.array_compact(F.array(*entries))).alias("e"), "n", "s", "k").select("e.*", "n", "s", "k")
    fixed = df.sparkSession.createDataFrame(
        [("total_today", "", 0), ("total_active", "", 0)] + [("severity", b, 0) for b in BANDS],
        "section string, label string, n long",
    ).select("section", "label", "n", F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("k"))
    return spread.unionByName(fixed).groupBy("section", "label").agg(
        F.sum("n").alias("n"),
        F.when(F.col("section") == "trend", F.coalesce(F.sum("s") / F.nullif(F.sum("k"), F.lit(0)), F.lit(0.0))).alias("avg_severity"))


def page_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def station_rollup(df: DataFrame) -> DataFrame:
    """Count, highest severity, marker band and size per station."""
    return (
        df.filter("station_id is not null and station_id <> ''").groupBy("station_id")
        .agg(F.count("*").alias("n"), F.max("severity").alias("max_severity"))
        .withColumns({"band": fx.marker_band("max_severity"), "size": fx.marker_size("max_severity")})
    )


def station_details(df: DataFrame) -> DataFrame:
    """The entries of each station's pop-up, one row per kind and shown severity with its number of anomalies."""
    return (
        df.filter("station_id is not null and station_id <> ''")
        .groupBy("station_id", "anomaly_type", fx.percent_text("severity").alias("shown"),
                 fx.marker_band("severity").alias("band"))
        .agg(F.count("*").alias("n"))
    )


def map_markers(df: DataFrame, stations: DataFrame) -> DataFrame:
    """Station rollup at the station's coordinates."""
    from railtempo.operators.matching import with_station_defaults

    return with_station_defaults(station_rollup(df), stations, "station_id")


def axis_top(df: DataFrame) -> DataFrame:
    """Top of the severity axis: the maximum, 1 if there is none or it is 0."""
    return df.agg(F.coalesce(F.nullif(F.max("severity"), F.lit(0.0)), F.lit(1.0)).alias("top"))
