"""Windowed aggregates on a stream of anomalies or detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_hourly_trend(anomalies: DataFrame, ts: str = "detected_at", watermark: str = "30 minutes") -> DataFrame:
    """Count and mean severity per hour; write with output mode ``update`` (or ``append`` for closed hours)."""
    return (
        anomalies.withWatermark(ts, watermark).groupBy(F.window(ts, "1 hour").alias("w"))
        .agg(F.count("*").alias("n"), F.coalesce(F.avg("severity"), F.lit(0.0)).alias("avg_severity"))
        .select(F.col("w.start").alias("hour"), "n", "avg_severity")
    )


def stream_ensemble(detections: DataFrame, watermark: str = "30 minutes", model_order: list[str] | None = None) -> DataFrame:
    """Ensemble grouping per station, line and tumbling five minutes.

    A stream has one aggregation. With the detectors' names in ``model_order`` it keeps a count and the last severity of each (maps
    ``model_counts`` and ``individual_severities``; without the names these maps are empty), so the state per key is bounded
    by the number of detectors. The first features are those of the detector that comes first, then of the lowest
    source position.
    """
    keyed = detections.withWatermark("event_time", watermark)
    models = F.collect_set("model_name")
    names = model_order or []
    own = [F.col("model_name") == n for n in names]
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, names)).cast("array<string>"), F.col("model_name")), F.lit(0))
    rank = F.when(rank == 0, len(names) + 1).otherwise(rank)
    per_model = [F.count_if(o).alias(f"_n{i}") for i, o in enumerate(own)] + [
        F.max_by("severity", F.when(o, F.col("source_position_id"))).alias(f"_s{i}") for i, o in enumerate(own)]

    def by_model(prefix: str, kind: str):
        entries = [F.when(F.col(f"_n{i}") > 0, F.struct(F.lit(n).alias("k"), F.col(f"{prefix}{i}").alias("v"))) for i, n in enumerate(names)]
        return F.map_from_entries(F.array_compact(F.array(*entries))) if entries else F.create_map().cast(f"map<string,{kind}>")
    several = F.col("detection_count") > 1
    return (
        keyed.groupBy("station_id", "line", F.window("event_time", "5 minutes").alias("w"))
        .agg(
            F.count("*").alias("detection_count"), F.max("severity").alias("severity"), models.alias("models"),
            F.min_by(F.struct("anomaly_type", "model_name", "model_version", "features"), F.struct(rank, "source_position_id", "model_name")).alias("_first"),
            *per_model,
        )
        .select(
            "station_id", "line", F.col("w.start").alias("bucket"), "severity", "detection_count",
            F.size("models").alias("distinct_models"), F.array_sort("models").alias("models"),
            F.when(several, F.lit("ensemble")).otherwise(F.col("_first.anomaly_type")).alias("anomaly_type"),
            F.when(several, F.lit("ensemble")).otherwise(F.col("_first.model_name")).alias("model_name"),
            F.when(several, F.concat(F.lit("ensemble_"), F.col("detection_count").cast("string")))
            .otherwise(F.col("_first.model_version")).alias("model_version"),
            F.col("_first.features").alias("features"), by_model("_n", "bigint").alias("model_counts"),
            by_model("_s", "double").alias("individual_severities"),
        )
    )
