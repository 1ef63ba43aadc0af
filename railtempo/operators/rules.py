"""Rule detectors with the common detection schema; they need no training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railtempo.functions import scalar as fx
from railtempo.schemas import DETECTION_COLUMNS


def as_detections(df: DataFrame, kind: Column, severity: Column, model: str, version: Column | str,
                  feature_columns: list[str], extra: dict[str, Column] | None = None) -> DataFrame:
    """Scored positions in the detection schema."""
    meta = [F.lit("trip_id"), F.col("trip_id"), F.lit("route_id"), F.col("route_id"),
            F.lit("timestamp"), fx.iso_text("timestamp")]
    for name, value in (extra or {}).items():
        meta += [F.lit(name), value.cast("string")]
    out = df.select(
        F.col("current_station").alias("station_id"), "line", kind.alias("anomaly_type"), severity.alias("severity"),
        F.lit(model).alias("model_name"), (F.lit(version) if isinstance(version, str) else version).alias("model_version"),
        fx.non_null_map(feature_columns).alias("features"), F.create_map(*meta).alias("meta_data"),
        F.col("id").alias("source_position_id"), F.col("timestamp").cast("timestamp").alias("event_time"),
    )
    return out.select(*DETECTION_COLUMNS)


def delay_rule(df: DataFrame, limit: int = 300) -> DataFrame:
    """Positions whose delay is beyond ``limit`` seconds either way."""
    size = F.abs("delay_seconds")
    return as_detections(df.filter(size > limit), F.lit("delay"), F.least(F.lit(1.0), size / 1800), "delay_rule", "v1",
                         ["delay_seconds"])


def zscore_rule(df: DataFrame, column: str = "delay_seconds_zscore", limit: float = 2.0) -> DataFrame:
    """Positions whose rolling z-score is beyond ``limit`` either way."""
    size = F.abs(column)
    return as_detections(df.filter(size > limit), F.lit("zscore"), F.least(F.lit(1.0), size / 10), "zscore_rule", "v1",
                         ["delay_seconds"])
