"""Feature columns as ``df.transform`` steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railtempo.functions import scalar as fx


def with_trip_features(df: DataFrame) -> DataFrame:
    """Line, direction, delay and dwell of flattened stop rows."""
    return df.withColumns({
        "line": fx.line_of_route("route_id"),
        "direction": F.coalesce("direction", F.lit(0)),
        "delay_seconds": fx.delay_or_zero("delay_seconds"),
        "dwell_time_seconds": fx.dwell_seconds("arrival_time", "departure_time"),
    })


def with_calendar(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Hour, weekday, weekend, rush hour and minute of day."""
    return df.withColumns({
        "hour": fx.hour_of(ts),
        "day_of_week": fx.weekday_of(ts),
        "is_weekend": fx.weekend(ts).cast("int"),
        "is_rush_hour": fx.rush_hour(ts).cast("int"),
        "minutes_since_midnight": fx.minute_of_day(ts),
    })


def zero_filled(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.fillna(0, subset=columns)


# The columns that scoring reads.
SCORING_COLUMNS = [
    "id", "timestamp", "trip_id", "route_id", "line", "current_station",
    "headway_seconds", "dwell_time_seconds", "delay_seconds", "direction",
]


def scoring_projection(df: DataFrame) -> DataFrame:
    return df.select(*SCORING_COLUMNS)


# Columns that never enter a model, and the base model columns.
NON_FEATURES = ["timestamp", "id", "trip_id", "route_id", "line", "current_station", "next_station",
                "arrival_time", "departure_time"]
BASE_FEATURES = ["headway_seconds", "dwell_time_seconds", "delay_seconds", "hour", "day_of_week", "is_rush_hour"]
SEQUENCE_FEATURES = ["headway_seconds", "dwell_time_seconds", "delay_seconds", "hour", "is_rush_hour"]


def dataset_columns(df: DataFrame, target: str | None = None) -> list[str]:
    """All columns that are neither identifiers nor times nor the target."""
    return [c for c in df.columns if c not in NON_FEATURES and c != target]


def forest_columns(df: DataFrame) -> list[str]:
    """Base columns that exist, then every rolling z-score and percentile column."""
    derived = [c for c in df.columns if c.endswith(("_zscore", "_percentile"))]
    return [c for c in BASE_FEATURES if c in df.columns] + derived


def with_station_slots(df: DataFrame, slots: int = 472) -> DataFrame:
    """One-hot station vector as a sparse ML vector; all zeros without a station."""
    from pyspark.ml.feature import OneHotEncoder

    slot = fx.station_slot("current_station", slots)
    indexed = df.withColumn("station_slot", slot).withColumn("_slot", F.coalesce(slot, F.lit(slots)))
    # one more category than slots, and the last one dropped: that of rows without a station
    encoder = OneHotEncoder(inputCol="_slot", outputCol="station_vector", dropLast=True)
    # a fixed category count needs no scan: the encoder model is fitted on the slot numbers themselves
    slot_rows = df.sparkSession.range(slots + 1).select(F.col("id").cast("int").alias("_slot"))
    return encoder.fit(slot_rows).transform(indexed).drop("_slot")
