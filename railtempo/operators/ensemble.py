"""Combination of detections of several detectors for one station, line and five-minute bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railtempo.functions import scalar as fx

KEY = ["station_id", "line", "bucket"]


def ensemble_bucket(mode: str = "time") -> Column:
    """Five-minute bucket of the detection time.

    ``metadata`` reads the time from the metadata instead, null where a detector does not record it there: all such
    detections of a station and line then fall together.
    """
    if mode == "metadata":
        return fx.five_minute_floor(F.try_to_timestamp(F.try_element_at("meta_data", F.lit("timestamp"))))
    return fx.five_minute_floor("event_time")


def combine_detections(detections: DataFrame, mode: str = "time", model_order: list[str] | None = None) -> DataFrame:
    """One row per key. A single detection stays as it is; several become one of type ``ensemble``.

    The members are never collected: per (key, model) the count, the last severity and the first features are kept, so a
    key that holds a large share of all detections costs no more than any other. ``model_counts`` in detector order says
    the same as the list of models with repetitions, because detections come detector by detector. Detectors count in
    ``model_order``, then by a column ``detector_order`` where there is one, then by name.
    """
    order = model_order or []
    given = F.col("detector_order") if "detector_order" in detections.columns else F.lit(0)
    rank = given + len(order)
    for i, name in reversed(list(enumerate(order))):
        rank = F.when(F.col("model_name") == name, i).otherwise(rank)
    member = F.struct("anomaly_type", "model_version", "features", "meta_data", "source_position_id", "event_time")
    per_model = (
        detections.withColumns({"bucket": ensemble_bucket(mode), "_rank": rank})
        .groupBy(*KEY, "_rank", "model_name")
        .agg(
            F.count("*").alias("_n"),
            F.max("severity").alias("_max"),
            F.max_by("severity", "source_position_id").alias("_last"),
            F.min_by(member, "source_position_id").alias("_first"),
        )
    )
    # at most one row per key and detector from here on
    runs = F.array_sort(F.collect_list(F.struct("_rank", "model_name", "_n", "_last")))
    grouped = per_model.groupBy(*KEY).agg(
        F.sum("_n").alias("detection_count"),
        F.count("*").alias("distinct_models"),
        F.max("_max").alias("severity"),
        F.min_by("_first", F.struct("_rank", "model_name")).alias("_first"),
        runs.alias("_runs"),
    )
    several = F.col("detection_count") > 1
    name = F.element_at("_runs", 1).getField("model_name")
    return grouped.select(
        *KEY,
        F.when(several, F.lit("ensemble")).otherwise(F.col("_first.anomaly_type")).alias("anomaly_type"),
        "severity",
        F.when(several, F.lit("ensemble")).otherwise(name).alias("model_name"),
        F.when(several, F.concat(F.lit("ensemble_"), F.col("detection_count").cast("string")))
        .otherwise(F.col("_first.model_version")).alias("model_version"),
        F.col("_first.features").alias("features"),
        F.when(~several, F.col("_first.meta_data")).alias("meta_data"),
        F.when(~several, F.col("_first.source_position_id")).alias("source_position_id"),
        F.coalesce(F.when(~several, F.col("_first.event_time").cast("timestamp")), F.col("bucket")).alias("event_time"),
        F.map_from_entries(F.transform("_runs", lambda r: F.struct(r["model_name"], r["_n"]))).alias("model_counts"),
        F.map_from_entries(F.transform("_runs", lambda r: F.struct(r["model_name"], r["_last"]))).alias("individual_severities"),
        "detection_count",
        "distinct_models",
    )
