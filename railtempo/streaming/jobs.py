"""Running streams: feed ingest, scoring per batch, anomaly routing."""

from __future__ import annotations

import time
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from railtempo.operators.matching import route_anomalies
from railtempo.operators.upsert import upsert_stations
from railtempo.plans.detection import DetectorSet, as_anomalies, with_features
from railtempo.schemas import FEED_INTERVAL_SECONDS
from railtempo.sources.feeds import feed_log, flatten_trips, positions_from_trips
from railtempo.sources.tables import append_anomalies, append_by_date, append_positions, batch_label, read_range, read_table, replace_if_changed
from railtempo.streaming.headway import stream_headway


def _trigger(once: bool) -> dict:
    return {"availableNow": True} if once else {"processingTime": f"{FEED_INTERVAL_SECONDS} seconds"}


def start_feed_log(messages: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append one log row per message; the time that storing the batch took goes to ``<path>-times``."""

    def store(batch: DataFrame, batch_id: int) -> None:
        begun, label = time.monotonic(), batch_label(checkpoint, batch_id)
        append_by_date(feed_log(batch).drop("processing_time_ms"), path, "timestamp", label)
        # known only once the rows are stored, so it has a small table of its own; see read_feed_log
        elapsed = batch.sparkSession.range(1).select(F.lit(label).alias("batch"), F.lit((time.monotonic() - begun) * 1000).alias("processing_time_ms"))
        elapsed.write.mode("overwrite").parquet(f"{path}-times/{label}")

    return messages.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**_trigger(once)).start()


def read_feed_log(spark: SparkSession, path: str) -> DataFrame:
    """Stored log rows with the processing time of their batch, storage included."""
    return spark.read.parquet(path).join(spark.read.parquet(f"{path}-times/*"), "batch", "left").drop("batch", "date")


def start_ingest(messages: DataFrame, positions_path: str, stations_path: str, checkpoint: str, once: bool = False,
                 dedupe: str | None = None) -> StreamingQuery:
    """Messages to positions with headway, and stations brought up to date, batch by batch.

    Every poll is stored. With ``dedupe`` a report that repeats all values of an earlier one within that time is dropped before
    headways are computed. The stations table must exist.
    """
    positions = positions_from_trips(flatten_trips(messages))
    if dedupe:
        positions = positions.withWatermark("timestamp", dedupe).dropDuplicatesWithinWatermark(
            ["trip_id", "current_station", "direction", "arrival_time", "departure_time", "delay_seconds"])
    positions = stream_headway(positions, watermark=None if dedupe else "30 minutes")

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            spark = batch.sparkSession
            replace_if_changed(upsert_stations(read_table(spark, stations_path), batch), stations_path)
            append_positions(batch, positions_path, batch_label(checkpoint, batch_id))
        finally:
            batch.unpersist()

    return positions.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**_trigger(once)).start()


def start_scoring(positions: DataFrame, detectors: DetectorSet, anomalies_path: str, checkpoint: str, subscriptions: DataFrame | None = None,
                  deliveries_path: str | None = None, percentiles: bool = True, once: bool = False, history_path: str | None = None) -> StreamingQuery:
    """Score each micro-batch with all detectors, combine, store, and route to subscribers.

    ``history_path`` names the stored positions: the hour before the batch's first row is read from there (only its dates), so
    rolling frames at the start of a batch are whole. Deliveries carry the ids of the stored anomalies.
    """

    def score(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        features = batch
        if history_path:
            first, last = batch.agg(F.min("timestamp"), F.max("timestamp")).first()
            earlier = read_range(batch.sparkSession, history_path, "timestamp", first - timedelta(hours=1), last)
            own = batch.select("id").distinct()
            features = batch.withColumn("_own", F.lit(True)).unionByName(
                earlier.join(own, "id", "left_anti").withColumn("_own", F.lit(False)).select(*batch.columns, "_own"))
        features = with_features(features, percentiles=percentiles)
        if history_path:
            features = features.filter("_own").drop("_own")
        combined = detectors.combined(features)
        if combined is None:
            return
        found = as_anomalies(combined).persist()
        try:
            append_anomalies(found, anomalies_path, batch_label(checkpoint, batch_id))
            if subscriptions is not None and deliveries_path:
                route_anomalies(found, subscriptions).select("id", "client_id", "event_time").write.mode("overwrite").parquet(
                    f"{deliveries_path}/batch={batch_label(checkpoint, batch_id)}")
        finally:
            found.unpersist()

    return positions.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(**_trigger(once)).start()


def stream_routes(anomalies: DataFrame, subscriptions: DataFrame, totals: list[Column] | None = None) -> DataFrame:
    """Stream of (anomaly, client) rows, or of (anomaly, set of filters) rows with ``totals``: a stream-static equality join."""
    return route_anomalies(anomalies, subscriptions, totals=totals)
