"""Feed messages: reading decoded messages, flattening trips, extracting alerts, logging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from railtempo import schemas
from railtempo.functions.features import with_trip_features
from railtempo.session import use_settings


def read_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded messages from a landing folder of JSON lines; malformed lines give null fields instead of an error."""
    return use_settings(spark).read.schema(schemas.FEED_MESSAGE).option("mode", "PERMISSIVE").json(folder)


def stream_messages(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    reader = use_settings(spark).readStream.schema(schemas.FEED_MESSAGE).option("mode", "PERMISSIVE")
    return reader.option("maxFilesPerTrigger", files_per_batch).json(folder)


def flatten_trips(messages: DataFrame) -> DataFrame:
    """One row per stop-time update. Delay comes from the arrival alone, default 0; direction defaults to 0."""
    # entities and stops are exploded inside the row, so the flattening needs no shuffle
    trips = messages.select(
        "feed_code", F.timestamp_seconds("header.timestamp").alias("timestamp"),
        F.explode(F.filter("entity", lambda e: e["trip_update"].isNotNull())).alias("e"),
    )
    stops = trips.select("feed_code", "timestamp", F.col("e.trip_update.trip").alias("trip"),
                         F.explode("e.trip_update.stop_time_update").alias("stop"))
    return stops.select(
        "feed_code", "timestamp", "trip.trip_id", "trip.route_id",
        F.coalesce("trip.direction_id", F.lit(0)).alias("direction"),
        "stop.stop_id",
        F.timestamp_seconds("stop.arrival.time").alias("arrival_time"),
        F.timestamp_seconds("stop.departure.time").alias("departure_time"),
        F.coalesce("stop.arrival.delay", F.lit(0)).alias("delay"),
    )


def extract_alerts(messages: DataFrame) -> DataFrame:
    """Entities without a trip update that have an alert; the header is its first translation or empty."""
    alerts = F.filter("entity", lambda e: e["trip_update"].isNull() & e["alert"].isNotNull())
    return messages.select("feed_code", F.explode(alerts).alias("e")).select(
        "feed_code", F.col("e.id").alias("alert_id"),
        F.coalesce(F.try_element_at("e.alert.header_text.translation", F.lit(1)).getField("text"), F.lit("")).alias("header"),
    )


def feed_log(messages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per message, with the columns ``keep`` passed through. ``num_trips`` counts flattened stop rows; both
    counts come from the nested arrays."""
    stops = F.aggregate(
        F.filter("entity", lambda e: e["trip_update"].isNotNull()), F.lit(0),
        lambda n, e: n + F.coalesce(F.size(e["trip_update"]["stop_time_update"]), F.lit(0)),
    )
    alerts = F.size(F.filter("entity", lambda e: e["trip_update"].isNull() & e["alert"].isNotNull()))
    return messages.select(
        *keep,
        F.timestamp_seconds("header.timestamp").alias("timestamp"),
        F.col("feed_code").alias("feed_id"),
        F.to_json(F.struct("feed_code", "header", "entity")).alias("raw_data"),
        stops.alias("num_trips"), alerts.alias("num_alerts"),
        F.lit(None).cast("double").alias("processing_time_ms"),
    )


def positions_from_trips(trips: DataFrame) -> DataFrame:
    """Position rows without headway; the id is a stable hash of what identifies a stop update."""
    return with_trip_features(
        trips.withColumnRenamed("stop_id", "current_station").withColumnRenamed("delay", "delay_seconds")
    ).select(
        F.xxhash64("feed_code", "timestamp", "trip_id", "current_station", "arrival_time", "departure_time").alias("id"),
        "timestamp", "trip_id", "route_id", "line", "direction", "current_station",
        F.lit(None).cast("string").alias("next_station"), "arrival_time", "departure_time", "delay_seconds",
        "dwell_time_seconds", F.lit(None).cast("double").alias("schedule_adherence"),
    )


def read_station_file(spark: SparkSession, path: str) -> DataFrame:
    """Stations of a CSV with header. Rows without id are dropped, the last duplicate wins.

    Columns are matched by name and a column missing from the file gets its default. Coordinates that do not parse are
    null, for :func:`railtempo.operators.filters.split_valid` to set aside row by row.
    """
    # monotonically_increasing_id follows file order only within one task, so the file name and offset decide
    raw = use_settings(spark).read.option("header", True).option("encoding", "UTF-8").csv(path)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    raw = raw.withColumns({"_block": F.col("_metadata.file_block_start"), "_file": F.col("_metadata.file_path"),
                           "_row": F.monotonically_increasing_id()})
    have = set(raw.columns)

    def pick(name, default):
        return F.col(name) if name in have else F.lit(default).cast("string")

    rows = raw.filter(F.length(F.coalesce(F.col("stop_id"), F.lit(""))) > 0).select(
        F.col("stop_id").alias("id"),
        (F.col("stop_name") if "stop_name" in have else F.concat(F.lit("Station "), F.col("stop_id"))).alias("name"),
        F.expr("try_cast(stop_lat as double)").alias("lat") if "stop_lat" in have else F.lit(schemas.DEFAULT_LAT).alias("lat"),
        F.expr("try_cast(stop_lon as double)").alias("lon") if "stop_lon" in have else F.lit(schemas.DEFAULT_LON).alias("lon"),
        pick("parent_station", "").alias("parent_station"),
        pick("location_type", "0").alias("location_type"),
        "_file", "_block", "_row",
    )
    order = W.partitionBy("id").orderBy(F.desc("_file"), F.desc("_block"), F.desc("_row"))
    return rows.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r", "_file", "_block", "_row")


def ingest_status(log: DataFrame, stations: DataFrame, recent: int = 20) -> DataFrame:
    """Latest updates next to the feed count, the polling interval and the number of stations."""
    known = stations.agg(F.count("*")).scalar()
    return log.orderBy(F.desc("timestamp"), F.desc("feed_id")).limit(recent).select(
        "feed_id", "timestamp", "num_trips", "num_alerts",
        F.lit(len(schemas.FEED_CODES)).alias("active_feeds"),
        F.lit(schemas.FEED_INTERVAL_SECONDS).alias("update_interval"),
        known.alias("loaded_stations"),
    )
