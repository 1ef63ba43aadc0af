"""Model tables derived from generic driver tables by pure column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railtempo.functions import scalar as fx
from railtempo.session import use_settings

# Routes dealt out by id, feed codes by id.
ROUTES = ["1", "2", "3", "A", "C", "E", "N", "Q", " gs", "SI", "6X", "L"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_settings(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw train positions from ``events``; headway not yet computed."""
    key = F.col("event_id")
    late = F.make_dt_interval(secs=(key * 37 % 120 - 10).cast("decimal(18,6)"))
    return table(spark, sf_dir, "events").select(
        key.alias("id"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("trip_"), F.col("user_id").cast("string")).alias("trip_id"),
        _pick(ROUTES, key % 12).alias("route_id"),
        fx.line_of_route(_pick(ROUTES, key % 12)).alias("line"),
        (key % 2).cast("int").alias("direction"),
        F.when(key % 97 != 0, F.concat(F.lit("S"), (F.col("user_id") % 5).cast("string"))).alias("current_station"),
        F.lit(None).cast("string").alias("next_station"),
        F.when(key % 53 != 0, F.col("ts")).alias("arrival_time"),
        (F.col("ts") + late).alias("departure_time"),
        (F.floor(F.col("value") * 10) - 300).cast("int").alias("delay_seconds"),
    )


def positions_with_dwell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(spark, sf_dir).withColumn("dwell_time_seconds", fx.dwell_seconds("arrival_time", "departure_time"))


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        key.alias("id"),
        F.col("ts").alias("detected_at"),
        F.when(key % 97 != 0, F.concat(F.lit("S"), (F.col("user_id") % 5).cast("string"))).alias("station_id"),
        fx.line_of_route(_pick(ROUTES, key % 12)).alias("line"),
        F.col("event_type").alias("anomaly_type"),
        F.least(F.lit(1.0), F.col("value") / 200).alias("severity"),
        F.when(key % 2 == 0, "isolation_forest").otherwise("sequence_model").alias("model_name"),
        F.lit("v1").alias("model_version"),
        F.create_map(F.lit("value"), F.col("value")).alias("features"),
        F.create_map(F.lit("trip_id"), F.concat(F.lit("trip_"), F.col("user_id").cast("string"))).alias("meta_data"),
        (key % 3 == 0).alias("resolved"),
        F.lit(None).cast("timestamp_ntz").alias("resolved_at"),
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), (F.col("value") > 150).cast("int").alias("is_anomaly"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nations; station S4 of the positions is left unknown."""
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("S"), (key + (key >= 4).cast("int")).cast("string")).alias("id"),
        F.col("n_name").alias("name"),
        (40.5 + 0.1 * key).alias("lat"),
        (-74 + 0.1 * key).alias("lon"),
        F.array().cast("array<string>").alias("lines"),
        F.lit(None).cast("string").alias("borough"),
    )


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One subscription per customer with filters on line, station and type; unset filters are null."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.cast("string").alias("client_id"),
        F.when(key % 3 != 0, fx.line_of_route(_pick(ROUTES, key % 12))).alias("line"),
        F.when(key % 2 != 0, F.concat(F.lit("S"), (key % 5).cast("string"))).alias("station_id"),
        F.when(key % 5 == 0, _pick(["view", "click", "purchase"], key % 3)).alias("anomaly_type"),
    )


def model_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_type").alias("model_type"),
        F.col("p_partkey").cast("string").alias("version"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("p_partkey")).alias("trained_at"),
        F.create_map(F.lit("score_mean"), F.col("p_retailprice")).alias("metrics"),
        F.col("p_size").cast("long").alias("training_samples"),
        (F.col("p_partkey") % 7 == 0).alias("is_active"),
    )


def feed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested feed message per order, built inside the row: no grouping, so the size of a message is bounded.

    The branches cover missing arrivals, departures and delays, empty stop lists, alerts with and without text, entities
    with both a trip and an alert, and entities with neither.
    """
    routes = ", ".join(f"'{r}'" for r in ROUTES)
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as k", "unix_seconds(cast(o_orderdate as timestamp)) as d", "o_orderpriority as p",
    ).selectExpr(
        "k as message_id",
        "element_at(array('1', 'A', 'B', 'G', 'J', 'L', 'N', 'SI'), int(k % 8) + 1) as feed_code",
        "named_struct('timestamp', d + k % 86400) as header",
        f"""filter(array(
              named_struct(
                'id', concat(k, '-t'),
                'trip_update', if(k % 20 = 0, null, named_struct(
                  'trip', named_struct('trip_id', concat('trip_', k), 'route_id', element_at(array({routes}), int(k % 12) + 1),
                                       'direction_id', if(k % 7 = 0, null, int(k % 2))),
                  'stop_time_update', if(k % 5 = 0, cast(array() as array<struct<stop_id: string,
                      arrival: struct<time: bigint, delay: int>, departure: struct<time: bigint>>>),
                    transform(sequence(0, int(k % 5) - 1), i -> named_struct(
                      'stop_id', concat('S', (k + i) % 5),
                      'arrival', if((k + i) % 11 = 0, null, named_struct(
                        'time', d + (k % 1000) * 60 + i * 300,
                        'delay', if((k + i) % 3 = 0, null, int((k * 7 + i * 13) % 1200 - 300)))),
                      'departure', if((k + i) % 13 = 0, null, named_struct('time', d + (k % 1000) * 60 + i * 300 + 30))))))),
                'alert', if(k % 10 = 0 or k % 10 = 5, named_struct('header_text', named_struct('translation',
                            array(named_struct('text', p)))), null)),
              if(k % 4 = 0, named_struct(
                'id', concat(k, '-a'), 'trip_update', null,
                'alert', named_struct('header_text', named_struct('translation',
                  if(k % 8 = 0, cast(array() as array<struct<text: string>>),
                     array(named_struct('text', p), named_struct('text', 'second')))))), null),
              if(k % 9 = 0, named_struct('id', concat(k, '-n'), 'trip_update', null, 'alert', null), null)
            ), e -> e is not null) as entity""",
    )
