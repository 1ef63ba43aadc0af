"""Station upsert, anomaly resolution, model activation as joins over immutable tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from railtempo.schemas import DEFAULT_LAT, DEFAULT_LON


def stations_seen(positions: DataFrame) -> DataFrame:
    """Distinct current and next stations."""
    both = F.explode(F.array("current_station", "next_station"))
    return positions.select(both.alias("id")).filter("id is not null and id <> ''").distinct()


def lines_per_station(positions: DataFrame) -> DataFrame:
    """Distinct upper-case routes per current or next station, sorted."""
    pairs = positions.select(
        F.explode(F.array_distinct(F.array("current_station", "next_station"))).alias("id"),
        F.nullif(F.upper(F.coalesce("route_id", F.lit(""))), F.lit("")).alias("route"),
    ).filter("id is not null and id <> ''")
    # distinct pairs first: what is collected per station is bounded by the number of routes
    return pairs.distinct().groupBy("id").agg(F.array_sort(F.collect_list("route")).alias("lines"))


def upsert_stations(existing: DataFrame, positions: DataFrame, station_file: DataFrame | None = None,
                    keep_duplicates: bool = False) -> DataFrame:
    """Existing stations with the lines now seen there added, and new stations with file attributes or defaults.

    ``keep_duplicates`` concatenates the line lists instead of uniting them; a null list is then replaced.
    """
    seen = lines_per_station(positions).withColumnRenamed("lines", "_new")
    if station_file is not None:
        known = station_file.select("id", F.col("name").alias("_fn"), F.col("lat").alias("_fla"), F.col("lon").alias("_flo"))
        seen = seen.join(known, "id", "left")
    else:
        seen = seen.withColumns({"_fn": F.lit(None).cast("string"), "_fla": F.lit(None).cast("double"), "_flo": F.lit(None).cast("double")})
    new = F.coalesce("_new", F.array().cast("array<string>"))
    old = F.coalesce("lines", F.array().cast("array<string>"))
    merged = F.concat(old, new) if keep_duplicates else F.array_sort(F.array_distinct(F.concat(old, new)))
    return existing.withColumn("_old", F.lit(True)).join(seen, "id", "full_outer").select(
        "id",
        F.when(F.col("_old"), F.col("name")).otherwise(F.coalesce("_fn", F.concat(F.lit("Station "), F.col("id")))).alias("name"),
        F.when(F.col("_old"), F.col("lat")).otherwise(F.coalesce("_fla", F.lit(DEFAULT_LAT))).alias("lat"),
        F.when(F.col("_old"), F.col("lon")).otherwise(F.coalesce("_flo", F.lit(DEFAULT_LON))).alias("lon"),
        F.when(F.col("_new").isNull(), F.col("lines")).otherwise(merged).alias("lines"),
        "borough",
    )


def apply_resolutions(anomalies: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Anomalies with an append-only log of (id, resolved_at) applied; the first resolution of an id counts."""
    first = resolutions.groupBy("id").agg(F.min("resolved_at").alias("_at"))
    return anomalies.join(first, "id", "left").select(
        *[c for c in anomalies.columns if c not in ("resolved", "resolved_at")],
        (F.col("resolved") | F.col("_at").isNotNull()).alias("resolved"),
        F.coalesce("_at", "resolved_at").alias("resolved_at"),
    )


def activate(artifacts: DataFrame, chosen: DataFrame) -> DataFrame:
    """Exactly the (model_type, version) rows of ``chosen`` become active; types not chosen stay as they are."""
    pick = chosen.select("model_type", F.col("version").alias("_version"))
    return artifacts.join(pick, "model_type", "left").withColumn(
        "is_active", F.when(F.col("_version").isNotNull(), F.col("version") == F.col("_version")).otherwise(F.col("is_active"))
    ).drop("_version")


def activate_latest(artifacts: DataFrame) -> DataFrame:
    """The newest artifact of each type active, all others not."""
    newest = artifacts.groupBy("model_type").agg(F.max(F.struct("trained_at", "id")).alias("m")).select(
        "model_type", F.col("m.id").alias("_id"))
    return artifacts.join(newest, "model_type", "left").withColumn("is_active", F.col("id") == F.col("_id")).drop("_id")


def active_models(artifacts: DataFrame) -> DataFrame:
    return artifacts.filter("is_active")


def model_status(artifacts: DataFrame, loaded: DataFrame) -> DataFrame:
    """Active models and whether a detector of that type is loaded."""
    here = loaded.select("model_type").distinct().withColumn("_loaded", F.lit(True))
    return active_models(artifacts).join(here, "model_type", "left").withColumn(
        "is_loaded", F.coalesce("_loaded", F.lit(False))).drop("_loaded")


def last_by_order(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row per key in the given order."""
    ranked = df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*[F.desc(c) for c in order])))
    return ranked.filter("_r = 1").drop("_r")
