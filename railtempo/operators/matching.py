"""Joins: stations, subscriptions, labels, source positions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railtempo.schemas import DEFAULT_LAT, DEFAULT_LON

FILTERS = ["line", "station_id", "anomaly_type"]
SET = [f"set_{c}" for c in FILTERS]


def with_station_defaults(df: DataFrame, stations: DataFrame, key: str = "current_station") -> DataFrame:
    """Name and coordinates of the station of each row; unknown stations get the default ones.

    No broadcast hint: Spark broadcasts the station table as long as its measured size is below the threshold.
    """
    s = stations.select(F.col("id").alias("_sid"), F.col("name").alias("_n"), F.col("lat").alias("_la"), F.col("lon").alias("_lo"))
    return df.join(s, F.col(key) == F.col("_sid"), "left").select(
        *df.columns,
        F.coalesce("_n", F.concat(F.lit("Station "), F.col(key))).alias("station_name"),
        F.coalesce("_la", F.lit(DEFAULT_LAT)).alias("lat"),
        F.coalesce("_lo", F.lit(DEFAULT_LON)).alias("lon"),
    )


def with_station(anomalies: DataFrame, stations: DataFrame, columns: tuple[str, ...] = ("name", "borough")) -> DataFrame:
    """Station attributes of each anomaly, null where the station is unknown."""
    s = stations.select(F.col("id").alias("_sid"), *[F.col(c).alias(f"station_{c}") for c in columns])
    return anomalies.join(s, F.col("station_id") == F.col("_sid"), "left").drop("_sid")


def _mask(df: DataFrame) -> DataFrame:
    """Which filters a subscription sets, as a number, next to its filter values."""
    bits = sum(F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(FILTERS))
    return df.withColumn("_mask", bits)


def _probes(df: DataFrame) -> DataFrame:
    """Each row once per combination of filters, with the values a subscription of that combination must have."""
    options = [
        F.struct(
            F.lit(sum(1 << i for i, on in enumerate(used) if on)).alias("_mask"),
            *[(F.col(c) if on else F.lit(None).cast("string")).alias(f"_{c}") for c, on in zip(FILTERS, used)],
        )
        for used in product([False, True], repeat=len(FILTERS))
    ]
    return df.withColumn("_p", F.explode(F.array(*options))).select(*df.columns, "_p.*")


def _same_filters(left: DataFrame, right: DataFrame):
    condition = left["_mask"] == right["_mask"]
    for c in FILTERS:
        condition &= left[f"_{c}"].eqNullSafe(right[f"_{c}"])
    return condition


def _keyed(subscriptions: DataFrame) -> DataFrame:
    return _mask(subscriptions).select("_mask", *[F.col(c).alias(f"_{c}") for c in FILTERS], "client_id")


def route_anomalies(anomalies: DataFrame, subscriptions: DataFrame, salts: int | None = None, totals: list[Column] | None = None) -> DataFrame:
    """One row per anomaly and client whose set filters all equal the anomaly's values.

    Written as an equality join: a subscription only sets some of three filters, so each anomaly probes the eight
    combinations. Subscriptions without filters receive everything; ``salts`` (as many as shuffle partitions, unless given) spread
    that key, and only that one: other subscriptions are not repeated.

    Pairs are anomalies times clients. With ``totals`` (aggregates over subscriptions, such as their number) clients that set the same
    filters stay together: one row per anomaly and such set, at most eight an anomaly, with the set's filters (``SET``, null if open) and
    its totals. Every subscription is in exactly one set, so nothing of the pairs is lost; ``sent_per_client`` hands a set's rows to its clients.
    """
    salts = salts or int(anomalies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = F.lit(0).cast("long")
    open_to_all = F.col("_mask") == 0
    probes = _probes(anomalies).withColumn("_salt", F.when(open_to_all, F.pmod(F.xxhash64("id", "_mask"), F.lit(salts))).otherwise(none))
    subs, kept = _keyed(subscriptions), ["client_id"]
    if totals is not None:
        subs = subs.groupBy("_mask", *[f"_{c}" for c in FILTERS]).agg(*totals)
        kept = subs.columns[1 + len(FILTERS):]
    subs = subs.withColumn("_salt", F.explode(
        F.when(open_to_all, F.sequence(none, F.lit(salts - 1).cast("long"))).otherwise(F.array(none))))
    own = [subs[f"_{c}"].alias(s) for c, s in zip(FILTERS, SET)] if totals is not None else []
    # Spark takes the probes for as few as the anomalies, and the salted sets for as few as the sets: neither may be broadcast
    return probes.join(subs.hint("merge"), _same_filters(probes, subs) & (probes["_salt"] == subs["_salt"])).select(
        *[probes[c] for c in anomalies.columns], *own, *[subs[c] for c in kept])


def sent_per_client(routes: DataFrame, subscriptions: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """Sums per client over all its deliveries, from the rows that ``route_anomalies`` gives per set of filters.

    ``totals`` are aggregates over routes whose sums over a client's subscriptions are its own. Clients without deliveries have no row.
    """
    sets = routes.groupBy(*SET).agg(*[column.alias(name) for name, column in totals.items()])
    subs = subscriptions.select("client_id", *[F.col(c).alias(f"_{c}") for c in FILTERS])
    same = F.lit(True)
    for c, s in zip(FILTERS, SET):
        same &= subs[f"_{c}"].eqNullSafe(sets[s])
    return subs.join(sets, same).groupBy("client_id").agg(*[F.sum(name).alias(name) for name in totals])


def deliveries_per_client(anomalies: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Number of matching anomalies and their highest severity per client, without building the pairs.

    Anomalies are reduced to totals per filter combination first; each client then needs exactly one of them.
    """
    # a missing value never equals a set filter, so it only counts in combinations that leave it open
    cells = anomalies.groupBy(*FILTERS).agg(F.count("*").alias("_n"), F.max("severity").alias("_s"))
    totals = (
        _probes(cells).groupBy("_mask", *[f"_{c}" for c in FILTERS])
        .agg(F.sum("_n").alias("deliveries"), F.max("_s").alias("max_severity"))
    )
    complete = sum(F.when(F.col(f"_{c}").isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(FILTERS))
    totals = totals.filter(F.col("_mask") == complete)
    subs = _keyed(subscriptions)
    return subs.join(totals, _same_filters(subs, totals), "left").select(
        subs["client_id"], F.coalesce("deliveries", F.lit(0)).alias("deliveries"), "max_severity")


def recipients_per_anomaly(anomalies: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Number of clients each anomaly is sent to, again from totals per filter combination."""
    sizes = _keyed(subscriptions).groupBy("_mask", *[f"_{c}" for c in FILTERS]).agg(F.count("*").alias("_n"))
    cells = anomalies.select(*FILTERS).distinct()
    probes = _probes(cells)
    per_cell = (
        probes.join(sizes, _same_filters(probes, sizes)).select(*[probes[c] for c in FILTERS], "_n")
        .groupBy(*FILTERS).agg(F.sum("_n").alias("recipients"))
        .select(*[F.col(c).alias(f"_{c}") for c in FILTERS], "recipients")
    )
    same = None
    for c in FILTERS:
        equal = anomalies[c].eqNullSafe(per_cell[f"_{c}"])
        same = equal if same is None else same & equal
    return anomalies.join(per_cell, same, "left").select(
        *[anomalies[c] for c in anomalies.columns], F.coalesce("recipients", F.lit(0)).alias("recipients"))


def with_labels(predictions: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """Label per prediction by position id; a missing label is 0."""
    return predictions.join(labels.select(key, "is_anomaly"), key, "left").withColumn(
        "is_anomaly", F.coalesce("is_anomaly", F.lit(0)))


def mark_detected(positions: DataFrame, detections: DataFrame) -> DataFrame:
    """``predicted`` is 1 for positions that some detection names as its source."""
    hits = detections.select(F.col("source_position_id").alias("id")).distinct().withColumn("_hit", F.lit(1))
    return positions.join(hits, "id", "left").withColumn("predicted", F.coalesce("_hit", F.lit(0))).drop("_hit")


def ensemble_members(detections: DataFrame, bucket) -> DataFrame:
    """Source position of every detection next to its ensemble key, one row per member (never one long list)."""
    return detections.select("station_id", "line", bucket.alias("bucket"), "model_name", "source_position_id")
