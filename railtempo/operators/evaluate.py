"""Evaluation of detections against labels, synthetic labels, augmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railtempo.operators.forest import fit_forest, with_scores
from railtempo.operators.ranks import exact_percentiles, with_position
from railtempo.schemas import METRIC_COLUMNS


def _ratio(top, bottom):
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def precision_recall(df: DataFrame, label: str = "is_anomaly", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 of class 1 and its support; a zero denominator gives 0."""
    counts = df.agg(
        F.count_if((F.col(label) == 1) & (F.col(predicted) == 1)).alias("tp"),
        F.count_if((F.col(label) != 1) & (F.col(predicted) == 1)).alias("fp"),
        F.count_if((F.col(label) == 1) & (F.col(predicted) != 1)).alias("fn"),
    )
    precision = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select(
        "tp", "fp", "fn", precision.alias("precision"), recall.alias("recall"),
        _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
        (F.col("tp") + F.col("fn")).alias("support"),
    )


def class_report(df: DataFrame, label: str = "is_anomaly", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support of each class, from one pass over the confusion counts."""
    cells = df.groupBy(F.col(label).alias("l"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = cells.select(F.explode(F.array(
        F.struct(F.col("l").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said"),
                 F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said"), F.lit(0).cast("long").alias("tp")),
    )).alias("s")).select("s.*")
    total = sides.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("said").alias("said"), F.sum("support").alias("support"))
    return total.select(
        "class", _ratio(F.col("tp"), F.col("said")).alias("precision"), _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("said") + F.col("support")).alias("f1"), "support",
    )


def severity_statistics(df: DataFrame, column: str = "severity") -> DataFrame:
    """Mean, population deviation, extremes and exact quartiles."""
    quartiles = exact_percentiles(df, column, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    q = quartiles.select(F.struct("*")).scalar()
    return df.agg(
        F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"),
    ).select("*", *[q.getField(name).alias(name) for name in ("q25", "q50", "q75")])


def detection_rate(positions: DataFrame, detections: DataFrame) -> DataFrame:
    """Positions checked, anomalies found, anomalies per position."""
    checked = positions.agg(F.count("*")).scalar()
    return detections.agg(F.count("*").alias("anomalies_detected")).select(
        checked.alias("positions_checked"), "anomalies_detected",
        _ratio(F.col("anomalies_detected"), checked).alias("anomaly_rate"),
    )


def synthetic_labels(df: DataFrame, contamination: float = 0.05, seed: int = 42, key: str = "id") -> DataFrame:
    """0/1 label per row from a forest on the raw measures; without any of them a random share of rows."""
    columns = [c for c in METRIC_COLUMNS if c in df.columns]
    if not columns:
        share = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
        return df.withColumn("is_anomaly", (share < contamination).cast("int"))
    forest = fit_forest(df, columns, contamination, key=key, seed=seed)
    scored = with_scores(df, forest, "_score")
    return scored.withColumn("is_anomaly", (F.col("_score") < forest.threshold).cast("int")).drop("_score")


def augment_anomalies(df: DataFrame, factor: float = 2.0, columns: list[str] | None = None, seed: int = 42,
                      ts: str = "timestamp", key: str = "id") -> DataFrame:
    """All rows plus ``int(k * (factor - 1))`` draws with replacement from the k anomalies, with noise on the measures.

    The draws are numbered on Spark and pick an anomaly by its position, so neither side is collected.
    """
    if "is_anomaly" not in df.columns:
        return df
    columns = columns or [c for c in METRIC_COLUMNS if c in df.columns]
    spark = df.sparkSession
    anomalies = with_position(df.filter("is_anomaly = 1").withColumn("_one", F.lit(1)), ["_one"], ts, key, "_at").drop("_one")
    k = anomalies.count()
    if k == 0:
        return df
    pick = F.floor(F.pmod(F.xxhash64("_draw", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40) * k)
    draws = spark.range(int(k * (factor - 1))).select(F.col("id").alias("_draw")).select(pick.alias("_at"))
    noisy = draws.join(anomalies, "_at").drop("_at").withColumns({
        c: F.col(c).cast("double") + F.randn(seed + i) * 0.1 for i, c in enumerate(columns)})
    base = df.withColumns({c: F.col(c).cast("double") for c in columns})
    return base.unionByName(noisy.select(*base.columns))


def shuffled(df: DataFrame, seed: int = 42) -> DataFrame:
    """Rows in random order: a range-partitioned sort by a random number, for files that are read in order."""
    return df.orderBy(F.rand(seed))
