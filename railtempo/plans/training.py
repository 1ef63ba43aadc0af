"""Training: parameter search, load or train, saving detectors, reports."""

from __future__ import annotations

from datetime import datetime, timedelta
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railtempo.functions.features import BASE_FEATURES, with_calendar, zero_filled
from railtempo.operators import evaluate, ranks
from railtempo.operators.filters import enough_samples, training_range
from railtempo.operators.forest import Forest, fit_forest, grow_forest, tree_scores
from railtempo.operators.large_forest import SUBTREE, LargeForest, large_scores
from railtempo.operators.recurrent import RecurrentModel, fit_recurrent
from railtempo.operators.reconstruct import SequenceModel, fit_sequences
from railtempo.operators.scaling import cap_outliers
from railtempo.schemas import METRIC_COLUMNS
from railtempo.session import checkpointed
from railtempo.sources.tables import read_table, record_artifact

# Search spaces. The second one keeps the shape of the original (size, rate, batch) where only the size
# has a meaning for a linear model; the number of components stands for it.
FOREST_GRID = {"contamination": [0.01, 0.05, 0.1], "n_estimators": [50, 100, 200], "max_samples": ["auto", 0.5, 0.8]}
SEQUENCE_GRID = {"components": [4, 8, 16]}
HISTORY = "contamination double, n_estimators int, max_samples string, tp long, fp long, fn long"


def prepare(df: DataFrame) -> DataFrame:
    """Nulls to 0 and outliers capped, as the training set is prepared."""
    return cap_outliers(zero_filled(df, METRIC_COLUMNS), METRIC_COLUMNS)


def score_prefixes(df: DataFrame, forest: Forest, tree_counts: list[int]) -> DataFrame:
    """Scores of the first 50, 100, ... trees in one pass over the rows."""
    if isinstance(forest, LargeForest):
        return large_scores(df, forest, {f"s{t}": t for t in tree_counts})
    shared = df.sparkSession.sparkContext.broadcast(forest.arrays())
    fields = ", ".join(f"s{t} double" for t in tree_counts)

    @F.pandas_udf(fields)
    def score(*values: pd.Series) -> pd.DataFrame:
        x = np.column_stack([v.to_numpy("float64") for v in values])
        return pd.DataFrame({f"s{t}": tree_scores(shared.value, x, t) for t in tree_counts})

    return df.withColumn("_s", score(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in forest.columns])).select(
        *df.columns, "_s.*")


def forest_search(train: DataFrame, validation: DataFrame, grid: dict | None = None, columns: list[str] | None = None,
                  seed: int = 42) -> DataFrame:
    """F1 against synthetic labels for every setting of the grid, as one row per setting.

    Only the sample size needs another forest: smaller forests are prefixes of the largest one and the contamination only
    moves the threshold. Three forests and one scoring pass each cover all 27 settings.
    """
    grid = grid or FOREST_GRID
    columns = columns or BASE_FEATURES
    labelled = checkpointed(evaluate.synthetic_labels(validation, seed=seed).select("id", "is_anomaly", *columns))
    counts = sorted(grid["n_estimators"])
    history = None
    for max_samples in grid["max_samples"]:
        forest = grow_forest(train, columns, trees=counts[-1], max_samples=max_samples, seed=seed)
        trained = checkpointed(score_prefixes(train.select(*columns), forest, counts).select(*[f"s{t}" for t in counts]))
        judged = score_prefixes(labelled, forest, counts)
        cells = []
        for trees in counts:
            cuts = ranks.exact_percentiles(trained, f"s{trees}", {f"c{i}": c for i, c in enumerate(grid["contamination"])})
            limits = cuts.select(F.struct("*")).scalar()
            for i, contamination in enumerate(grid["contamination"]):
                hit = F.col(f"s{trees}") < limits.getField(f"c{i}")
                label = F.col("is_anomaly") == 1
                cells.append(F.struct(
                    F.lit(float(contamination)).alias("contamination"), F.lit(trees).alias("n_estimators"),
                    F.lit(str(max_samples)).alias("max_samples"),
                    F.count_if(hit & label).alias("tp"), F.count_if(hit & ~label).alias("fp"), F.count_if(~hit & label).alias("fn"),
                ))
        part = judged.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("r")).select("r.*")
        history = part if history is None else history.unionByName(part)
    precision = evaluate._ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = evaluate._ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = evaluate._ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return history.select("contamination", "n_estimators", "max_samples", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def best_forest(train: DataFrame, validation: DataFrame, grid: dict | None = None, columns: list[str] | None = None,
                seed: int = 42) -> tuple[Forest, dict]:
    """Forest refitted with the first best setting, and the search results."""
    rows = [r.asDict() for r in forest_search(train, validation, grid, columns, seed).collect()]
    order = list(product((grid or FOREST_GRID)["contamination"], (grid or FOREST_GRID)["n_estimators"],
                         map(str, (grid or FOREST_GRID)["max_samples"])))
    rows.sort(key=lambda r: order.index((r["contamination"], r["n_estimators"], r["max_samples"])))
    best = max(rows, key=lambda r: r["f1"])
    sample = best["max_samples"] if best["max_samples"] == "auto" else float(best["max_samples"])
    model = fit_forest(train, columns or BASE_FEATURES, best["contamination"], trees=best["n_estimators"], max_samples=sample, seed=seed)
    return model, {"best_params": {k: best[k] for k in ("contamination", "n_estimators", "max_samples")},
                   "best_score": best["f1"], "final_metrics": model.metrics, "training_history": rows}


def best_sequences(train: DataFrame, grid: dict | None = None, length: int = 24) -> tuple[SequenceModel, dict]:
    """Sequence model with the lowest training loss over the grid, and the search results."""
    rows, best = [], None
    for components in (grid or SEQUENCE_GRID)["components"]:
        model = fit_sequences(train, components, length)
        rows.append({"components": components, "val_loss": model.metrics["final_loss"], "threshold": model.threshold})
        if best is None or model.metrics["final_loss"] < best[1].metrics["final_loss"]:
            best = components, model
    return best[1], {"best_params": {"components": best[0]}, "best_score": best[1].metrics["final_loss"],
                     "final_metrics": best[1].metrics, "training_history": rows}


def save_forest(spark: SparkSession, forest: Forest, path: str) -> None:
    """Node table and one-row metadata, both parquet; a large forest's subtrees beside them."""
    large = isinstance(forest, LargeForest)
    tree = np.zeros(len(forest.feature), dtype="int64")
    tree[forest.roots] = np.arange(len(forest.roots))
    for at in np.flatnonzero(forest.feature >= 0):  # parents come before their children
        tree[[forest.low[at], forest.high[at]]] = tree[at]
    goes_on = forest.open if large else np.zeros(len(tree), dtype=bool)
    nodes = list(zip(range(len(tree)), tree.tolist(), forest.feature.tolist(), forest.cut.tolist(), forest.low.tolist(),
                     forest.high.tolist(), forest.depth.tolist(), goes_on.tolist()))
    spark.createDataFrame(nodes, "node int, tree int, feature int, cut double, low int, high int, depth double, open boolean").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/nodes")
    if large:
        forest.subtrees.write.mode("overwrite").parquet(f"{path}/subtrees")
    meta = [(forest.columns, forest.sample_size, forest.threshold, forest.contamination, forest.version, forest.metrics,
             forest.subtree_rows if large else None)]
    spark.createDataFrame(meta, "columns array<string>, sample_size int, threshold double, contamination double, version string, "
                                "metrics map<string,double>, subtree_rows int").coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def load_forest(spark: SparkSession, path: str) -> Forest:
    nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values("node")
    meta = spark.read.parquet(f"{path}/metadata").first()
    roots = nodes.drop_duplicates("tree")["node"].to_numpy("int64")
    parts = dict(
        columns=list(meta["columns"]), sample_size=meta["sample_size"], roots=roots, feature=nodes["feature"].to_numpy("int64"),
        cut=nodes["cut"].to_numpy("float64"), low=nodes["low"].to_numpy("int64"), high=nodes["high"].to_numpy("int64"),
        depth=nodes["depth"].to_numpy("float64"), threshold=meta["threshold"], contamination=meta["contamination"],
        version=meta["version"], metrics=dict(meta["metrics"]))
    if meta["subtree_rows"] is None:
        return Forest(**parts)
    return LargeForest(**parts, open=nodes["open"].to_numpy(bool), subtrees=spark.read.schema(SUBTREE).parquet(f"{path}/subtrees"),
                       subtree_rows=meta["subtree_rows"])


def save_sequences(spark: SparkSession, model: SequenceModel, path: str) -> None:
    meta = [(model.columns, model.length, model.normaliser, model.mean.tolist(), model.components.tolist(), model.threshold,
             model.version, model.metrics)]
    spark.createDataFrame(meta, "columns array<string>, length int, normaliser map<string,double>, mean array<double>, "
                                "components array<array<double>>, threshold double, version string, metrics map<string,double>"
                          ).coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def load_sequences(spark: SparkSession, path: str) -> SequenceModel:
    m = spark.read.parquet(f"{path}/metadata").first()
    return SequenceModel(list(m["columns"]), m["length"], dict(m["normaliser"]), np.array(m["mean"]), np.array(m["components"]),
                         m["threshold"], m["version"], dict(m["metrics"]))


def save_recurrent(spark: SparkSession, model: RecurrentModel, path: str) -> None:
    """All of a fitted model; its random weights are kept as well, so that it does not depend on how they are drawn."""
    nets = [tuple(part.tolist() for part in net) for net in model.nets]
    meta = [(model.columns, model.length, model.normaliser, nets, model.readout.tolist(), model.threshold, model.version, model.metrics)]
    spark.createDataFrame(
        meta, "columns array<string>, length int, normaliser map<string,double>, nets array<struct<recurrent: array<array<double>>, "
              "inputs: array<array<double>>, bias: array<double>>>, readout array<array<double>>, threshold double, version string, "
              "metrics map<string,double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def load_recurrent(spark: SparkSession, path: str) -> RecurrentModel:
    m = spark.read.parquet(f"{path}/metadata").first()
    nets = tuple((np.array(n["recurrent"]), np.array(n["inputs"]), np.array(n["bias"])) for n in m["nets"])
    return RecurrentModel(list(m["columns"]), m["length"], dict(m["normaliser"]), nets, np.array(m["readout"]), m["threshold"],
                          m["version"], dict(m["metrics"]))


MODEL_TYPES = {
    "isolation_forest": (lambda df, version: fit_forest(df, BASE_FEATURES, version=version), save_forest, load_forest, None),
    "sequence_model": (lambda df, version: fit_sequences(df, version=version), save_sequences, load_sequences, 24),
}
# asked for by name only: load_or_train(..., kinds={**MODEL_TYPES, **MORE_TYPES})
MORE_TYPES = {
    "recurrent_model": (lambda df, version: fit_recurrent(df, version=version), save_recurrent, load_recurrent, 24),
}


def load_or_train(spark: SparkSession, positions: DataFrame, registry_path: str, model_folder: str, as_of: datetime,
                  registry: DataFrame | None = None, days: int = 7, kinds: dict | None = None) -> dict:
    """Active models from the registry; missing ones are trained on the last ``days`` if there are enough rows.

    ``registry`` is the current registry (None if there is none yet). A type with too few rows maps to None.
    """
    models: dict = {}
    kinds = kinds or MODEL_TYPES
    if registry is not None:
        for row in registry.filter("is_active").collect():
            if row["model_type"] in kinds and row["artifact_path"]:
                models[row["model_type"]] = kinds[row["model_type"]][2](spark, row["artifact_path"])
    rows = with_calendar(training_range(positions, F.lit(as_of - timedelta(days=days)), F.lit(as_of)))
    for kind, (fit, save, _, sequence_length) in kinds.items():
        if kind in models:
            continue
        if not enough_samples(rows, sequence_length):
            models[kind] = None
            continue
        version = f"{kind}_{as_of:%Y%m%d_%H%M%S}"
        model = fit(rows, version)
        save(spark, model, f"{model_folder}/{version}")
        registry = record_artifact(spark, registry_path, kind, version, model.metrics, f"{model_folder}/{version}",
                                   int(model.metrics["train_samples"]), registry)
        models[kind] = model
    return models


def experiment(spark: SparkSession, rows: DataFrame, folder: str, model_type: str = "isolation_forest", grid: dict | None = None,
               labels: DataFrame | None = None) -> tuple[Forest | SequenceModel, dict]:
    """Temporal split, search, evaluation on the later part, report."""
    from railtempo.operators.forest import forest_detections
    from railtempo.operators.matching import mark_detected, with_labels
    from railtempo.operators.reconstruct import sequence_detections

    split = checkpointed(ranks.with_temporal_split(rows))
    train, validation = split.filter("is_train").drop("is_train"), split.filter("not is_train").drop("is_train")
    if model_type == "isolation_forest":
        model, results = best_forest(train, validation, grid)
        found = forest_detections(validation, model)
    elif model_type == "sequence_model":
        model, results = best_sequences(train, grid)
        found = sequence_detections(validation, model)
    else:
        raise ValueError(f"unknown model type {model_type}")
    metrics = evaluate.detection_rate(validation, found).first().asDict()
    metrics["severity_stats"] = evaluate.severity_statistics(found).first().asDict()
    if labels is not None:
        judged = with_labels(mark_detected(validation, found).select("id", "predicted"), labels)
        metrics |= evaluate.precision_recall(judged).first().asDict()
    results["validation_metrics"] = metrics
    save_report(spark, folder, model_type, results)
    return model, results


def save_report(spark: SparkSession, folder: str, model_type: str, results: dict) -> None:
    """JSON report and CSV history of parameters and metrics."""
    import json

    report = spark.createDataFrame([(json.dumps({"model_type": model_type, "results": results}, default=str),)], "value string")
    report.coalesce(1).write.mode("overwrite").text(f"{folder}/{model_type}_training_report")
    history = spark.createDataFrame([{k: str(v) for k, v in row.items()} for row in results["training_history"]])
    history.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{model_type}_training_history")
