"""Forest, sequence detector, ensemble, evaluation, training."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from railtempo import schemas
from railtempo.functions.features import BASE_FEATURES, with_calendar
from railtempo.operators import evaluate, forest, reconstruct, rules
from railtempo.operators.ensemble import combine_detections
from railtempo.operators.headway import with_headway
from railtempo.plans import detection, training
from railtempo.sources import derived, tables

T0 = dt.datetime(2025, 1, 6, 8, 0, 0)


@pytest.fixture(scope="module")
def rows(spark, sf):
    return with_calendar(with_headway(derived.positions_with_dwell(spark, sf))).persist()


@pytest.fixture(scope="module")
def model(rows):
    return forest.fit_forest(rows, BASE_FEATURES)


def plain_score(model, x):
    """Score of one row by walking every tree."""
    total = 0.0
    for root in model.roots:
        at = root
        while model.feature[at] >= 0:
            at = model.low[at] if x[model.feature[at]] <= model.cut[at] else model.high[at]
        total += model.depth[at]
    n = model.sample_size
    norm = 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
    return -2 ** (-(total / len(model.roots)) / norm)


def test_tree_isolates_an_outlier():
    x = np.concatenate([np.random.default_rng(0).normal(size=(255, 2)), [[50.0, 50.0]]])
    depths = []
    for seed in range(50):
        nodes = forest.grow_tree(x, 8, np.random.default_rng(seed))
        at, depth = 0, 0
        while nodes["feature"][at] >= 0:
            at, depth = nodes["low"][at] if x[-1, nodes["feature"][at]] <= nodes["cut"][at] else nodes["high"][at], depth + 1
        depths.append(depth)
    assert np.mean(depths) < 3


def test_samples_are_exact_and_distinct(rows):
    drawn = forest.tree_samples(rows, BASE_FEATURES, rows.count(), 20, 256, "id", 42)
    sizes = drawn.groupBy("tree").agg(F.count("*").alias("n"), F.countDistinct("id").alias("d")).collect()
    assert len(sizes) == 20 and all(r["n"] == r["d"] == 256 for r in sizes)


def test_scores_equal_plain_walk(rows, model):
    scored = forest.with_scores(rows, model).limit(50).fillna(0).collect()
    for r in scored:
        assert r["score"] == pytest.approx(plain_score(model, [float(r[c]) for c in BASE_FEATURES]), abs=1e-12)


def test_fit_is_repeatable(rows, model):
    again = forest.fit_forest(rows, BASE_FEATURES)
    assert again.threshold == model.threshold and np.array_equal(again.cut, model.cut)


def test_forest_detections(rows, model):
    found = forest.forest_detections(rows, model)
    assert found.columns == schemas.DETECTION_COLUMNS
    stats = found.agg(F.min("severity"), F.max("severity"), F.count("*")).first()
    assert 0 < stats[0] <= stats[1] == 1.0
    assert stats[2] == pytest.approx(50, abs=2)
    assert model.metrics["anomaly_rate"] == pytest.approx(0.05, abs=0.01)


def test_severity_floor_clips(spark):
    scored = spark.createDataFrame([(-0.9,), (-0.3,)], "score double")
    assert [r["severity"] for r in forest.with_batch_severity(scored, -0.6).collect()] == [1.0, pytest.approx(0.5)]


def test_sequence_detector(spark, rows, tmp_path):
    model = reconstruct.fit_sequences(rows, components=6, length=12)
    every = reconstruct.sequence_detections(rows, model, "all")
    most = reconstruct.sequence_detections(rows, model)
    assert most.columns == schemas.DETECTION_COLUMNS
    assert most.count() == every.select("source_position_id").distinct().count() <= every.count()
    top = every.groupBy("source_position_id").agg(F.max("severity").alias("s"))
    assert most.join(top, "source_position_id").filter("abs(severity - s) > 1e-12").count() == 0
    # positions map back to their rows: position k of the sequence starting at s is row s + k
    vectors = reconstruct.sequence_vectors(rows, model.columns, 12, model.normaliser)
    one = vectors.filter("line = 'A' and start = 3").first()
    from railtempo.operators.ranks import with_position
    placed = {r["position"]: r["id"] for r in with_position(rows.filter(f"line = 'A' and direction = {one['direction']}"), ["line", "direction"], "timestamp", "id").collect()}
    assert one["ids"] == [placed[3 + k] for k in range(12)]
    # the share of sequences above the threshold is what the percentile says
    numbered = reconstruct.numbered_rows(rows, model.columns, model.normaliser)
    errors = reconstruct.sequence_errors(numbered, model, block_rows=13).withColumnRenamed("error", "e")
    x = np.stack([r["x"] for r in vectors.select("x").collect()])
    centred = x - model.mean
    plain = ((centred - centred @ model.components @ model.components.T) ** 2).mean(axis=1)
    np.testing.assert_allclose(sorted(r["e"] for r in errors.collect()), np.sort(plain), rtol=1e-9)
    assert errors.filter(F.col("e") > model.threshold).count() / errors.count() == pytest.approx(0.05, abs=0.01)
    training.save_sequences(spark, model, str(tmp_path / "m"))
    back = training.load_sequences(spark, str(tmp_path / "m"))
    assert np.array_equal(back.components, model.components) and back.threshold == model.threshold


def _detection(spark, data):
    rows = [(s, l, k, sev, m, "v", {"x": float(i)}, {"timestamp": t.isoformat()}, i, t) for s, l, k, sev, m, i, t in data]
    return spark.createDataFrame(rows, schemas.DETECTION)


def test_ensemble(spark):
    minute = dt.timedelta(minutes=1)
    found = _detection(spark, [
        ("S1", "A", "delay", 0.4, "one", 1, T0), ("S1", "A", "sequence", 0.9, "two", 2, T0 + minute),
        ("S1", "A", "sequence", 0.3, "two", 3, T0 + 4 * minute), ("S1", "A", "delay", 0.5, "one", 4, T0 + 5 * minute),
        ("S2", "A", "delay", 0.2, "one", 5, T0), (None, None, "delay", 0.2, "one", 6, T0), (None, None, "delay", 0.6, "one", 7, T0)])
    out = {(r["station_id"], r["detection_count"]): r for r in combine_detections(found, model_order=["two", "one"]).collect()}
    assert set(out) == {("S1", 3), ("S1", 1), ("S2", 1), (None, 2)}
    big = out["S1", 3]
    assert (big["anomaly_type"], big["model_version"], big["severity"], big["distinct_models"]) == ("ensemble", "ensemble_3", 0.9, 2)
    # detector order decides which features come first; the last severity of a detector wins
    assert big["features"] == {"x": 2.0} and big["individual_severities"] == {"one": 0.4, "two": 0.3}
    assert big["model_counts"] == {"one": 1, "two": 2}
    assert out["S1", 1]["anomaly_type"] == "delay" and out["S1", 1]["source_position_id"] == 4
    assert out[None, 2]["model_version"] == "ensemble_2" and out[None, 2]["distinct_models"] == 1
    whole = combine_detections(found.withColumn("meta_data", F.create_map().cast("map<string,string>")), "metadata")
    assert {r["station_id"]: r["detection_count"] for r in whole.collect()} == {"S1": 4, "S2": 1, None: 2}


def test_detector_set(spark, rows, model):
    detectors = detection.DetectorSet()
    detectors.register("isolation_forest", model)
    detectors.register("delay_rule", rules.delay_rule)
    detectors.register("broken", lambda df: df.select("no_such_column"))
    assert detectors.is_loaded("delay_rule") and not detectors.is_loaded("other")
    combined = detectors.combined(rows)
    counts = combined.agg(F.sum("detection_count")).first()[0]
    assert counts == forest.forest_detections(rows, model).count() + rules.delay_rule(rows).count()
    assert detectors.stats()["model_count"] == 3 and detectors.stats()["last_run"]
    stored = detection.as_anomalies(combined)
    assert stored.filter("meta_data is null or severity is null").count() == 0


def test_detection_run(spark):
    detectors = detection.DetectorSet()
    detectors.register("delay_rule", rules.delay_rule)
    raw = with_headway(derived.positions_with_dwell(spark, "/root/testdata/sf0.01"))
    got = detection.detection_run(raw, detectors, minutes=360).agg(F.sum("detection_count")).first()[0]
    newest = raw.agg(F.max("timestamp")).first()[0]
    want = raw.filter((F.col("timestamp") >= F.lit(newest - dt.timedelta(minutes=360)).cast("timestamp_ntz")) & (F.abs("delay_seconds") > 300)).count()
    assert got == want > 0


def test_evaluation_edges(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "is_anomaly int, predicted int")
    row = evaluate.precision_recall(df).first()
    assert (row["precision"], row["recall"], row["f1"], row["support"]) == (0.0, 0.0, 0.0, 0)
    report = {r["class"]: r for r in evaluate.class_report(df).collect()}
    assert report[0]["f1"] == 1.0


def test_synthetic_labels_without_measures(spark):
    df = evaluate.synthetic_labels(spark.range(20000))
    assert df.agg(F.avg("is_anomaly")).first()[0] == pytest.approx(0.05, abs=0.01)


def test_augmentation(spark, rows, sf):
    labelled = rows.join(derived.labels(spark, sf), "id")
    k = labelled.filter("is_anomaly = 1").count()
    out = evaluate.augment_anomalies(labelled, 2.5)
    assert out.count() == labelled.count() + int(k * 1.5)
    assert out.filter("is_anomaly = 1").count() == k + int(k * 1.5)
    assert {r[0] for r in out.select("is_anomaly").distinct().collect()} == {0, 1}


def test_forest_round_trip(spark, model, tmp_path):
    training.save_forest(spark, model, str(tmp_path / "m"))
    back = training.load_forest(spark, str(tmp_path / "m"))
    x = np.random.default_rng(0).normal(size=(20, len(BASE_FEATURES))) * 100
    assert np.array_equal(forest.tree_scores(back.arrays(), x), forest.tree_scores(model.arrays(), x))
    assert back.threshold == model.threshold and back.columns == model.columns


def test_experiment(spark, rows, tmp_path, sf):
    grid = {"contamination": [0.02, 0.05], "n_estimators": [10, 20], "max_samples": ["auto", 0.5]}
    model, results = training.experiment(spark, rows, str(tmp_path), grid=grid, labels=derived.labels(spark, sf))
    assert len(results["training_history"]) == 8 and results["best_score"] == max(r["f1"] for r in results["training_history"])
    assert len(model.roots) == results["best_params"]["n_estimators"]
    assert results["validation_metrics"]["positions_checked"] == 200 and "f1" in results["validation_metrics"]
    assert spark.read.option("header", True).csv(f"{tmp_path}/isolation_forest_training_history").count() == 8
    assert spark.read.text(f"{tmp_path}/isolation_forest_training_report").count() == 1


def test_sequence_search(spark, rows):
    _, results = training.best_sequences(rows, {"components": [2, 5]}, length=6)
    losses = [r["val_loss"] for r in results["training_history"]]
    assert losses[0] > losses[1] == results["best_score"] and results["best_params"] == {"components": 5}


def test_load_or_train(spark, tmp_path, sf):
    positions = with_headway(derived.positions_with_dwell(spark, "/root/testdata/sf0.01"))
    as_of = dt.datetime(2024, 1, 20)
    registry, folder = str(tmp_path / "registry"), str(tmp_path / "models")
    trained = training.load_or_train(spark, positions, registry, folder, as_of)
    assert all(trained[k] is not None for k in ("isolation_forest", "sequence_model"))
    stored = tables.read_table(spark, registry)
    assert stored.filter("is_active").count() == 2
    loaded = training.load_or_train(spark, positions, registry, folder, as_of + dt.timedelta(days=1), stored)
    assert loaded["isolation_forest"].threshold == trained["isolation_forest"].threshold
    few = training.load_or_train(spark, positions, str(tmp_path / "r2"), folder, dt.datetime(2023, 1, 1))
    assert few == {"isolation_forest": None, "sequence_model": None}


def test_detector_failing_while_running_is_left_out(spark, sf):
    rows = derived.positions_with_dwell(spark, sf).withColumn("headway_seconds", F.lit(None).cast("int"))
    detectors = detection.DetectorSet()
    detectors.register("broken", lambda df: rules.delay_rule(df.withColumn("delay_seconds", F.raise_error(F.lit("sensor")).cast("int"))))
    detectors.register("delay", rules.delay_rule)
    detectors.register("second", lambda df: rules.delay_rule(df).withColumn("model_name", F.lit("a_rule")))
    found = detection.detection_run(rows, detectors, 360)
    assert list(detectors.failures) == ["broken"] and "sensor" in detectors.failures["broken"]
    several = found.filter("detection_count > 1").collect()
    assert several and all(set(r["model_counts"]) == {"delay_rule", "a_rule"} for r in several)
    ids = detection.as_anomalies(found).select("id").collect()
    assert sorted(ids) == sorted(detection.as_anomalies(found).select("id").collect()) and len(set(ids)) == len(ids)


def test_past_moment_leaves_the_future_out(spark):
    hours = [dt.datetime(2024, 1, 1, h) for h in range(6)]
    df = spark.createDataFrame([(h,) for h in hours], "timestamp timestamp")
    from railtempo.operators import filters

    got = filters.last_minutes(df, 60, as_of=hours[1]).collect()
    assert sorted(r[0] for r in got) == hours[:2]
    assert filters.lookback(df, 60, as_of=hours[1]).count() == 2 and filters.last_minutes(df, 60).count() == 2


def test_sample_sizes_are_honoured():
    from railtempo.operators.forest import resolve_sample_size

    assert resolve_sample_size(0.5, 100_000) == 50_000 and resolve_sample_size(0.8, 10_000_000) == 8_000_000
    assert resolve_sample_size("auto", 100) == 100 and resolve_sample_size("auto", 100_000) == 256
