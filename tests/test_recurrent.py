"""Non-linear sequence detector: states, read-out, breaks that a linear one can't see."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from railtempo import schemas
from railtempo.operators import reconstruct, recurrent
from railtempo.plans import training

T0 = dt.datetime(2025, 1, 6)
COLUMNS = ["headway_seconds", "delay_seconds"]
FIELDS = ("id long, timestamp timestamp, line string, direction int, current_station string, headway_seconds double, "
          "delay_seconds double, trip_id string, route_id string")


def chaotic(n: int, seed: int, breaks: list[int]) -> np.ndarray:
    """Two columns of the full quadratic map: rows have no linear correlation, yet each follows from the last. At ``breaks`` it
    starts anew from the map's own distribution, so that no single row looks odd."""
    draw = np.random.default_rng(seed)
    x = np.empty((n, 2))
    for k in range(n):
        fresh = np.sin(np.pi / 2 * draw.uniform(size=2)) ** 2
        x[k] = fresh if k == 0 or k in breaks else np.clip(4 * x[k - 1] * (1 - x[k - 1]), 1e-9, 1 - 1e-9)
    return x


@pytest.fixture(scope="module")
def series(spark):
    """Two lines of 1,500 rows with a break each 100 rows, and one too short for any sequence."""
    breaks = list(range(90, 1500, 100))
    rows, broken = [], []
    for line, n, seed in (("A", 1500, 1), ("C", 1500, 2), ("Z", 5, 3)):
        for k, (a, b) in enumerate(chaotic(n, seed, breaks)):
            rows.append((len(rows), T0 + dt.timedelta(minutes=k), line, 0, "S1", float(a), float(b), f"t{k}", line))
            if k in breaks:
                broken.append(rows[-1][0])
    return spark.createDataFrame(rows, FIELDS), broken


def plain_states(nets, x):
    """One row at a time."""
    (fr, fi, fb), (br, bi, bb) = nets
    out = []
    for k in range(len(x)):
        f, b = np.zeros(len(fb)), np.zeros(len(bb))
        for row in x[:k]:
            f = np.tanh(fr @ f + fi @ row + fb)
        for row in x[:k:-1]:
            b = np.tanh(br @ b + bi @ row + bb)
        out.append(np.concatenate([[1.0], f, b]))
    return np.array(out)


def test_states():
    nets = recurrent.random_nets(3, 7)
    x = np.random.default_rng(0).standard_normal((4, 9, 3))
    np.testing.assert_allclose(recurrent.states(nets, x), [plain_states(nets, one) for one in x], atol=1e-12)
    assert np.linalg.norm(nets[0][0], 2) == pytest.approx(0.6)


def test_products_and_readout(spark, series):
    rows, _ = series
    model = recurrent.fit_recurrent(rows, units=5, length=6, columns=COLUMNS, penalty=1e-3)
    numbered = reconstruct.numbered_rows(rows, COLUMNS, model.normaliser)
    x = np.array([r["x"] for r in reconstruct.vectors_of(numbered, COLUMNS, 6).collect()]).reshape(-1, 6, 2)
    assert len(x) == 2 * (1500 - 5)
    z = np.concatenate([plain_states(model.nets, one) for one in x])
    y = x.reshape(-1, 2)
    for block in (7, 4096):  # the cut into blocks leaves no trace
        got = {(r["i"], r["j"]): r["value"] for r in recurrent.state_products(numbered, model, block).collect()}
        want = z.T @ np.hstack([z, y])
        np.testing.assert_allclose([[got[i, j] for j in range(13)] for i in range(11)], want, rtol=1e-9, atol=1e-6)
    ridge = np.diag([0.0] + [1e-3 * len(z)] * 10)
    np.testing.assert_allclose(model.readout, np.linalg.solve(z.T @ z + ridge, z.T @ y), rtol=1e-6, atol=1e-9)
    errors = sorted(r["error"] for r in reconstruct.sequence_errors(numbered, model).collect())
    plain = ((y - z @ model.readout) ** 2).mean(axis=1).reshape(-1, 6).mean(axis=1)
    np.testing.assert_allclose(errors, np.sort(plain), rtol=1e-6)
    assert model.metrics["final_loss"] == pytest.approx(plain.mean())
    assert model.threshold == pytest.approx(np.quantile(plain, 0.95))


def found_share(rows, model, broken):
    """Of as many rows of largest error as there are breaks, the share that lies at a break."""
    model.threshold = -1.0
    worst = reconstruct.position_errors(rows, model).groupBy("id").agg(F.avg("error").alias("e")).orderBy(F.desc("e")).limit(len(broken))
    return np.mean([any(abs(r["id"] - b) <= 1 for b in broken) for r in worst.collect()])


def test_breaks_that_are_not_linear(series):
    rows, broken = series
    curved = recurrent.fit_recurrent(rows, columns=COLUMNS)
    flat = reconstruct.fit_sequences(rows, columns=COLUMNS)
    here, there = found_share(rows, curved, broken), found_share(rows, flat, broken)
    assert here >= 0.8 and there <= 0.3, (here, there)


def test_detections_and_storage(spark, series, tmp_path):
    rows, _ = series
    holes = rows.withColumn("delay_seconds", F.when(F.col("id") % 50 > 0, F.col("delay_seconds")))  # nulls count as 0
    model = recurrent.fit_recurrent(holes, units=8, length=6, columns=COLUMNS, version="v7")
    found = reconstruct.sequence_detections(holes, model, name="recurrent_model")
    assert found.columns == schemas.DETECTION_COLUMNS
    listed = found.select("source_position_id", "model_name", "model_version", "severity").collect()
    assert listed and len({r[0] for r in listed}) == len(listed)
    assert {r[1:3] for r in listed} == {("recurrent_model", "v7")} and all(0 < r[3] <= 1 for r in listed)
    training.save_recurrent(spark, model, str(tmp_path / "m"))
    back = training.load_recurrent(spark, str(tmp_path / "m"))
    assert np.array_equal(back.readout, model.readout) and np.array_equal(back.nets[1][0], model.nets[1][0])
    again = reconstruct.sequence_detections(holes, back, name="recurrent_model").select("source_position_id", "severity")
    assert sorted(again.collect()) == sorted(found.select("source_position_id", "severity").collect())


def test_too_few_rows(series):
    rows, _ = series
    with pytest.raises(ValueError):
        recurrent.fit_recurrent(rows.filter("line = 'Z'"), length=6, columns=COLUMNS)
    with pytest.raises(ValueError):
        recurrent.fit_recurrent(rows.filter("id < 0"), length=6, columns=COLUMNS)
