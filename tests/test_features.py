"""Scalar functions, headway and rolling frames on small literal or random rows."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from railtempo.functions import features, scalar as fx
from railtempo.operators import ranks, rolling, segments
from railtempo.operators.headway import latest_above, with_headway, with_headway_by_processing
from railtempo.operators.sequences import sliding_sequences
from railtempo.sources import derived

POSITION = "id long, timestamp timestamp, current_station string, direction int, arrival_time timestamp"
T0 = dt.datetime(2024, 3, 5, 7, 10, 0)


def test_trip_features(spark):
    row = spark.createDataFrame(
        [("run-17", "q", 0, None, T0, T0 + dt.timedelta(seconds=47))],
        "trip_id string, route_id string, direction int, delay_seconds int, arrival_time timestamp, departure_time timestamp",
    ).transform(features.with_trip_features).first()
    assert (row["line"], row["dwell_time_seconds"], row["delay_seconds"]) == ("Q", 47, 0)


@pytest.mark.parametrize("route,line", [("gs", "S"), (" s ", "S"), ("si", "SI"), ("6X", "6x"), ("b", "B"), ("", "")])
def test_lines(spark, route, line):
    assert spark.range(1).select(fx.line_of_route(F.lit(route))).first()[0] == line


def test_dwell_edges(spark):
    df = spark.createDataFrame(
        [(T0, T0 + dt.timedelta(milliseconds=400)), (T0, T0), (T0, T0 - dt.timedelta(seconds=3)), (None, T0)],
        "a timestamp, d timestamp")
    assert [r[0] for r in df.select(fx.dwell_seconds("a", "d")).collect()] == [0, None, None, None]


@pytest.mark.parametrize("at,hour,dow,weekend,rush", [
    (dt.datetime(2025, 1, 6, 8, 0), 8, 0, 0, 1), (dt.datetime(2025, 1, 11, 14, 0), 14, 5, 1, 0),
    (dt.datetime(2025, 1, 6, 10, 59), 10, 0, 0, 1), (dt.datetime(2025, 1, 6, 20, 59), 20, 0, 0, 1),
    (dt.datetime(2025, 1, 6, 21, 0), 21, 0, 0, 0), (dt.datetime(2025, 1, 12, 8, 0), 8, 6, 1, 0)])
def test_calendar(spark, at, hour, dow, weekend, rush):
    row = features.with_calendar(spark.createDataFrame([(at,)], "timestamp timestamp")).first()
    assert (row["hour"], row["day_of_week"], row["is_weekend"], row["is_rush_hour"]) == (hour, dow, weekend, rush)


def test_severity_edges(spark):
    df = spark.createDataFrame([(0.33,), (0.67,), (0.32,), (0.4,), (0.7,)], "s double")
    rows = df.select(fx.severity_class("s"), fx.marker_band("s")).collect()
    assert [tuple(r) for r in rows] == [("medium", "yellow"), ("high", "amber"), ("low", "yellow"), ("medium", "yellow"), ("high", "amber")]


def test_anomaly_kind(spark):
    df = spark.createDataFrame([(3.0, None, 10), (None, -2.5, -301), (2.0, 2.0, 300), (None, None, None)], "h double, d double, l int")
    assert [r[0] for r in df.select(fx.anomaly_kind("h", "d", "l")).collect()] == ["headway", "dwell_delay", "combined", "combined"]


def test_percent_and_iso(spark):
    row = spark.createDataFrame([(0.4015, T0)], "s double, t timestamp").select(
        fx.percent_text("s"), fx.percent_text("s", 1), fx.iso_text("t"), fx.clock_text("t")).first()
    assert tuple(row) == ("40%", "40.2%", "2024-03-05T07:10:00", "07:10:00")


def test_model_columns(spark):
    df = spark.createDataFrame([(1, 2, 0.5, "x")], "id long, delay_seconds int, delay_seconds_zscore double, line string")
    assert features.forest_columns(df) == ["delay_seconds", "delay_seconds_zscore"]
    assert features.dataset_columns(df, "delay_seconds") == ["delay_seconds_zscore"]


def test_station_slots(spark):
    df = spark.createDataFrame([("S1",), ("S2",), ("S1",)], "current_station string")
    rows = features.with_station_slots(df).collect()
    assert rows[0]["station_slot"] == rows[2]["station_slot"] != rows[1]["station_slot"]
    assert rows[0]["station_vector"].size == 472 and rows[0]["station_vector"][rows[0]["station_slot"]] == 1.0


def _positions(spark, rows):
    return spark.createDataFrame([(i, t, s, d, a) for i, (t, s, d, a) in enumerate(rows)], POSITION)


def test_headway_edges(spark):
    minute = dt.timedelta(minutes=1)
    rows = [
        (T0, "harbour", 0, T0), (T0, "harbour", 0, T0 + 7 * minute), (T0, "harbour", 0, T0 + 37 * minute),
        (T0, "harbour", 0, T0 + 67 * minute - dt.timedelta(seconds=1)), (T0, "harbour", 0, None), (T0, None, 0, T0),
        (T0, None, 0, T0 + minute), (T0, "harbour", 1, T0 + minute), (T0, "harbour", 0, T0 + 7 * minute)]
    got = {r["id"]: r["headway_seconds"] for r in with_headway(_positions(spark, rows)).collect()}
    # equal arrivals: the later id is 0 s behind; a gap of exactly 30 minutes gives null
    assert got == {0: None, 1: 420, 8: 0, 2: None, 3: 1799, 4: None, 5: None, 6: 60, 7: None}


def _random_positions(seed, n=400, stations=("A", "B", None), hours=30):
    rng = np.random.default_rng(seed)
    at = pd.Timestamp(T0) + pd.to_timedelta(np.sort(rng.integers(0, hours * 3600 * 50, n)) * 20, unit="ms")
    pdf = pd.DataFrame({
        "id": np.arange(n), "timestamp": at, "current_station": rng.choice(np.array(stations, dtype=object), n, p=[0.7, 0.2, 0.1]),
        "direction": rng.integers(0, 2, n).astype("int32"),
        "arrival_time": at - pd.to_timedelta(rng.integers(0, 3000, n), unit="s"),
    })
    pdf.loc[rng.random(n) < 0.1, "arrival_time"] = pd.NaT
    for c in ("headway_seconds", "dwell_time_seconds", "delay_seconds"):
        pdf[c] = pd.array(rng.integers(-20, 20, n), dtype="Int32")
        pdf.loc[rng.random(n) < 0.2, c] = pd.NA
    return pdf


def _frame(spark, pdf):
    schema = POSITION + ", headway_seconds int, dwell_time_seconds int, delay_seconds int"
    rows = [tuple(None if pd.isna(v) else (v.to_pydatetime() if isinstance(v, pd.Timestamp) else (v if isinstance(v, str) else int(v)))
                  for v in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("slice_minutes,call,plan", [
    (None, 10 ** 6, {}), (20, 10 ** 6, {}), (None, 5, {}), (20, 3, {}), (20, 7, {"spark.sql.adaptive.enabled": "false"}),
    (20, 7, {"spark.sql.autoBroadcastJoinThreshold": "-1"})])
def test_rolling_equals_pandas(spark, monkeypatch, seed, slice_minutes, call, plan):
    monkeypatch.setattr(segments, "ROWS_PER_CALL", call)
    pdf = _random_positions(seed)
    df = _frame(spark, pdf)
    before = {k: spark.conf.get(k) for k in plan} | {"spark.sql.execution.arrow.maxRecordsPerBatch": spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for k, v in (plan | {"spark.sql.execution.arrow.maxRecordsPerBatch": "4" if call < 10 else "10000"}).items():
            spark.conf.set(k, v)
        got = rolling.with_rolling_percentile(rolling.with_rolling(df, slice_minutes=slice_minutes), slice_minutes=slice_minutes).toPandas()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = got.set_index("id").sort_index()
    want = pdf.copy()
    for c in rolling.METRIC_COLUMNS:
        want[c] = want[c].astype("float64")
    want = want.set_index("timestamp")
    assert want.index.is_unique
    groups = want.groupby(["current_station", "direction"])
    for c in rolling.METRIC_COLUMNS:
        hour = groups[c].transform(lambda x: (x - x.rolling("1h", min_periods=1).mean()) / (x.rolling("1h", min_periods=1).std() + 1e-7))
        np.testing.assert_allclose(got[f"{c}_zscore"].to_numpy(float), hour.to_numpy(), rtol=1e-6, atol=1e-6)
        share = groups[c].transform(lambda x: x.rolling("1h", min_periods=1).rank(pct=True))
        np.testing.assert_allclose(got[f"{c}_percentile"].to_numpy(float), share.to_numpy(), rtol=1e-9)
        for h in (3, 24):
            mean = groups[c].transform(lambda x: x.rolling(f"{h}h", min_periods=1).mean())
            std = groups[c].transform(lambda x: x.rolling(f"{h}h", min_periods=1).std())
            np.testing.assert_allclose(got[f"{c}_rolling_{h}h_mean"].to_numpy(float), mean.to_numpy(), rtol=1e-9, atol=1e-9)
            np.testing.assert_allclose(got[f"{c}_rolling_{h}h_std"].to_numpy(float), std.to_numpy(), rtol=1e-6, atol=1e-6)


@pytest.mark.parametrize("slice_minutes", [None, 10])
def test_rolling_numbers_of_any_size(spark, slice_minutes):
    """Small numbers after large ones, thirds, NaN and infinity: each frame is as if it stood alone."""
    rng = np.random.default_rng(3)
    values = [*np.arange(4) * 1e-9, 1e15, -3e120, *rng.normal(size=60) / 3, float("nan"), 1e13, *rng.normal(size=60) * 1e-7, float("inf"), None, *rng.normal(size=60)]
    minutes = np.cumsum(rng.integers(1, 30, len(values)))
    pdf = pd.DataFrame({"id": range(len(values)), "timestamp": [T0 + dt.timedelta(minutes=int(m)) for m in minutes], "v": values})
    rows = [(int(r.id), r.timestamp.to_pydatetime(), "A", 0, None if v is None else float(v)) for r, v in zip(pdf.itertuples(), values)]
    df = spark.createDataFrame(rows, "id long, timestamp timestamp, current_station string, direction int, v double")
    got = {r.id: r for r in rolling.with_rolling(df, ["v"], 1, (3,), slice_minutes=slice_minutes).collect()}
    seen = 0
    for i, m in enumerate(minutes):
        for hours in (1, 3):
            inside = np.array([v for v, n in zip(values, minutes) if v is not None and m - hours * 60 < n <= m], float)
            with np.errstate(invalid="ignore"):
                mean, std = inside.mean() if len(inside) else None, inside.std(ddof=1) if len(inside) > 1 else None
            if hours == 3:
                assert (got[i].v_rolling_3h_mean is None) == (mean is None) and (got[i].v_rolling_3h_std is None) == (std is None)
                for own, wanted in ((got[i].v_rolling_3h_mean, mean), (got[i].v_rolling_3h_std, std)):
                    if wanted is not None and np.isfinite(inside).all():
                        assert own == pytest.approx(wanted, rel=1e-9, abs=1e-24)
                        seen += 1
            elif std is not None and values[i] is not None and np.isfinite(inside).all():
                assert got[i].v_zscore == pytest.approx((values[i] - mean) / (std + 1e-7), rel=1e-8, abs=1e-9)
    assert seen > 300


def test_rolling_hot_instant(spark):
    """Many rows of one key at one instant count for each other."""
    rows = [(i, T0, "A", 0, None, None, None, i % 5) for i in range(50)]
    df = spark.createDataFrame(rows, POSITION + ", headway_seconds int, dwell_time_seconds int, delay_seconds int")
    row = rolling.with_rolling_percentile(rolling.with_rolling(df)).filter("delay_seconds = 4").first()
    assert row["delay_seconds_percentile"] == pytest.approx(0.91)
    assert row["delay_seconds_zscore"] == pytest.approx(2 / (np.std([0, 1, 2, 3, 4] * 10, ddof=1) + 1e-7))


def brute_processing_headway(pdf, horizon=1800):
    out = {}
    for _, g in pdf.groupby([pdf["current_station"].fillna("none"), "direction"]):
        rows = list(g.sort_values(["timestamp", "id"]).itertuples())
        for i, r in enumerate(rows):
            out[r.id] = None
            if pd.isna(r.arrival_time):
                continue
            for p in reversed(rows[:i]):
                if (r.timestamp - p.timestamp).total_seconds() >= horizon:
                    break
                if not pd.isna(p.arrival_time) and (r.arrival_time - p.arrival_time).total_seconds() < horizon:
                    out[r.id] = int((r.arrival_time - p.arrival_time).total_seconds())
                    break
    return out


@pytest.mark.parametrize("slice_minutes,rows_per_call", [(30, 200_000), (5, 200_000), (30, 4)])
def test_processing_headway_brute_force(spark, monkeypatch, slice_minutes, rows_per_call):
    # tiny calls cut groups in the middle, which must not be visible in the result
    monkeypatch.setattr(segments, "ROWS_PER_CALL", rows_per_call)
    if rows_per_call < 100:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    pdf = _random_positions(7, n=900)
    df = _frame(spark, pdf).select("id", "timestamp", "current_station", "direction", "arrival_time")
    got = {r["id"]: r["headway_seconds"] for r in with_headway_by_processing(df, slice_minutes=slice_minutes).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute_processing_headway(pdf)
    assert got == want and any(v is not None and v < 0 for v in want.values())


def test_latest_above():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 64, 100):
        values, bound = rng.integers(0, 9, n), rng.integers(-1, 10, n)
        want = [max([j for j in range(i) if values[j] > bound[i]], default=-1) for i in range(n)]
        assert latest_above(values, bound).tolist() == want


def test_weighted_counts():
    rng = np.random.default_rng(4)
    segment = np.sort(rng.integers(0, 6, 200))
    values, weights = rng.integers(0, 8, 200), rng.choice([-1.0, 0.0, 1.0, 3.0], 200)
    smaller, equal = rolling.weighted_counts_before(segment, values, weights)
    for i in range(200):
        before = (np.arange(200) < i) & (segment == segment[i])
        assert smaller[i] == weights[before & (values < values[i])].sum()
        assert equal[i] == weights[before & (values == values[i])].sum()


def test_percentiles_against_numpy(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(0, 1, 500), np.zeros(300), rng.integers(-5, 5, 200), [1e-12, -1e9, 3e12]])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    shares = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    row = ranks.exact_percentiles(df, "v", shares).first()
    for name, share in shares.items():
        assert row[name] == pytest.approx(np.percentile(values, share * 100), rel=1e-12)


def test_percentiles_of_nothing(spark):
    assert ranks.exact_percentiles(spark.createDataFrame([], "v double"), "v", {"a": 0.5}).first()["a"] is None


@pytest.mark.parametrize("length,stride,block", [(3, 1, 3), (3, 2, 4), (5, 3, 50)])
def test_sequences(spark, length, stride, block):
    rows = [(i, T0 + dt.timedelta(minutes=i // 2), "A" if i % 3 else "B", 0) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, timestamp timestamp, line string, direction int")
    got = {(r["line"], r["start"]): [x["id"] for x in r["items"]] for r in sliding_sequences(df, ["id"], length, stride, block_rows=block).collect()}
    want = {}
    for line in "AB":
        ids = [r[0] for r in rows if r[2] == line]
        for s in range(0, len(ids) - length + 1, stride):
            want[line, s] = ids[s:s + length]
    assert got == want


@pytest.mark.parametrize("n,share", [(10, 0.8), (7, 0.5), (5, 1.0), (1, 0.8)])
def test_temporal_split(spark, n, share):
    rows = [(i, T0 + dt.timedelta(seconds=i // 3)) for i in range(n)]
    got = ranks.with_temporal_split(spark.createDataFrame(rows, "id long, timestamp timestamp"), share)
    assert sorted(r["id"] for r in got.filter("is_train").collect()) == list(range(int(n * share)))


def test_ranks_of_values_in_one_magnitude(spark):
    rng = np.random.default_rng(8)
    values = np.concatenate([1 + rng.random(3_000) * 1e-3, -(1 + rng.random(1_000) * 1e-3), [1.0005] * 500, [0.0, -0.0]])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, v double")
    # all positive ones share a magnitude bucket, but no task ranks more than a small part of them
    fine = df.filter("v > 0").groupBy(ranks.magnitude_bucket(F.col("v")).alias("b"), ranks.magnitude_bucket(F.col("v"), 512 * 4096).alias("f")).count()
    assert fine.select("b").distinct().count() == 1 and fine.select("f").distinct().count() > 1_000
    got = ranks.exact_percentiles(df, "v", {"a": 0.01, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0}).first()
    np.testing.assert_allclose(list(got), np.quantile(values, [0.01, 0.25, 0.5, 0.95, 1.0]), rtol=1e-15)
    share = {r["id"]: r["s"] for r in ranks.average_rank_share(df, "v", "s").collect()}
    want = pd.Series(values).rank(pct=True)
    np.testing.assert_allclose([share[i] for i in range(len(values))], want, rtol=1e-12)


def test_partitions_of_rolling_frames_follow_the_rows(spark, sf, monkeypatch):
    """A task's share stays the same however many rows there are, and so do the results."""
    rows = with_headway(derived.positions_with_dwell(spark, sf))
    few = rolling.with_rolling(rows, ["delay_seconds"], 3, (6,))
    monkeypatch.setattr(rolling, "ROWS_PER_TASK", 20)
    many = rolling.with_rolling(rows, ["delay_seconds"], 3, (6,))
    wanted = -(-rows.count() * 3 // 20)
    assert f"{wanted}), REPARTITION_BY_NUM" in many._jdf.queryExecution().executedPlan().toString() and wanted > 8
    assert "REPARTITION_BY_NUM" not in few._jdf.queryExecution().executedPlan().toString()
    shown = lambda df: sorted((r["id"], *(None if r[c] is None else round(r[c], 9) for c in df.columns if "rolling" in c or "zscore" in c)) for r in df.collect())
    assert shown(few) == shown(many)
