"""Station files, feed messages, stored tables, upserts."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from railtempo import schemas
from railtempo.operators import filters, matching, upsert
from railtempo.sources import derived, feeds, tables

T0 = dt.datetime(2025, 1, 6, 8, 0, 0)


def _entity(id, trip=None, alert=None):
    return {"id": id, "trip_update": trip, "alert": alert}


MESSAGE = {
    "feed_code": "A", "header": {"timestamp": 1736150400},
    "entity": [
        _entity("1", {"trip": {"trip_id": "t1", "route_id": "A", "direction_id": 1}, "stop_time_update": [
            {"stop_id": "S1", "arrival": {"time": 1736150400, "delay": 40}, "departure": {"time": 1736150430}},
            {"stop_id": "S2", "arrival": {"time": 1736150500}},
            {"stop_id": "S3", "departure": {"time": 1736150600}}]}),
        _entity("2", {"trip": {"trip_id": "t2", "route_id": "C"}, "stop_time_update": []}),
        _entity("3", {"trip": {"trip_id": "t3", "route_id": "C"}, "stop_time_update": [{"stop_id": "S1", "arrival": {"time": 1736150700}}]},
                {"header_text": {"translation": [{"text": "ignored"}]}}),
        _entity("4", None, {"header_text": {"translation": []}}),
        _entity("5", None, {"header_text": {"translation": [{"text": "first"}, {"text": "second"}]}}),
        _entity("6"),
    ],
}


@pytest.fixture()
def landing(tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(MESSAGE) + "\n{broken\n")
    return str(folder)


def test_messages(spark, landing):
    messages = feeds.read_messages(spark, landing).filter("feed_code is not null")
    rows = {(r["trip_id"], r["stop_id"]): r for r in feeds.flatten_trips(messages).collect()}
    assert set(rows) == {("t1", "S1"), ("t1", "S2"), ("t1", "S3"), ("t3", "S1")}
    assert rows["t1", "S1"]["delay"] == 40 and rows["t1", "S2"]["delay"] == 0
    assert rows["t1", "S3"]["arrival_time"] is None and rows["t1", "S2"]["departure_time"] is None
    assert rows["t1", "S1"]["direction"] == 1 and rows["t3", "S1"]["direction"] == 0
    assert {(r["alert_id"], r["header"]) for r in feeds.extract_alerts(messages).collect()} == {("4", ""), ("5", "first")}
    log = feeds.feed_log(messages).first()
    assert (log["num_trips"], log["num_alerts"], log["feed_id"]) == (4, 2, "A")
    assert json.loads(log["raw_data"])["entity"][0]["id"] == "1"


def test_broken_line_is_kept_apart(spark, landing):
    assert feeds.read_messages(spark, landing).filter("feed_code is null").count() == 1


def test_station_file(spark, tmp_path):
    path = tmp_path / "stops.csv"
    path.write_text("﻿stop_id,stop_name,stop_lat,stop_lon\n1,One,40.1,-73.1\n,None,1,1\n2,Two,bad,-73.2\n1,Uno,40.3,-73.3\n", encoding="utf-8")
    rows = {r["id"]: r for r in feeds.read_station_file(spark, str(path)).collect()}
    assert set(rows) == {"1", "2"}
    assert rows["1"]["name"] == "Uno" and rows["1"]["lat"] == 40.3 and rows["1"]["location_type"] == "0"
    assert rows["2"]["lat"] is None
    good, bad = filters.split_valid(feeds.read_station_file(spark, str(path)))
    assert [r["id"] for r in good.collect()] == ["1"]
    assert bad.first()["violations"] == ["lat"]


def test_station_file_without_columns(spark, tmp_path):
    path = tmp_path / "stops.csv"
    path.write_text("stop_id\n7\n")
    row = feeds.read_station_file(spark, str(path)).first()
    assert (row["name"], row["lat"], row["lon"]) == ("Station 7", schemas.DEFAULT_LAT, schemas.DEFAULT_LON)


def test_positions_table(spark, tmp_path):
    path = str(tmp_path / "positions")
    rows = spark.createDataFrame([(1, T0, "t", "A", "A"), (2, T0 + dt.timedelta(days=1), "t", "A", "A")],
                                 "id long, timestamp timestamp, trip_id string, route_id string, line string")
    tables.append_positions(rows, path)
    tables.append_positions(rows.withColumn("timestamp", F.col("timestamp") + F.expr("interval 2 days")), path)
    back = tables.read_range(spark, path, "timestamp", T0 + dt.timedelta(days=1), T0 + dt.timedelta(days=2))
    assert sorted(r["id"] for r in back.collect()) == [1, 2]
    assert back.first()["direction"] == 0 and back.first()["delay_seconds"] == 0 and back.first()["headway_seconds"] is None
    assert "PartitionFilters: [isnotnull(date" in back._jdf.queryExecution().toString()


def test_anomaly_table_and_resolution(spark, tmp_path):
    path, log = str(tmp_path / "anomalies"), str(tmp_path / "log")
    rows = spark.createDataFrame([("S1", "A", "delay", 0.5, "m", "v"), ("S2", "C", "delay", 0.7, "m", "v")],
                                 "station_id string, line string, anomaly_type string, severity double, model_name string, model_version string")
    tables.append_anomalies(rows, path)
    stored = tables.read_anomalies(spark, path)
    assert stored.filter("not resolved and resolved_at is null and detected_at is not null").count() == 2
    target = stored.filter("station_id = 'S1'").first()["id"]
    assert tables.append_resolution(spark, target, stored, log)
    assert not tables.append_resolution(spark, 12345, stored, log)
    after = tables.read_anomalies(spark, path, log)
    assert {r["station_id"]: r["resolved"] for r in after.collect()} == {"S1": True, "S2": False}
    assert after.filter("resolved").first()["resolved_at"] is not None


def test_versioned_table(spark, tmp_path, sf):
    path = str(tmp_path / "stations")
    tables.replace_table(derived.stations(spark, sf), path)
    merged = upsert.upsert_stations(tables.read_table(spark, path), derived.positions(spark, sf))
    tables.replace_table(merged, path)
    rows = {r["id"]: r for r in tables.read_table(spark, path).collect()}
    assert set(rows) == {f"S{i}" for i in range(26)}
    again = upsert.upsert_stations(tables.read_table(spark, path), derived.positions(spark, sf))
    assert not tables.replace_if_changed(again, path) and len(list((tmp_path / "stations").glob("version_no=*"))) == 2
    assert tables.replace_if_changed(again.filter("id <> 'S4'"), path) and tables.read_table(spark, path).count() == 25
    assert rows["S4"]["name"] == "Station S4" and rows["S0"]["name"] == "NATION_0" and "GS" not in rows["S0"]["lines"]


def test_upsert_uses_station_file(spark):
    old = spark.createDataFrame([("A", "old", 1.0, 2.0, ["X"], None), ("Z", "kept", 1.0, 2.0, None, None)], schemas.STATION)
    file = spark.createDataFrame([("B", "from file", 5.0, 6.0), ("A", "new", 9.0, 9.0)], "id string, name string, lat double, lon double")
    seen = spark.createDataFrame([("A", "B", "x"), ("A", None, "y"), ("", None, "w"), ("C", None, "")],
                                 "current_station string, next_station string, route_id string")
    rows = {r["id"]: (r["name"], r["lines"]) for r in upsert.upsert_stations(old, seen, file).collect()}
    assert rows == {"A": ("old", ["X", "Y"]), "B": ("from file", ["X"]), "C": ("Station C", []), "Z": ("kept", None)}


def test_registry(spark, tmp_path):
    path = str(tmp_path / "registry")
    first = tables.record_artifact(spark, path, "forest", "v1", {"n": 1}, "/m/v1", 100)
    second = tables.record_artifact(spark, path, "forest", "v2", {"n": 2}, "/m/v2", 200, first)
    third = tables.record_artifact(spark, path, "other", "v1", {"n": 3}, "/m/o1", 10, second)
    assert {(r["model_type"], r["version"]) for r in upsert.active_models(third).collect()} == {("forest", "v2"), ("other", "v1")}
    assert third.count() == 3


def test_json_safe(spark):
    df = spark.sql("select cast(1.50 as decimal(9,2)) as d, date'2025-01-02' as day, timestamp'2025-01-02 03:04:05.5' as at, array(1, 2) as a")
    assert json.loads(tables.json_safe(df).first()[0]) == {"d": 1.5, "day": "2025-01-02", "at": "2025-01-02T03:04:05.500000", "a": [1, 2]}


def test_sample_gate(spark):
    assert filters.enough_samples(spark.range(100)) and not filters.enough_samples(spark.range(99))
    assert filters.enough_samples(spark.range(240), 24) and not filters.enough_samples(spark.range(239), 24)


def test_argument_checks(spark, sf):
    df = derived.positions(spark, sf)
    with pytest.raises(ValueError):
        filters.lookback(df, 5)
    with pytest.raises(ValueError):
        filters.page(derived.anomalies(spark, sf), 1, 101)


def test_filters_reach_the_scan(spark, sf):
    plan = filters.anomaly_filter(derived.anomalies(spark, sf), start=F.lit("2024-01-05 00:00:00"))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts,2024-01-05T00:00)" in plan


def test_routes_equal_brute_force(spark, sf):
    anomalies = derived.anomalies(spark, sf)
    subscriptions = derived.subscriptions(spark, sf)
    got = matching.route_anomalies(anomalies, subscriptions, salts=3).groupBy("client_id").count()
    counts = {r["client_id"]: r["count"] for r in got.collect()}
    direct = {r["client_id"]: r["deliveries"] for r in matching.deliveries_per_client(anomalies, subscriptions).collect()}
    rows, subs = anomalies.collect(), subscriptions.collect()
    want = {s["client_id"]: sum(all(s[f] is None or s[f] == a[f] for f in matching.FILTERS) for a in rows) for s in subs}
    assert direct == want
    assert counts == {k: v for k, v in want.items() if v}


def test_facts_lie_by_date_and_repeated_batches_replace_themselves(spark, tmp_path):
    path, day = str(tmp_path / "facts"), dt.timedelta(days=1)
    rows = spark.createDataFrame([(1, T0), (2, T0 + day), (3, T0 + day)], "id long, timestamp timestamp")
    for _ in range(2):
        tables.append_by_date(rows, path, "timestamp", "b-1")
    tables.append_by_date(rows.filter("id = 2"), path, "timestamp", "b-2")
    assert sorted(r.id for r in tables.read_range(spark, path, "timestamp").collect()) == [1, 2, 2, 3]
    late = tables.read_range(spark, path, "timestamp", T0 + day, T0 + 2 * day)
    assert "PartitionFilters: [isnotnull(date" in late._jdf.queryExecution().executedPlan().toString() and late.count() == 3
    assert sorted(p.name for p in (tmp_path / "facts").iterdir() if p.is_dir()) == ["date=2025-01-06", "date=2025-01-07"]


def test_located_pages(spark):
    """Every page as by sorting all rows, whatever lies in one instant; plans of near and far pages differ in literals only."""
    import re

    rows = [(i, T0 + dt.timedelta(minutes=i * i % 9_000, seconds=i % 3)) for i in range(300)] + [(1_000 + i, T0) for i in range(150)] + [(5_000, None)]
    df = spark.createDataFrame(rows, "id long, detected_at timestamp")
    ordered = [i for _, i in sorted(((at, i) for i, at in rows if at), reverse=True)]
    for number, size, enough in ((1, 50, 10), (2, 50, 1_000), (5, 70, 10), (9, 50, 10), (10, 50, 10), (45, 10, 1)):
        got = filters.located_page(df, number, size, enough=enough).orderBy(F.desc("detected_at"), F.desc("id")).collect()
        assert [r.id for r in got] == ordered[(number - 1) * size:number * size]
    plans = [re.sub(r"#\d+L?|\d+", "", filters.located_page(df, n, 20, enough=50)._jdf.queryExecution().optimizedPlan().toString()) for n in (1, 12)]
    plans = [re.sub(r"-- ::\.?", "", p) for p in plans]
    assert plans[0] == plans[1] and "Offset" not in plans[0]
    at = dict(rows)[ordered[99]]
    assert [r.id for r in filters.page_after(df, at, ordered[99], 60).collect()] == ordered[100:160]
    assert filters.located_page(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        filters.located_page(df, 0)


def test_routes_broadcast_no_side(spark):
    """Each row becomes eight probes, which Spark takes for one; the stream's micro-batches were broadcast."""
    anomalies = spark.createDataFrame([(i, "A", f"S{i % 5}", "x") for i in range(50)], "id long, line string, station_id string, anomaly_type string")
    subs = spark.createDataFrame([("a", "A", None, None), ("b", None, "S1", None), ("c", None, None, None)], "client_id string, line string, station_id string, anomaly_type string")
    for totals in (None, [F.count("*").alias("clients")]):
        routes = matching.route_anomalies(anomalies, subs, totals=totals)
        assert len(routes.collect()) == 110
        assert "Broadcast" not in routes._jdf.queryExecution().executedPlan().toString()


def test_routes_by_sets_of_filters_equal_pairs(spark):
    """Clients with the same filters are routed together: null ids, repeated rows and clients, missing values, sums as over all pairs."""
    anomalies = spark.createDataFrame(
        [(1, "A", "S1", "view"), (1, "A", "S1", "view"), (2, None, "S1", "view"), (3, "B", None, None), (None, "A", None, "click")],
        "id long, line string, station_id string, anomaly_type string")
    subs = spark.createDataFrame(
        [("1", None, None, None), ("2", None, None, None), ("2", "A", None, None), ("3", "A", "S1", "view"), ("4", "Z", None, None),
         (None, "B", None, None), ("5", None, "S1", None), ("5", None, "S1", None)],
        "client_id string, line string, station_id string, anomaly_type string")
    pairs = matching.route_anomalies(anomalies, subs, salts=3)
    number = F.col("client_id").cast("bigint")
    routes = matching.route_anomalies(anomalies, subs, 3, [F.count("*").alias("clients"), F.sum(number).alias("client_sum")])
    assert routes.columns == [*anomalies.columns, *matching.SET, "clients", "client_sum"]
    assert routes.count() < pairs.count() == routes.agg(F.sum("clients")).first()[0]
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(routes.groupBy("id").agg(F.sum("clients").alias("n"), F.sum("client_sum").alias("s"))) == key(
        pairs.groupBy("id").agg(F.count("*").alias("n"), F.sum(number).alias("s")))
    sums = {"deliveries": F.count("*"), "ids": F.sum("id")}
    assert key(matching.sent_per_client(routes, subs, sums)) == key(
        pairs.groupBy("client_id").agg(*[v.alias(k) for k, v in sums.items()]))


def test_routes_do_not_grow_with_clients_times_anomalies(spark):
    """3,000 anomalies and 2,000 clients without filters: six million pairs, one row per anomaly."""
    anomalies = spark.range(3_000).selectExpr("id", "'A' as line", "'S1' as station_id", "'view' as anomaly_type")
    subs = spark.range(2_000).selectExpr("string(id) as client_id", "string(null) as line", "string(null) as station_id", "string(null) as anomaly_type")
    routes = matching.route_anomalies(anomalies, subs, totals=[F.count("*").alias("clients")])
    assert routes.count() == 3_000 and routes.agg(F.sum("clients")).first()[0] == 6_000_000
