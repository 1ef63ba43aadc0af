"""Streams over several micro-batches against the batch result."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from railtempo import schemas
from railtempo.operators import rules
from railtempo.operators.ensemble import combine_detections
from railtempo.operators.headway import with_headway_by_processing
from railtempo.plans.detection import DetectorSet
from railtempo.plans.reports import hourly_trend
from railtempo.sources import derived, feeds, tables
from railtempo.streaming import aggregates, jobs, late
from railtempo.streaming.headway import stream_headway


def _as_stream(spark, df, folder, files=4, ts="timestamp"):
    """Files in time order, one per micro-batch."""
    rows = df.orderBy(ts).withColumn("_n", F.ntile(files).over(__import__("pyspark").sql.Window.orderBy(ts, *[c for c in ("id",) if c in df.columns])))
    for i in range(1, files + 1):
        rows.filter(f"_n = {i}").drop("_n").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder)


def _drain(stream, name, mode="append", tmp=None):
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp)).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return query


@pytest.mark.parametrize("files", [1, 5])
def test_headway_stream_equals_batch(spark, tmp_path, files):
    shift = F.make_dt_interval(secs=(F.col("id") * 7919 % 3000).cast("decimal(18,6)"))
    df = derived.positions(spark, "/root/testdata/sf0.01").filter("id < 3000").select(
        "id", F.col("timestamp").cast("timestamp").alias("timestamp"), "current_station", "direction",
        F.when(F.col("id") % 53 != 0, F.col("timestamp") - shift).cast("timestamp").alias("arrival_time"))
    source = _as_stream(spark, df, str(tmp_path / "in"), files)
    _drain(stream_headway(source, watermark="1 day"), f"headway{files}", tmp=tmp_path / "cp")
    got = {r["id"]: r["headway_seconds"] for r in spark.table(f"headway{files}").collect()}
    want = {r["id"]: r["headway_seconds"] for r in with_headway_by_processing(df).collect()}
    assert got == want and any(v is not None for v in want.values())


def test_hourly_trend_stream(spark, tmp_path, sf):
    df = derived.anomalies(spark, sf).select("id", F.col("detected_at").cast("timestamp").alias("detected_at"), "severity")
    source = _as_stream(spark, df, str(tmp_path / "in"), ts="detected_at")
    _drain(aggregates.stream_hourly_trend(source, watermark="1 day"), "trend", "complete", tmp_path / "cp")
    key = lambda rows: sorted((r["hour"], r["n"], round(r["avg_severity"], 9)) for r in rows)
    assert key(spark.table("trend").collect()) == key(hourly_trend(df).collect())


def test_ensemble_stream(spark, tmp_path, sf):
    rows = derived.positions_with_dwell(spark, sf).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    found = rules.delay_rule(rows).unionByName(rules.delay_rule(rows, 400).withColumn("model_name", F.lit("strict_rule")))
    source = _as_stream(spark, found, str(tmp_path / "in"), ts="event_time")
    _drain(aggregates.stream_ensemble(source, "1 day"), "ensemble", "complete", tmp_path / "cp")
    columns = ["station_id", "line", "bucket", "severity", "detection_count", "distinct_models", "anomaly_type", "model_version"]
    key = lambda df: sorted(map(repr, df.select(*columns).collect()))
    assert key(spark.table("ensemble")) == key(combine_detections(found, model_order=["delay_rule", "strict_rule"]))


def test_routes_stream(spark, tmp_path, sf):
    df = derived.anomalies(spark, sf).select("id", "detected_at", "station_id", "line", "anomaly_type")
    subs = derived.subscriptions(spark, sf)
    source = _as_stream(spark, df, str(tmp_path / "in"), 2, ts="detected_at")
    _drain(jobs.stream_routes(source, subs), "routes", tmp=tmp_path / "cp")
    assert spark.table("routes").count() == jobs.stream_routes(df, subs).count() > 0


def test_scoring_stream(spark, tmp_path, sf):
    rows = derived.positions_with_dwell(spark, sf).withColumns({
        "timestamp": F.col("timestamp").cast("timestamp"), "headway_seconds": F.lit(None).cast("int")})
    source = _as_stream(spark, rows, str(tmp_path / "in"), 2)
    detectors = DetectorSet()
    detectors.register("delay_rule", rules.delay_rule)
    out, sent = str(tmp_path / "anomalies"), str(tmp_path / "sent")
    query = jobs.start_scoring(source, detectors, out, str(tmp_path / "cp"), derived.subscriptions(spark, sf), sent, once=True)
    query.awaitTermination(300)
    assert query.exception() is None
    stored = tables.read_anomalies(spark, out)
    assert stored.count() > 0 and stored.filter("resolved").count() == 0
    assert stored.select("id").distinct().count() == stored.count()
    delivered = spark.read.parquet(sent)
    assert delivered.count() > 0 and delivered.join(stored, "id", "left_anti").count() == 0


def _message(code, seconds, trips):
    return {"feed_code": code, "header": {"timestamp": seconds}, "entity": [
        {"id": t, "trip_update": {"trip": {"trip_id": t, "route_id": "A"}, "stop_time_update": [
            {"stop_id": stop, "arrival": {"time": at}, "departure": {"time": at + 30}}]}, "alert": None} for t, stop, at in trips]}


def test_ingest(spark, tmp_path):
    begin = 1736150400
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "1.json").write_text(json.dumps(_message("A", begin, [("t1", "S1", begin), ("t2", "S2", begin + 60)])))
    # the second poll repeats t1 and brings a train five minutes later
    (landing / "2.json").write_text(json.dumps(_message("A", begin + 30, [("t1", "S1", begin), ("t3", "S1", begin + 300)])))
    positions, stations, log = (str(tmp_path / n) for n in ("positions", "stations", "log"))
    tables.replace_table(spark.createDataFrame([("S1", "one", 1.0, 2.0, ["C"], None)], schemas.STATION), stations)
    query = jobs.start_ingest(feeds.stream_messages(spark, str(landing), 1), positions, stations, str(tmp_path / "cp"), once=True,
                              dedupe="30 minutes")
    query.awaitTermination(300)
    assert query.exception() is None
    rows = {(r["trip_id"], r["current_station"]): r for r in tables.read_range(spark, positions, "timestamp").collect()}
    assert set(rows) == {("t1", "S1"), ("t2", "S2"), ("t3", "S1")}
    assert rows["t3", "S1"]["headway_seconds"] == 300 and rows["t1", "S1"]["headway_seconds"] is None
    assert rows["t1", "S1"]["dwell_time_seconds"] == 30 and rows["t1", "S1"]["line"] == "A"
    known = {r["id"]: r["lines"] for r in tables.read_table(spark, stations).collect()}
    assert known == {"S1": ["A", "C"], "S2": ["A"]}
    query = jobs.start_feed_log(feeds.stream_messages(spark, str(landing)), log, str(tmp_path / "cp2"), once=True)
    query.awaitTermination(300)
    assert query.exception() is None
    stored = jobs.read_feed_log(spark, log)
    assert stored.count() == 2 and stored.filter("processing_time_ms > 0 and num_trips = 2").count() == 2


def test_scoring_stream_with_history_equals_batch(spark, tmp_path, sf):
    from railtempo.plans.detection import with_features

    rows = derived.positions_with_dwell(spark, sf).withColumns({
        "timestamp": F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 20), "headway_seconds": F.lit(None).cast("int")})
    history = str(tmp_path / "positions")
    tables.append_positions(rows, history)
    detectors = DetectorSet()
    detectors.register("zscore", lambda df: rules.zscore_rule(df, limit=1.0))
    out = str(tmp_path / "anomalies")
    query = jobs.start_scoring(_as_stream(spark, rows, str(tmp_path / "in"), 3), detectors, out, str(tmp_path / "cp"), once=True, history_path=history)
    query.awaitTermination(300)
    assert query.exception() is None
    key = lambda df: sorted((r["source_position_id"], round(r["severity"], 9)) for r in df.filter("source_position_id is not null").collect())
    whole = rules.zscore_rule(with_features(rows, percentiles=False), limit=1.0)
    got = key(tables.read_anomalies(spark, out))
    assert len(got) > 100 and set(got) <= set(key(whole))


def test_late_rows_are_parted(spark, tmp_path):
    """On-time and late rows together are the input; a repeated micro-batch changes nothing; closed hours lose no row on time."""
    minutes = [[(1, 0), (2, 100), (3, None)], [(4, 69), (5, 70), (6, 130), (7, 20)], [], [(8, 99), (9, 100), (9, 100), (10, 400)]]
    schema = "id long, at timestamp, severity double"
    source = tmp_path / "in"

    def add(n):
        rows = [(i, None if m is None else dt.datetime(2024, 3, 5, 7) + dt.timedelta(minutes=m), 0.5) for i, m in minutes[n]]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        late.start_split(stream, str(tmp_path / "out"), str(tmp_path / "state"), "at", once=True).awaitTermination()

    def result():
        sides = (late.late_rows(spark, str(tmp_path / "out"), schema), spark.read.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "out/on_time")))
        counts = late.split_counts(spark, str(tmp_path / "out")).orderBy("batch_id").collect()
        return [sorted(r.id for r in side.collect()) for side in sides], [tuple(c)[1:] for c in counts]

    for n in range(len(minutes)):
        add(n)
        run()
    wanted = ([[3, 4, 7, 8], [1, 2, 5, 6, 9, 9, 10]], [(2, 1), (2, 2), (0, 0), (3, 1)])
    assert (*result(),) == wanted
    last = max(int(f.name) for f in (tmp_path / "state/commits").iterdir() if f.name.isdigit())
    for name in (str(last), f".{last}.crc"):  # as if the stream had died before it could note the end of its last batch
        (tmp_path / "state/commits" / name).unlink()
    run()
    assert (*result(),) == wanted
    rows = late.on_time(spark, str(tmp_path / "out"), schema)
    query = aggregates.stream_hourly_trend(rows, "at").writeStream.format("parquet").option("path", str(tmp_path / "hours")).option(
        "checkpointLocation", str(tmp_path / "hours-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(r.n for r in spark.read.parquet(str(tmp_path / "hours")).collect()) == 6  # all on time but row 10, whose hour is open
