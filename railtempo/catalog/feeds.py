"""Feed flattening, station tables, model registry, JSON text."""

from __future__ import annotations

from pyspark.sql import functions as F

from railtempo.catalog.base import ANOMALIES, ARTIFACTS, POSITIONS, STATIONS, STOPS, query, r6, sql_stamp, stamp
from railtempo.operators import matching, upsert
from railtempo.sources import derived, feeds, tables


@query("flatten_trips", f"""with {STOPS} select feed_code, {sql_stamp('make_timestamp(message_time * 1000000)')} as message_time, trip_id, route_id, direction,
    stop_id, {sql_stamp('make_timestamp(arrival * 1000000)')} as arrival, {sql_stamp('make_timestamp(departure * 1000000)')} as departure, delay from stops""")
def _(spark, sf):
    return feeds.flatten_trips(derived.feed_messages(spark, sf)).select(
        "feed_code", stamp("timestamp").alias("message_time"), "trip_id", "route_id", "direction", "stop_id",
        stamp("arrival_time").alias("arrival"), stamp("departure_time").alias("departure"), "delay")


@query("alerts", f"with {STOPS} select alert_id, header from alerts")
def _(spark, sf):
    return feeds.extract_alerts(derived.feed_messages(spark, sf)).select("alert_id", "header")


@query("feed_log", f"""with {STOPS}, t as (select k, count(*) as n from stops group by k), a as (select k, count(*) as n from alerts group by k)
    select base.k as message_id, coalesce(t.n, 0) as num_trips, coalesce(a.n, 0) as num_alerts
    from base left join t using (k) left join a using (k)""")
def _(spark, sf):
    return feeds.feed_log(derived.feed_messages(spark, sf), keep=("message_id",)).select("message_id", "num_trips", "num_alerts")


@query("feed_log_totals", f"""with {STOPS}, m as (select ['1','A','B','G','J','L','N','SI'][cast(k % 8 as int) + 1] as feed_id, count(*) as messages from base group by 1),
    t as (select feed_code as feed_id, count(*) as n from stops group by 1),
    a as (select ['1','A','B','G','J','L','N','SI'][cast(k % 8 as int) + 1] as feed_id, count(*) as n from alerts group by 1)
    select feed_id, messages, coalesce(t.n, 0) as num_trips, coalesce(a.n, 0) as num_alerts from m left join t using (feed_id) left join a using (feed_id)""")
def _(spark, sf):
    return feeds.feed_log(derived.feed_messages(spark, sf)).groupBy("feed_id").agg(
        F.count("*").alias("messages"), F.sum("num_trips").alias("num_trips"), F.sum("num_alerts").alias("num_alerts"))


@query("recent_feed_updates", f"""with {STOPS}, t as (select k, count(*) as n from stops group by k)
    select ['1','A','B','G','J','L','N','SI'][cast(k % 8 as int) + 1] as feed_id, {sql_stamp('make_timestamp((d + k % 86400) * 1000000)')} as at, coalesce(n, 0) as num_trips
    from base left join t using (k) order by d + k % 86400 desc, feed_id desc limit 20""")
def _(spark, sf):
    return feeds.feed_log(derived.feed_messages(spark, sf)).orderBy(F.desc("timestamp"), F.desc("feed_id")).limit(20).select(
        "feed_id", stamp("timestamp").alias("at"), "num_trips")


@query("ingest_status", f"""with {STOPS}, {STATIONS} select ['1','A','B','G','J','L','N','SI'][cast(k % 8 as int) + 1] as feed_id,
    {sql_stamp('make_timestamp((d + k % 86400) * 1000000)')} as at, 8 as active_feeds, 30 as update_interval, (select count(*) from stations) as loaded_stations
    from base order by d + k % 86400 desc, feed_id desc limit 20""")
def _(spark, sf):
    return feeds.ingest_status(feeds.feed_log(derived.feed_messages(spark, sf)), derived.stations(spark, sf)).select(
        "feed_id", stamp("timestamp").alias("at"), "active_feeds", "update_interval", "loaded_stations")


_SEEN = """seen as (select distinct current_station as id, upper(route_id) as route from positions where current_station is not null),
    old as (select id, name, lat, lon, ['B','Q'] as lines from stations),
    lines as (select id, list(route order by route) as routes from seen group by id)"""


def _two_lines(spark, sf):
    return derived.stations(spark, sf).withColumn("lines", F.array(F.lit("B"), F.lit("Q")))


@query("station_upsert", f"""with {POSITIONS}, {STATIONS}, {_SEEN},
    pairs as (select id, unnest(lines) as line from old union select id, route from seen)
    select id, coalesce(any_value(old.name), 'Station ' || id) as name, round(coalesce(any_value(old.lat), 40.7484), 6) as lat,
    round(coalesce(any_value(old.lon), -73.9857), 6) as lon, string_agg(line, ',' order by line) as lines
    from pairs left join old using (id) group by id""")
def _(spark, sf):
    out = upsert.upsert_stations(_two_lines(spark, sf), derived.positions(spark, sf))
    return out.select("id", "name", r6("lat").alias("lat"), r6("lon").alias("lon"), F.array_join("lines", ",").alias("lines"))


@query("station_upsert_concat", f"""with {POSITIONS}, {STATIONS}, {_SEEN}
    select coalesce(old.id, lines.id) as id, array_to_string(list_concat(coalesce(old.lines, []), coalesce(routes, [])), ',') as lines
    from old full join lines on old.id = lines.id""")
def _(spark, sf):
    out = upsert.upsert_stations(_two_lines(spark, sf), derived.positions(spark, sf), keep_duplicates=True)
    return out.select("id", F.array_join("lines", ",").alias("lines"))


@query("lines_per_station", f"""with {POSITIONS}, {STATIONS}, {_SEEN} select id, array_to_string(routes, ',') as lines from lines""")
def _(spark, sf):
    return upsert.lines_per_station(derived.positions(spark, sf)).select("id", F.array_join("lines", ",").alias("lines"))


@query("distinct_stations", f"""with {POSITIONS} select distinct s as id from (select current_station as s from positions
    union all select case when id % 11 = 0 then 'S9' end from positions) where s is not null""")
def _(spark, sf):
    df = derived.positions(spark, sf).withColumn("next_station", F.when(F.col("id") % 11 == 0, F.lit("S9")))
    return upsert.stations_seen(df)


@query("station_lines_exploded", f"""with {POSITIONS}, w as (select *, case when id % 11 = 0 then 'S9' end as next_station from positions)
    select id, string_agg(distinct route, ',' order by route) as lines from (
      select current_station as id, upper(route_id) as route from w union all select next_station, upper(route_id) from w)
    where id is not null group by id""")
def _(spark, sf):
    df = derived.positions(spark, sf).withColumn("next_station", F.when(F.col("id") % 11 == 0, F.lit("S9")))
    return upsert.lines_per_station(df).select("id", F.array_join("lines", ",").alias("lines"))


@query("resolve", f"""with {ANOMALIES} select id, resolved or id % 10 = 1 as resolved,
    case when id % 10 = 1 then {sql_stamp("detected_at + interval '1 hour'")} end as resolved_at from anomalies""")
def _(spark, sf):
    df = derived.anomalies(spark, sf)
    log = df.filter("id % 10 = 1").select("id", (F.col("detected_at") + F.expr("interval 1 hour")).alias("resolved_at"))
    return upsert.apply_resolutions(df, log).select("id", "resolved", stamp("resolved_at").alias("resolved_at"))


@query("registry_active", f"""with {ARTIFACTS}, newest as (select model_type, max(id) as m from artifacts group by model_type)
    select id, model_type, version, id = m as is_active from artifacts join newest using (model_type)""")
def _(spark, sf):
    return upsert.activate_latest(derived.model_artifacts(spark, sf)).select("id", "model_type", "version", "is_active")


@query("registry_activate_version", f"""with {ARTIFACTS} select id, model_type,
    case when model_type = 'ECONOMY' then version = '0' else is_active end as is_active from artifacts""")
def _(spark, sf):
    chosen = spark.createDataFrame([("ECONOMY", "0")], "model_type string, version string")
    return upsert.activate(derived.model_artifacts(spark, sf), chosen).select("id", "model_type", "is_active")


@query("registry_status", f"""with {ARTIFACTS} select id, model_type, version, round(score_mean, 6) as score_mean, model_type in ('ECONOMY', 'SMALL') as is_loaded
    from artifacts where is_active""")
def _(spark, sf):
    loaded = spark.createDataFrame([("ECONOMY",), ("SMALL",)], "model_type string")
    return upsert.model_status(derived.model_artifacts(spark, sf), loaded).select(
        "id", "model_type", "version", r6(F.col("metrics")["score_mean"]).alias("score_mean"), "is_loaded")


@query("json_safe", """select '{"order":' || o_orderkey || ',"day":"' || strftime(o_orderdate, '%Y-%m-%d') || '","at":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')
    || '","priority":"' || o_orderpriority || '","none":null}' as json from orders""")
def _(spark, sf):
    rows = derived.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order"), F.to_date("o_orderdate").alias("day"), F.col("o_orderdate").alias("at"),
        F.col("o_orderpriority").alias("priority"), F.lit(None).cast("int").alias("none"))
    return tables.json_safe(rows)


@query("station_join_default", f"""with {POSITIONS}, {STATIONS} select p.id, coalesce(s.name, 'Station ' || p.current_station) as station_name,
    round(coalesce(s.lat, 40.7484), 6) as lat, round(coalesce(s.lon, -73.9857), 6) as lon
    from positions p left join stations s on p.current_station = s.id""")
def _(spark, sf):
    return matching.with_station_defaults(derived.positions(spark, sf), derived.stations(spark, sf)).select(
        "id", "station_name", r6("lat").alias("lat"), r6("lon").alias("lon"))


@query("anomaly_station", f"""with {ANOMALIES}, {STATIONS} select a.id, s.name as station_name from anomalies a left join stations s on a.station_id = s.id""")
def _(spark, sf):
    return matching.with_station(derived.anomalies(spark, sf), derived.stations(spark, sf)).select("id", "station_name")
