"""Filters, pages, dashboard aggregates, subscriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from railtempo.catalog.base import ANOMALIES, HEADWAYS, POSITIONS, STATIONS, SUBSCRIPTIONS, query, r6, sql_stamp, stamp
from railtempo.catalog.features import moving
from railtempo.operators import filters, matching
from railtempo.plans import reports
from railtempo.sources import derived

_LAST = "(select max(detected_at) from anomalies)"
_DAY = f"detected_at >= {_LAST} - interval '24 hours'"


@query("anomaly_filters", f"""with {ANOMALIES} select id from anomalies where line = 'C' and station_id = 'S1' and not resolved
    and detected_at >= timestamp '2024-01-05 00:00:00' and detected_at <= timestamp '2024-01-25 12:00:00'""")
def _(spark, sf):
    return filters.anomaly_filter(
        derived.anomalies(spark, sf), line="C", station_id="S1", resolved=False,
        start=F.lit("2024-01-05 00:00:00"), end=F.lit("2024-01-25 12:00:00")).select("id")


@query("anomaly_by_id", f"with {ANOMALIES} select id, anomaly_type, round(severity, 6) as severity from anomalies where id = 77")
def _(spark, sf):
    return filters.by_id(derived.anomalies(spark, sf), 77).select("id", "anomaly_type", r6("severity").alias("severity"))


@query("positions_since", f"with {POSITIONS} select id from positions where timestamp >= timestamp '2024-01-10 06:00:00' and line = 'Q' order by timestamp, id")
def _(spark, sf):
    return filters.time_ordered(filters.since(derived.positions(spark, sf), F.lit("2024-01-10 06:00:00"), "Q")).select("id")


@query("training_range", f"""with {HEADWAYS} select id, headway_seconds from moving where headway_seconds is not null
    and timestamp between timestamp '2024-01-03 00:00:00' and timestamp '2024-01-20 00:00:00'""")
def _(spark, sf):
    return filters.training_range(moving(spark, sf), F.lit("2024-01-03 00:00:00"), F.lit("2024-01-20 00:00:00")).select("id", "headway_seconds")


@query("default_range", f"with {ANOMALIES} select id from anomalies where {_DAY}")
def _(spark, sf):
    return filters.last_hours(derived.anomalies(spark, sf), 24, "detected_at").select("id")


@query("lookback", f"with {POSITIONS} select id from positions where timestamp >= (select max(timestamp) from positions) - interval '60 minutes'")
def _(spark, sf):
    return filters.lookback(derived.positions(spark, sf), 60).select("id")


@query("time_presets", " union all ".join(
    f"select '{name}' as preset, count(*) as n from (with {ANOMALIES} select * from anomalies where detected_at >= {_LAST} - interval '{hours} hours')"
    for name, hours in filters.PRESETS.items()))
def _(spark, sf):
    df = derived.anomalies(spark, sf)
    return filters.preset_counts(df)


@query("row_violations", """with raw as (select event_id as id, value - 120 as lat, value * 2 - 200 as lon, cast(user_id % 4 as int) - 1 as direction,
      value / 100 - 0.2 as severity, case when event_id % 13 <> 0 then event_type end as anomaly_type from events)
    select id, concat_ws(',', case when lat not between -90 and 90 then 'lat' end, case when lon not between -180 and 180 then 'lon' end,
      case when direction not between 0 and 1 then 'direction' end, case when severity not between 0 and 1 then 'severity' end,
      case when anomaly_type is null then 'type_required' end) as violations from raw""")
def _(spark, sf):
    raw = derived.table(spark, sf, "events").select(
        F.col("event_id").alias("id"), (F.col("value") - 120).alias("lat"), (F.col("value") * 2 - 200).alias("lon"),
        ((F.col("user_id") % 4).cast("int") - 1).alias("direction"), (F.col("value") / 100 - 0.2).alias("severity"),
        F.when(F.col("event_id") % 13 != 0, F.col("event_type")).alias("anomaly_type"))
    return filters.with_violations(raw).select("id", F.array_join("violations", ",").alias("violations"))


@query("recent_positions_of_line", f"with {POSITIONS} select id, {sql_stamp('timestamp')} as at from positions where line = 'A' order by timestamp desc, id desc limit 50")
def _(spark, sf):
    return filters.newest_of_line(derived.positions(spark, sf), "a").select("id", stamp("timestamp").alias("at"))


@query("recent_by_line", f"""with {POSITIONS} select line, id, line_rank from (select line, id,
    row_number() over (partition by line order by timestamp desc, id desc) as line_rank from positions) where line_rank <= 50""")
def _(spark, sf):
    return filters.newest_per_line(derived.positions(spark, sf)).select("line", "id", "line_rank")


@query("anomaly_page", f"with {ANOMALIES} select id, {sql_stamp('detected_at')} as at from anomalies order by detected_at desc, id desc limit 50 offset 100")
def _(spark, sf):
    return filters.located_page(derived.anomalies(spark, sf), 3, 50).select("id", stamp("detected_at").alias("at"))


@query("anomaly_deep_page", f"with {ANOMALIES} select id, {sql_stamp('detected_at')} as at from anomalies order by detected_at desc, id desc limit 40 offset 680")
def _(spark, sf):
    """A page far back, found by counts."""
    return filters.located_page(derived.anomalies(spark, sf), 18, 40, enough=100).select("id", stamp("detected_at").alias("at"))


@query("anomaly_next_page", f"with {ANOMALIES} select id, {sql_stamp('detected_at')} as at from anomalies order by detected_at desc, id desc limit 40 offset 720")
def _(spark, sf):
    """The page after that one, from its last row alone."""
    rows = derived.anomalies(spark, sf)
    last = filters.located_page(rows, 18, 40).agg(F.min(F.struct(F.unix_micros(F.col("detected_at").cast("timestamp")).alias("at"), "id")).alias("l")).first()["l"]
    return filters.page_after(rows, F.timestamp_micros(F.lit(last["at"])), last["id"], 40).select("id", stamp("detected_at").alias("at"))


@query("page_total", f"with {ANOMALIES} select count(*) as total from anomalies where {_DAY} and not resolved")
def _(spark, sf):
    df = filters.anomaly_filter(filters.last_hours(derived.anomalies(spark, sf), 24, "detected_at"), resolved=False)
    return reports.page_total(df)


@query("total_today", f"with {ANOMALIES} select count(*) as total_today from anomalies where detected_at >= date_trunc('day', {_LAST})")
def _(spark, sf):
    return reports.count_today(derived.anomalies(spark, sf))


@query("total_active", f"with {ANOMALIES} select count(*) as total_active from anomalies where not resolved")
def _(spark, sf):
    return reports.count_active(derived.anomalies(spark, sf))


@query("count_by_type", f"with {ANOMALIES} select anomaly_type, count(*) as n from anomalies where {_DAY} group by 1")
def _(spark, sf):
    return reports.count_by_type(reports.in_range(derived.anomalies(spark, sf)))


@query("count_by_line", f"with {ANOMALIES} select line, count(*) as n from anomalies where {_DAY} and line is not null group by 1")
def _(spark, sf):
    return reports.count_by_line(reports.in_range(derived.anomalies(spark, sf)))


_BAND = "case when severity < 0.33 then 'low' when severity < 0.67 then 'medium' else 'high' end"


@query("severity_histogram", f"""with {ANOMALIES} select b.band, count(a.id) as n from (values ('low'), ('medium'), ('high')) as b(band)
    left join (select id, {_BAND} as band from anomalies where {_DAY}) a using (band) group by 1""")
def _(spark, sf):
    return reports.severity_histogram(reports.in_range(derived.anomalies(spark, sf)))


@query("hourly_trend", f"""with {ANOMALIES} select {sql_stamp("date_trunc('hour', detected_at)")} as hour, count(*) as n, round(coalesce(avg(severity), 0), 10) as avg_severity
    from anomalies where detected_at >= {_LAST} - interval '168 hours' group by 1""")
def _(spark, sf):
    return reports.hourly_trend(reports.in_range(derived.anomalies(spark, sf), 168)).select(
        stamp("hour").alias("hour"), "n", F.round("avg_severity", 10).alias("avg_severity"))


@query("ordered_trend", f"""with {ANOMALIES} select {sql_stamp("date_trunc('hour', detected_at)")} as hour, count(*) as n from anomalies group by 1 order by 1""")
def _(spark, sf):
    return reports.hourly_trend(derived.anomalies(spark, sf)).orderBy("hour").select(stamp("hour").alias("hour"), "n")


@query("summary_sets", f"""with {ANOMALIES}, d as (select *, {_BAND} as band from anomalies where {_DAY}) select section, label, n, avg_severity from (
      select 'total_today' as section, '' as label, count(*) as n, cast(null as double) as avg_severity from anomalies where detected_at >= date_trunc('day', {_LAST})
      union all select 'total_active', '', count(*), null from anomalies where not resolved
      union all select 'by_type', anomaly_type, count(*), null from d group by 2
      union all select 'by_line', line, count(*), null from d where line is not null group by 2
      union all select 'severity', b.band, count(d.id), null from (values ('low'), ('medium'), ('high')) as b(band) left join d using (band) group by 2
      union all select 'trend', strftime(date_trunc('hour', detected_at), '%Y-%m-%d %H'), count(*), round(avg(severity), 10) from d group by 2)""")
def _(spark, sf):
    out = reports.dashboard_summary(derived.anomalies(spark, sf))
    return out.select("section", "label", "n", F.round("avg_severity", 10).alias("avg_severity"))


_MARKERS = """markers as (select station_id, count(*) as n, max(severity) as top from anomalies where station_id is not null group by 1)"""
_COLOUR = "case when {0} > 0.7 then 'red' when {0} > 0.4 then 'amber' else 'yellow' end"


@query("station_rollup", f"with {ANOMALIES}, {_MARKERS} select station_id, n, round(top, 6) as max_severity, {_COLOUR.format('top')} as band, round(20 + top * 20, 6) as size from markers")
def _(spark, sf):
    return reports.station_rollup(derived.anomalies(spark, sf)).select(
        "station_id", "n", r6("max_severity").alias("max_severity"), "band", r6("size").alias("size"))


@query("station_details", f"""with {ANOMALIES} select station_id, anomaly_type, cast(round(cast(severity * 100 as decimal(18,6)), 0) as varchar) || '%' as shown, {_COLOUR.format('severity')} as band,
    count(*) as n from anomalies where station_id is not null group by 1, 2, 3, 4""")
def _(spark, sf):
    return reports.station_details(derived.anomalies(spark, sf))


@query("map_markers", f"""with {ANOMALIES}, {STATIONS}, {_MARKERS} select station_id, n, round(coalesce(lat, 40.7484), 6) as lat, round(coalesce(lon, -73.9857), 6) as lon
    from markers left join stations on station_id = id""")
def _(spark, sf):
    return reports.map_markers(derived.anomalies(spark, sf), derived.stations(spark, sf)).select(
        "station_id", "n", r6("lat").alias("lat"), r6("lon").alias("lon"))


@query("axis_top", f"with {ANOMALIES} select round(coalesce(nullif(max(severity), 0), 1), 6) as top from anomalies where {_DAY}")
def _(spark, sf):
    return reports.axis_top(reports.in_range(derived.anomalies(spark, sf))).select(r6("top").alias("top"))


_MATCH = """(s.line is null or s.line = a.line) and (s.station_id is null or s.station_id = a.station_id)
    and (s.anomaly_type is null or s.anomaly_type = a.anomaly_type)"""
_CELLS = "cells as (select line, station_id, anomaly_type, count(*) as n, max(severity) as top from anomalies group by 1, 2, 3)"


@query("subscription_match", f"""with {ANOMALIES}, {SUBSCRIPTIONS}, {_CELLS} select s.client_id, cast(coalesce(sum(a.n), 0) as bigint) as deliveries, round(max(a.top), 6) as max_severity
    from subscriptions s left join cells a on {_MATCH} group by 1""")
def _(spark, sf):
    out = matching.deliveries_per_client(derived.anomalies(spark, sf), derived.subscriptions(spark, sf))
    return out.select("client_id", "deliveries", r6("max_severity").alias("max_severity"))


@query("anomaly_recipients", f"""with {ANOMALIES}, {SUBSCRIPTIONS}, {_CELLS}, r as (select a.line, a.station_id, a.anomaly_type, count(s.client_id) as recipients
      from cells a left join subscriptions s on {_MATCH} group by 1, 2, 3)
    select a.id, r.recipients from anomalies a join r on a.line = r.line and a.station_id is not distinct from r.station_id and a.anomaly_type = r.anomaly_type""")
def _(spark, sf):
    return matching.recipients_per_anomaly(derived.anomalies(spark, sf), derived.subscriptions(spark, sf)).select("id", "recipients")


@query("subscription_routes", f"""with {ANOMALIES}, {SUBSCRIPTIONS}
    select a.id, count(*) as clients, cast(sum(cast(s.client_id as bigint)) as bigint) as client_sum from anomalies a join subscriptions s on {_MATCH} group by 1""")
def _(spark, sf):
    """Every subscription, those without filters too, summed per anomaly; clients with the same filters are routed together."""
    subs = derived.subscriptions(spark, sf)
    totals = [F.count("*").alias("clients"), F.sum(F.col("client_id").cast("bigint")).alias("client_sum")]
    routes = matching.route_anomalies(derived.anomalies(spark, sf).select("id", *matching.FILTERS), subs, totals=totals)
    return routes.groupBy("id").agg(F.sum("clients").alias("clients"), F.sum("client_sum").alias("client_sum"))


@query("subscription_routes_all", f"""with {ANOMALIES}, {SUBSCRIPTIONS}
    select s.client_id, count(*) as deliveries, cast(sum(a.id) as bigint) as ids from anomalies a join subscriptions s on {_MATCH} group by 1""")
def _(spark, sf):
    """Every subscription, those without filters too, summed per client; clients with the same filters are routed together."""
    subs = derived.subscriptions(spark, sf)
    routes = matching.route_anomalies(derived.anomalies(spark, sf).select("id", *matching.FILTERS), subs, totals=[F.count("*").alias("clients")])
    return matching.sent_per_client(routes, subs, {"deliveries": F.count("*"), "ids": F.sum("id")})
