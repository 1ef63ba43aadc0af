"""Scalar functions, headway, rolling frames, ranks, splits, sequences."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from railtempo.catalog.base import ANOMALIES, CALENDAR, HEADWAYS, POSITIONS, query, r6, sql_stamp, stamp
from railtempo.functions import scalar as fx
from railtempo.functions.features import scoring_projection, with_calendar, with_station_slots, zero_filled
from railtempo.operators import ranks, rolling, scaling
from railtempo.operators.headway import with_headway, with_headway_by_processing
from railtempo.operators.sequences import sliding_sequences
from railtempo.schemas import METRIC_COLUMNS
from railtempo.sources import derived


def moving(spark, sf):
    """Positions with dwell and headway."""
    return with_headway(derived.positions_with_dwell(spark, sf))


@query("line_mapping", f"with {POSITIONS} select id, route_id, line from positions")
def _(spark, sf):
    return derived.positions(spark, sf).select("id", "route_id", fx.line_of_route("route_id").alias("line"))


@query("dwell", f"with {POSITIONS} select id, dwell_time_seconds from dwelled")
def _(spark, sf):
    return derived.positions(spark, sf).select("id", fx.dwell_seconds("arrival_time", "departure_time").alias("dwell_time_seconds"))


@query("delay_mapping", f"with {POSITIONS} select id, coalesce(case when id % 7 <> 0 then delay_seconds end, 0) as delay_seconds from positions")
def _(spark, sf):
    reported = F.when(F.col("id") % 7 != 0, F.col("delay_seconds"))
    return derived.positions(spark, sf).select("id", fx.delay_or_zero(reported).alias("delay_seconds"))


@query("temporal_features", f"with {POSITIONS}, {CALENDAR.format(source='positions')} select id, hour, day_of_week, is_weekend, is_rush_hour, minutes_since_midnight from calendar")
def _(spark, sf):
    return with_calendar(derived.positions(spark, sf)).select(
        "id", "hour", "day_of_week", "is_weekend", "is_rush_hour", "minutes_since_midnight")


@query("delay_clamp", f"with {POSITIONS} select id, greatest(-1800, least(1800, delay_seconds)) as delay_seconds from positions")
def _(spark, sf):
    return derived.positions(spark, sf).select("id", fx.clamp_delay("delay_seconds").alias("delay_seconds"))


@query("epoch_to_timestamp", f"select o_orderkey, {sql_stamp('make_timestamp((cast(epoch(o_orderdate) as bigint) + o_orderkey) * 1000000)')} as at from orders")
def _(spark, sf):
    seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey")
    return derived.table(spark, sf, "orders").select("o_orderkey", stamp(fx.from_epoch(seconds)).alias("at"))


@query("severity_bands", f"""with {ANOMALIES} select id,
    case when severity < 0.33 then 'low' when severity < 0.67 then 'medium' else 'high' end as band,
    case when severity > 0.7 then 'red' when severity > 0.4 then 'amber' else 'yellow' end as marker,
    round(20 + severity * 20, 6) as size from anomalies""")
def _(spark, sf):
    return derived.anomalies(spark, sf).select(
        "id", fx.severity_class("severity").alias("band"), fx.marker_band("severity").alias("marker"),
        r6(fx.marker_size("severity")).alias("size"))


@query("time_buckets", f"""with {ANOMALIES} select id,
    {sql_stamp("time_bucket(interval '5 minutes', detected_at)")} as five_minutes,
    {sql_stamp("date_trunc('hour', detected_at)")} as hour, {sql_stamp("date_trunc('day', detected_at)")} as day from anomalies""")
def _(spark, sf):
    return derived.anomalies(spark, sf).select(
        "id", stamp(fx.five_minute_floor("detected_at")).alias("five_minutes"),
        stamp(fx.hour_floor("detected_at")).alias("hour"), stamp(fx.day_floor("detected_at")).alias("day"))


@query("feature_map", f"""with {POSITIONS} select id,
    cast((dwell_time_seconds is not null) as int) + 1 as entries, dwell_time_seconds as dwell, delay_seconds as delay from dwelled""")
def _(spark, sf):
    m = fx.non_null_map(["dwell_time_seconds", "delay_seconds"])
    return derived.positions_with_dwell(spark, sf).select("id", m.alias("m")).select(
        "id", F.size("m").alias("entries"),
        F.try_element_at("m", F.lit("dwell_time_seconds")).cast("int").alias("dwell"),
        F.try_element_at("m", F.lit("delay_seconds")).cast("int").alias("delay"))


@query("line_group", f"""with {POSITIONS} select id, line, case when upper(line) in ('1','2','3','4','5','6') then '123456'
    when line = '7' then '7' when upper(line) in ('A','C','E') then 'ace' when upper(line) in ('B','D','F','M') then 'bdfm'
    when upper(line) = 'G' then 'g' when upper(line) in ('J','Z') then 'jz' when upper(line) = 'L' then 'l'
    when upper(line) in ('N','Q','R','W') then 'nqrw' when upper(line) = 'S' then 's' end as line_group from positions""")
def _(spark, sf):
    return derived.positions(spark, sf).select("id", "line", fx.line_group("line").alias("line_group"))


@query("display_text", f"""with {ANOMALIES} select id, cast(round(cast(severity * 100 as decimal(18,6)), 0) as varchar) || '%' as percent,
    cast(round(cast(severity * 100 as decimal(18,6)), 1) as varchar) || '%' as percent_1, strftime(detected_at, '%H:%M:%S') as clock,
    strftime(detected_at, '%Y-%m-%dT%H:%M:%S.%f') as iso from anomalies""")
def _(spark, sf):
    return derived.anomalies(spark, sf).select(
        "id", fx.percent_text("severity").alias("percent"), fx.percent_text("severity", 1).alias("percent_1"),
        fx.clock_text("detected_at").alias("clock"), fx.iso_text("detected_at").alias("iso"))


@query("line_request", f"with {POSITIONS} select id, line from positions where upper(line) = upper('6x')")
def _(spark, sf):
    return derived.positions(spark, sf).filter(fx.same_line("line", F.lit("6x"))).select("id", "line")


@query("station_one_hot", f"""with {POSITIONS} select id, cast(cast('0x' || md5(current_station)[1:8] as bigint) % 472 as int) as station_slot,
    case when current_station is null then 0e0 else 1e0 end as total, case when current_station is not null then 1e0 end as at_slot from positions""")
def _(spark, sf):
    encoded = with_station_slots(derived.positions(spark, sf)).withColumn("v", vector_to_array("station_vector"))
    return encoded.select(
        "id", "station_slot", F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("total"), F.get("v", F.col("station_slot")).alias("at_slot"))


@query("scoring_projection", f"""with {HEADWAYS} select id, {sql_stamp('timestamp')} as at, trip_id, route_id, line, current_station,
    headway_seconds, dwell_time_seconds, delay_seconds, direction from moving""")
def _(spark, sf):
    return scoring_projection(moving(spark, sf)).withColumn("at", stamp("timestamp")).drop("timestamp")


@query("null_fill", f"""with {HEADWAYS} select id, coalesce(headway_seconds, 0) as headway_seconds,
    coalesce(dwell_time_seconds, 0) as dwell_time_seconds, coalesce(delay_seconds, 0) as delay_seconds from moving""")
def _(spark, sf):
    return zero_filled(moving(spark, sf), METRIC_COLUMNS).select("id", *METRIC_COLUMNS)


@query("headway", f"with {HEADWAYS} select id, current_station, direction, headway_seconds from moving")
def _(spark, sf):
    return moving(spark, sf).select("id", "current_station", "direction", "headway_seconds")


@query("headway_by_processing", f"""with {POSITIONS},
    late as (select id, current_station, direction, timestamp,
      case when id % 53 <> 0 then timestamp - to_seconds((id * 7919) % 3000) end as arrival_time from positions),
    pairs as (select a.id, b.timestamp as seen, b.id as other, epoch_us(a.arrival_time) - epoch_us(b.arrival_time) as gap
      from late a join late b on a.current_station is not distinct from b.current_station and a.direction = b.direction
        and b.timestamp > a.timestamp - interval '30 minutes' and (b.timestamp, b.id) < (a.timestamp, a.id)
      where epoch_us(a.arrival_time) - epoch_us(b.arrival_time) < 1800000000),
    newest as (select id, arg_max(gap, (seen, other)) as gap from pairs group by id)
    select late.id, cast(trunc(gap / 1000000.0) as bigint) as headway_seconds from late left join newest using (id)""")
def _(spark, sf):
    shift = F.make_dt_interval(secs=(F.col("id") * 7919 % 3000).cast("decimal(18,6)"))
    late = derived.positions(spark, sf).withColumn("arrival_time", F.when(F.col("id") % 53 != 0, F.col("timestamp") - shift))
    return with_headway_by_processing(late.select("id", "current_station", "direction", "timestamp", "arrival_time")).select(
        "id", "headway_seconds")


def _frame(hours: int) -> str:
    return f"range between interval '{hours * 3600 - 1}.999999 seconds' preceding and current row"


def _zscores(hours: int) -> str:
    parts = ", ".join(
        f"case when current_station is not null then round(({c} - avg({c}) over w) / (stddev_samp({c}) over w + 1e-7), 6) end as {c}_zscore"
        for c in METRIC_COLUMNS)
    return f"""with {HEADWAYS} select id, {parts} from moving
      window w as (partition by current_station, direction order by timestamp {_frame(hours)})"""


@query("rolling_zscore", _zscores(1))
def _(spark, sf):
    wide = rolling.with_rolling(moving(spark, sf), zscore_hours=1, stat_hours=())
    return wide.select("id", *[r6(f"{c}_zscore").alias(f"{c}_zscore") for c in METRIC_COLUMNS])


@query("rolling_zscore_day", _zscores(24))
def _(spark, sf):
    wide = rolling.with_rolling(moving(spark, sf), zscore_hours=24, stat_hours=(), slice_minutes=360)
    return wide.select("id", *[r6(f"{c}_zscore").alias(f"{c}_zscore") for c in METRIC_COLUMNS])


_PCT = ", ".join(
    f"""case when current_station is not null and {c} is not null then round((len(list_filter(l_{c}, lambda v: v < {c}))
      + (len(list_filter(l_{c}, lambda v: v = {c})) + 1) / 2.0) / len(l_{c}), 6) end as {c}_percentile"""
    for c in METRIC_COLUMNS)
_LISTS = ", ".join(f"list({c}) filter ({c} is not null) over w as l_{c}" for c in METRIC_COLUMNS)


@query("rolling_percentile", f"""with {HEADWAYS}, framed as (select *, {_LISTS} from moving
    window w as (partition by current_station, direction order by timestamp {_frame(1)})) select id, {_PCT} from framed""")
def _(spark, sf):
    wide = rolling.with_rolling_percentile(moving(spark, sf).select("id", "timestamp", "current_station", "direction", *METRIC_COLUMNS))
    return wide.select("id", *[r6(f"{c}_percentile").alias(f"{c}_percentile") for c in METRIC_COLUMNS])


_MULTI = ", ".join(
    f"""case when current_station is not null then round(avg({c}) over w{h}, 6) end as {c}_rolling_{h}h_mean,
    case when current_station is not null then round(stddev_samp({c}) over w{h}, 6) end as {c}_rolling_{h}h_std"""
    for c in METRIC_COLUMNS for h in (3, 6, 12, 24))
_WINDOWS = ", ".join(f"w{h} as (partition by current_station, direction order by timestamp {_frame(h)})" for h in (3, 6, 12, 24))


@query("rolling_stats_multi", f"with {HEADWAYS} select id, {_MULTI} from moving window {_WINDOWS}")
def _(spark, sf):
    wide = rolling.with_rolling(moving(spark, sf), zscore_hours=None)
    names = [f"{c}_rolling_{h}h_{s}" for c in METRIC_COLUMNS for h in (3, 6, 12, 24) for s in ("mean", "std")]
    return wide.select("id", *[r6(n).alias(n) for n in names])


_STATION = ", ".join(
    f"""case when current_station is not null then round(avg({c}) over w, 6) end as {c}_rolling_mean,
    case when current_station is not null then round(stddev_samp({c}) over w, 6) end as {c}_rolling_std""" for c in METRIC_COLUMNS)


@query("station_rolling", f"with {HEADWAYS} select id, {_STATION} from moving window w as (partition by current_station order by timestamp {_frame(1)})")
def _(spark, sf):
    wide = rolling.with_station_rolling(moving(spark, sf))
    names = [f"{c}_rolling_{s}" for c in METRIC_COLUMNS for s in ("mean", "std")]
    return wide.select("id", *[r6(n).alias(n) for n in names])


@query("global_zscore", f"""with {POSITIONS} select id, round((delay_seconds - (select avg(delay_seconds) from positions))
    / ((select stddev_samp(delay_seconds) from positions) + 1e-7), 6) as delay_seconds_zscore from positions""")
def _(spark, sf):
    return rolling.with_global_zscore(derived.positions(spark, sf), "delay_seconds").select(
        "id", r6("delay_seconds_zscore").alias("delay_seconds_zscore"))


@query("global_percentile", f"""with {HEADWAYS}, r as (select id, headway_seconds, rank() over (order by headway_seconds) as r,
    count(*) over (partition by headway_seconds) as peers, count(*) over () as n from moving where headway_seconds is not null)
    select moving.id, round((r.r + (peers - 1) / 2.0) / n, 6) as headway_percentile from moving left join r using (id)""")
def _(spark, sf):
    return ranks.average_rank_share(moving(spark, sf), "headway_seconds", "share").select("id", r6("share").alias("headway_percentile"))


@query("temporal_split", f"""with {POSITIONS}, r as (select id, row_number() over (order by timestamp, id) as rn, count(*) over () as n from positions)
    select id, rn <= floor(n * 0.8) as is_train from r""")
def _(spark, sf):
    return ranks.with_temporal_split(derived.positions(spark, sf)).select("id", "is_train")


@query("row_positions", f"""with {POSITIONS} select id, line, direction,
    row_number() over (partition by line, direction order by timestamp, id) - 1 as position from positions""")
def _(spark, sf):
    return ranks.with_position(derived.positions(spark, sf), ["line", "direction"], "timestamp", "id").select(
        "id", "line", "direction", "position")


_SEQUENCES = f"""with {POSITIONS}, w as (select line, direction, row_number() over k - 1 as start,
      count(*) over (k rows between current row and 23 following) as n, sum(delay_seconds) over (k rows between current row and 23 following) as total,
      last_value(id) over (k rows between current row and 23 following) as last_id
    from positions window k as (partition by line, direction order by timestamp, id))
    select line, direction, start, cast(total as bigint) as total, last_id from w where n = 24"""


def _sequence_totals(spark, sf, stride):
    return sliding_sequences(derived.positions(spark, sf), ["id", "delay_seconds"], stride=stride, block_rows=256).select(
        "line", "direction", "start",
        F.aggregate("items", F.lit(0).cast("long"), lambda a, i: a + i["delay_seconds"]).alias("total"),
        F.element_at("items", -1).getField("id").alias("last_id"))


@query("sequence_windows", _SEQUENCES)
def _(spark, sf):
    return _sequence_totals(spark, sf, 1)


@query("strided_windows", _SEQUENCES + " and start % 5 = 0")
def _(spark, sf):
    return _sequence_totals(spark, sf, 5)


@query("scaler", f"""with {POSITIONS}, s as (select avg(coalesce(dwell_time_seconds, 0)) as m, stddev_pop(coalesce(dwell_time_seconds, 0)) as d,
    avg(delay_seconds) as m2, stddev_pop(delay_seconds) as d2 from dwelled)
    select id, round((coalesce(dwell_time_seconds, 0) - m) / case when d = 0 then 1 else d end, 6) as dwell_scaled,
    round((delay_seconds - m2) / case when d2 = 0 then 1 else d2 end, 6) as delay_scaled from dwelled, s""")
def _(spark, sf):
    df, columns = derived.positions_with_dwell(spark, sf), ["dwell_time_seconds", "delay_seconds"]
    scaled = scaling.scale(df, scaling.fit_scaler(df, columns), columns)
    return scaled.select("id", r6("dwell_time_seconds_scaled").alias("dwell_scaled"), r6("delay_seconds_scaled").alias("delay_scaled"))


@query("normaliser", f"""with {POSITIONS}, s as (select avg(delay_seconds) as m, stddev_pop(delay_seconds) + 1e-7 as d from positions)
    select id, round((delay_seconds - m) / d, 6) as delay_normalised from positions, s""")
def _(spark, sf):
    df = derived.positions(spark, sf)
    scaled = scaling.scale(df, scaling.fit_normaliser(df, ["delay_seconds"]), ["delay_seconds"])
    return scaled.select("id", r6("delay_seconds_scaled").alias("delay_normalised"))


_CAPS = "(select " + ", ".join(f"quantile_cont(coalesce({c}, 0), 0.99) as cap_{c}" for c in METRIC_COLUMNS) + " from moving)"


@query("outlier_cap", f"""with {HEADWAYS}, caps as {_CAPS}
    select id, {", ".join(f"round(least(coalesce({c}, 0), cap_{c}), 6) as {c}" for c in METRIC_COLUMNS)} from moving, caps""")
def _(spark, sf):
    return scaling.cap_outliers(moving(spark, sf), METRIC_COLUMNS).select("id", *[r6(c).alias(c) for c in METRIC_COLUMNS])


@query("dataset_preparation", f"""with {HEADWAYS}, caps as {_CAPS}, capped as (
    select id, timestamp, {", ".join(f"least(coalesce({c}, 0), cap_{c}) as {c}" for c in METRIC_COLUMNS)} from moving, caps)
    select {sql_stamp("time_bucket(interval '1 hour', timestamp)")} as hour, count(*) as n,
    {", ".join(f"round(sum({c}), 4) as {c}" for c in METRIC_COLUMNS)} from capped group by 1""")
def _(spark, sf):
    prepared = scaling.cap_outliers(moving(spark, sf), METRIC_COLUMNS)
    return prepared.groupBy(stamp(fx.hour_floor("timestamp")).alias("hour")).agg(
        F.count("*").alias("n"), *[F.round(F.sum(c), 4).alias(c) for c in METRIC_COLUMNS])


@query("exact_percentiles", """select round(quantile_cont(value, 0.05), 6) as p05, round(quantile_cont(value, 0.5), 6) as p50,
    round(quantile_cont(value, 0.95), 6) as p95 from events""")
def _(spark, sf):
    out = ranks.exact_percentiles(derived.table(spark, sf, "events"), "value", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    return out.select(*[r6(c).alias(c) for c in out.columns])
