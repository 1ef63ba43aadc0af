"""Registration and the SQL text of the derived tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def r6(column: Column | str) -> Column:
    return F.round(column, 6)


def stamp(column: Column | str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def sql_stamp(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


_ROUTE = "['1','2','3','A','C','E','N','Q',' gs','SI','6X','L']"
_KNOWN = "('1','2','3','4','5','6','7','A','C','E','B','D','F','M','N','Q','R','W','J','Z','L','G','SI')"


def sql_line(route: str) -> str:
    name = f"upper(trim({route}))"
    return f"case when {name} in {_KNOWN} then {name} when {name} in ('S','GS') then 'S' else lower({name}) end"


_PICK = f"{_ROUTE}[cast(event_id % 12 as int) + 1]"

POSITIONS = f"""positions as (
  select event_id as id, ts as timestamp, 'trip_' || user_id as trip_id, {_PICK} as route_id, {sql_line(_PICK)} as line,
    cast(event_id % 2 as int) as direction, case when event_id % 97 <> 0 then 'S' || (user_id % 5) end as current_station,
    case when event_id % 53 <> 0 then ts end as arrival_time,
    ts + to_seconds(event_id * 37 % 120 - 10) as departure_time,
    cast(floor(value * 10) - 300 as int) as delay_seconds
  from events),
dwelled as (
  select *, case when epoch_us(departure_time) > epoch_us(arrival_time)
    then (epoch_us(departure_time) - epoch_us(arrival_time)) // 1000000 end as dwell_time_seconds from positions)"""

HEADWAYS = POSITIONS + """,
gaps as (
  select *, epoch_us(arrival_time) - epoch_us(last_value(arrival_time ignore nulls) over (
    partition by current_station, direction order by arrival_time, id rows between unbounded preceding and 1 preceding)) as gap
  from dwelled),
moving as (select * exclude (gap), case when gap < 1800000000 then gap // 1000000 end as headway_seconds from gaps)"""

CALENDAR = """calendar as (
  select *, hour(timestamp) as hour, isodow(timestamp) - 1 as day_of_week, cast(isodow(timestamp) >= 6 as int) as is_weekend,
    cast(isodow(timestamp) < 6 and (hour(timestamp) between 7 and 10 or hour(timestamp) between 17 and 20) as int) as is_rush_hour,
    hour(timestamp) * 60 + minute(timestamp) as minutes_since_midnight
  from {source})"""

ANOMALIES = f"""anomalies as (
  select event_id as id, ts as detected_at, case when event_id % 97 <> 0 then 'S' || (user_id % 5) end as station_id,
    {sql_line(_PICK)} as line, event_type as anomaly_type, least(1.0, value / 200) as severity,
    case when event_id % 2 = 0 then 'isolation_forest' else 'sequence_model' end as model_name,
    event_id % 3 = 0 as resolved, 'trip_' || user_id as trip_id, value
  from events)"""

STATIONS = """stations as (
  select 'S' || (n_nationkey + cast(n_nationkey >= 4 as int)) as id, n_name as name, 40.5e0 + 0.1e0 * n_nationkey as lat,
    -74 + 0.1e0 * n_nationkey as lon
  from nation)"""

SUBSCRIPTIONS = f"""subscriptions as (
  select cast(c_custkey as varchar) as client_id,
    case when c_custkey % 3 <> 0 then {sql_line(f"{_ROUTE}[cast(c_custkey % 12 as int) + 1]")} end as line,
    case when c_custkey % 2 <> 0 then 'S' || (c_custkey % 5) end as station_id,
    case when c_custkey % 5 = 0 then ['view','click','purchase'][cast(c_custkey % 3 as int) + 1] end as anomaly_type
  from customer)"""

ARTIFACTS = """artifacts as (
  select p_partkey as id, p_type as model_type, cast(p_partkey as varchar) as version, p_partkey % 7 = 0 as is_active,
    p_size as training_samples, p_retailprice as score_mean
  from part)"""

LABELS = "labelled as (select event_id as id, cast(value > 150 as int) as is_anomaly from events)"

# stop rows and alerts of the derived feed messages, written out without any nesting
STOPS = f"""base as (select o_orderkey as k, cast(epoch(o_orderdate) as bigint) as d, o_orderpriority as p from orders),
stops as (
  select k, ['1','A','B','G','J','L','N','SI'][cast(k % 8 as int) + 1] as feed_code, d + k % 86400 as message_time,
    'trip_' || k as trip_id, {_ROUTE}[cast(k % 12 as int) + 1] as route_id,
    case when k % 7 = 0 then 0 else k % 2 end as direction, 'S' || ((k + i) % 5) as stop_id,
    case when (k + i) % 11 <> 0 then d + (k % 1000) * 60 + i * 300 end as arrival,
    case when (k + i) % 13 <> 0 then d + (k % 1000) * 60 + i * 300 + 30 end as departure,
    case when (k + i) % 11 <> 0 and (k + i) % 3 <> 0 then (k * 7 + i * 13) % 1200 - 300 else 0 end as delay
  from base, range(0, 5) as r(i) where k % 20 <> 0 and i < k % 5),
alerts as (
  select k, k || '-t' as alert_id, p as header from base where k % 20 = 0
  union all select k, k || '-a', case when k % 8 = 0 then '' else p end from base where k % 4 = 0)"""

# every detection of the two rule detectors over the same positions
DETECTIONS = HEADWAYS + """,
framed as (
  select *, (delay_seconds - avg(delay_seconds) over w) / (stddev_samp(delay_seconds) over w + 1e-7) as z from moving
  window w as (partition by current_station, direction order by timestamp
    range between interval '86399.999999 seconds' preceding and current row)),
detections as (
  select current_station as station_id, line, 'delay' as anomaly_type, least(1.0, abs(delay_seconds) / 1800e0) as severity,
    'delay_rule' as model_name, 0 as model_rank, id, timestamp, delay_seconds from framed where abs(delay_seconds) > 300
  union all
  select current_station, line, 'zscore', least(1.0, abs(z) / 10), 'zscore_rule', 1, id, timestamp, delay_seconds
  from framed where current_station is not null and abs(z) > 2)"""
