"""Entries for what SQL cannot compute itself: what must hold of a model's results, over whole tables, and whole detection runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from railtempo.catalog.base import DETECTIONS, HEADWAYS, QUERIES, SQL, query, r6, sql_stamp, stamp
from railtempo.catalog.features import _frame, moving
from railtempo.functions.features import BASE_FEATURES, with_calendar
from railtempo.operators import forest, rolling, rules
from railtempo.operators.filters import last_minutes
from railtempo.plans.detection import DetectorSet, as_anomalies, detection_run, run_summary
from railtempo.schemas import METRIC_COLUMNS
from railtempo.sources import derived


@query("rolling_percentile_fine", SQL["rolling_percentile"])
def _(spark, sf):
    """As ``rolling_percentile``, over slices of 20 minutes."""
    wide = rolling.with_rolling_percentile(
        moving(spark, sf).select("id", "timestamp", "current_station", "direction", *METRIC_COLUMNS), slice_minutes=20)
    return wide.select("id", *[r6(f"{c}_percentile").alias(f"{c}_percentile") for c in METRIC_COLUMNS])


@query("rolling_zscore_double", f"""with {HEADWAYS}, p as (select id, timestamp, current_station, direction, delay_seconds / 8e0 as share from moving)
    select id, case when current_station is not null then round((share - avg(share) over w) / (stddev_samp(share) over w + 1e-7), 5) end as z from p
    window w as (partition by current_station, direction order by timestamp {_frame(1)})""")
def _(spark, sf):
    rows = moving(spark, sf).withColumn("share", F.col("delay_seconds") / 8)
    return rolling.with_rolling(rows, ["share"], 1, ()).select("id", F.round("share_zscore", 5).alias("z"))


# thirds, in units that differ by up to 24 powers of ten from row to row
_SIZED = "((id * 7919) % 1009 + 1) / 3e0 * case id % 3 when 0 then 1e-9 when 1 then 1e0 else 1e15 end"


def _digits(column: str, least: str = "0e0") -> str:
    """Six digits of a number and its power of ten; 0 if it is not over ``least``."""
    power = f"floor(log10({column}))"
    shown = f"round({column} / power(1e1, {power}), 6)"
    return f"case when {column} > {least} then {{}} when {column} is not null then 0e0 end".format(shown), (
        f"case when {column} > {least} then cast({power} as integer) end")


_DIGITS = {}
for _h in (3, 24):
    _DIGITS |= {f"mean_{_h}h": _digits(f"m{_h}"), f"std_{_h}h": _digits(f"s{_h}", f"1e-9 * m{_h}")}
_SHOWN = ", ".join(f"{shown} as {name}, {power} as {name}_power" for name, (shown, power) in _DIGITS.items())


@query("rolling_moments_double", f"""with {HEADWAYS}, p as (select id, timestamp, current_station, direction, {_SIZED} as v from moving),
    w as (select id, {", ".join(f"case when current_station is not null then avg(v) over w{h} end as m{h}, case when current_station is not null then stddev_samp(v) over w{h} end as s{h}" for h in (3, 24))}
      from p window {", ".join(f"w{h} as (partition by current_station, direction order by timestamp {_frame(h)})" for h in (3, 24))})
    select id, {_SHOWN} from w""")
def _(spark, sf):
    """Means and deviations of numbers of very different size, to six digits each."""
    rows = moving(spark, sf).withColumn("v", F.expr(_SIZED))
    wide = rolling.with_rolling(rows, ["v"], None, (3, 24))
    named = wide.selectExpr("id", *[f"v_rolling_{h}h_{long} as {short}{h}" for h in (3, 24) for long, short in (("mean", "m"), ("std", "s"))])
    return named.selectExpr("id", *[f"{shown} as {name}" for name, (shown, _) in _DIGITS.items()], *[f"{power} as {name}_power" for name, (_, power) in _DIGITS.items()])


MINUTES = 360
_RECENT = f"""{DETECTIONS.replace("86399.999999", "3599.999999")},
  inside as (select *, time_bucket(interval '5 minutes', timestamp) as bucket from detections
    where timestamp >= (select max(timestamp) from positions) - interval '{MINUTES} minutes'),
  found as (select station_id, line, case when count(*) > 1 then 'ensemble' else any_value(anomaly_type) end as anomaly_type, max(severity) as severity,
    case when count(*) > 1 then 'ensemble' else any_value(model_name) end as model_name,
    case when count(*) > 1 then 'ensemble_' || count(*) else 'v1' end as model_version,
    case when count(*) > 1 then bucket else any_value(timestamp) end as event_time from inside group by station_id, line, bucket)"""


def _run(spark, sf):
    detectors = DetectorSet()
    detectors.register("delay", rules.delay_rule)
    detectors.register("zscore", rules.zscore_rule)
    rows = moving(spark, sf)
    return rows, as_anomalies(detection_run(rows, detectors, MINUTES))


@query("detection_run", f"""with {_RECENT} select station_id, line, anomaly_type, round(severity, 6) as severity, model_name, model_version,
    {sql_stamp('event_time')} as event_time from found""")
def _(spark, sf):
    """Features, both rule detectors and the ensemble over the last six hours."""
    return _run(spark, sf)[1].select(
        "station_id", "line", "anomaly_type", r6("severity").alias("severity"), "model_name", "model_version", stamp("event_time").alias("event_time"))


@query("detection_summary", f"""with {_RECENT}, n as (select count(*) as n from positions
      where timestamp >= (select max(timestamp) from positions) - interval '{MINUTES} minutes')
    select n as positions_checked, (select count(*) from found) as anomalies_detected, round((select count(*) from found) / n, 6) as anomaly_rate from n""")
def _(spark, sf):
    rows, found = _run(spark, sf)
    return run_summary(last_minutes(rows, MINUTES).count(), found).select(
        F.col("positions_checked").cast("bigint").alias("positions_checked"), "anomalies_detected", r6("anomaly_rate").alias("anomaly_rate"))


def _events(spark, sf):
    return derived.table(spark, sf, "events").select(F.col("event_id").alias("id"))


@query("synthetic_labels_check", "select count(*) as n, count(distinct event_id) as ids, true as share_right from events")
def _(spark, sf):
    marked = F.count_if(F.col("is_anomaly") == 1)
    return QUERIES["synthetic_labels"](spark, sf).agg(
        F.count("*").alias("n"), F.countDistinct("id").alias("ids"), ((marked > 0) & (marked <= F.ceil(0.05 * F.count("*")))).alias("share_right"))


def _found_check(spark, sf, name: str):
    n = _events(spark, sf).agg(F.count("*")).scalar()
    found = QUERIES[name](spark, sf)
    known = found.join(_events(spark, sf), F.col("source_position_id") == F.col("id"), "left")
    return known.agg(
        F.count_if(F.col("id").isNull()).alias("unknown"), (F.count("*") - F.countDistinct("source_position_id")).alias("repeated"),
        F.count_if(~F.coalesce(F.col("severity").between(0, 1), F.lit(False))).alias("outside"), F.max("severity").alias("top"), F.count("*").alias("rows"),
    ).withColumn("n", n)


@query("forest_anomalies_check", "select 0::bigint as unknown, 0::bigint as repeated, 0::bigint as outside, 1e0 as top, true as share_right")
def _(spark, sf):
    out = _found_check(spark, sf, "forest_anomalies")
    return out.select("unknown", "repeated", "outside", "top", ((F.col("rows") > 0) & (F.col("rows") <= F.ceil(0.05 * F.col("n")))).alias("share_right"))


@query("sequence_anomalies_check", "select 0::bigint as unknown, 0::bigint as repeated, 0::bigint as outside, true as some")
def _(spark, sf):
    return _found_check(spark, sf, "sequence_anomalies").select("unknown", "repeated", "outside", (F.col("rows") > 0).alias("some"))


@query("stored_forest_check", "select 0::bigint as different, true as same_threshold, count(*) as n from events")
def _(spark, sf):
    """A forest that was stored and read scores every row as the one just grown."""
    from railtempo.catalog.streams import scratch
    from railtempo.plans import training

    rows, path = with_calendar(moving(spark, sf)), scratch(spark, "forest")
    fresh = forest.fit_forest(rows, BASE_FEATURES)
    training.save_forest(spark, fresh, path)
    loaded = training.load_forest(spark, path)
    both = forest.with_scores(forest.with_scores(rows, fresh), loaded, "stored")
    return both.agg(F.count_if(F.col("score") != F.col("stored")).alias("different"), F.lit(fresh.threshold == loaded.threshold).alias("same_threshold"),
                    F.count("*").alias("n"))


@query("augmented_rows_check", "select count(*) + count(*) filter (value > 150) as n, count(*) as unchanged from events")
def _(spark, sf):
    measures = ["headway_seconds", "dwell_time_seconds", "delay_seconds"]
    given = moving(spark, sf).select(F.col("id").alias("_id"), *[F.col(c).cast("double").alias(f"_{c}") for c in measures])
    out = QUERIES["augmented_rows"](spark, sf).join(given, F.col("id") == F.col("_id"), "left")
    same = F.lit(True)
    for c in measures:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return out.agg(F.count("*").alias("n"), F.count_if(same).alias("unchanged"))


@query("forest_search_check", "select 27::bigint as settings, 0::bigint as inconsistent")
def _(spark, sf):
    p, r = F.col("precision"), F.col("recall")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return QUERIES["forest_search"](spark, sf).agg(
        F.countDistinct("contamination", "n_estimators", "max_samples").alias("settings"), F.count_if(F.abs(f1 - F.col("f1")) > 1e-9).alias("inconsistent"))
