"""Detectors, ensemble, evaluation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from railtempo.catalog.base import ANOMALIES, DETECTIONS, HEADWAYS, LABELS, POSITIONS, query, r6, sql_stamp, stamp
from railtempo.catalog.features import moving
from railtempo.functions import scalar as fx
from railtempo.functions.features import BASE_FEATURES, with_calendar
from railtempo.operators import evaluate, forest, matching, reconstruct, recurrent, rolling, rules
from railtempo.operators.ensemble import combine_detections, ensemble_bucket
from railtempo.operators.ranks import exact_percentiles
from railtempo.plans import reports
from railtempo.sources import derived

RULE_ORDER = ["delay_rule", "zscore_rule"]


def framed(spark, sf):
    """Positions with headway and 24-hour z-scores."""
    return rolling.with_rolling(moving(spark, sf), zscore_hours=24, stat_hours=(), slice_minutes=360)


def rule_detections(spark, sf):
    rows = framed(spark, sf)
    return rules.delay_rule(rows).unionByName(rules.zscore_rule(rows))


_Z = """framed as (select *, case when current_station is not null then (headway_seconds - avg(headway_seconds) over w) / (stddev_samp(headway_seconds) over w + 1e-7) end as hz,
    case when current_station is not null then (dwell_time_seconds - avg(dwell_time_seconds) over w) / (stddev_samp(dwell_time_seconds) over w + 1e-7) end as dz from moving
    window w as (partition by current_station, direction order by timestamp range between interval '86399.999999 seconds' preceding and current row)),
  typed as (select *, coalesce(nullif(concat_ws('_', case when abs(hz) > 2 then 'headway' end, case when abs(dz) > 2 then 'dwell' end,
    case when abs(delay_seconds) > 300 then 'delay' end), ''), 'combined') as kind from framed)"""


def typed(spark, sf):
    return framed(spark, sf).withColumn("kind", fx.anomaly_kind("headway_seconds_zscore", "dwell_time_seconds_zscore", "delay_seconds"))


@query("anomaly_type", f"with {HEADWAYS}, {_Z} select id, kind from typed")
def _(spark, sf):
    return typed(spark, sf).select("id", "kind")


@query("flagship", f"""with {HEADWAYS}, {_Z}, found as (select *, least(1.0, greatest(abs(coalesce(hz, 0)), abs(coalesce(dz, 0)), abs(delay_seconds) / 300e0) / 10) as severity
      from typed where kind <> 'combined' and current_station is not null)
    select current_station as station_id, count(*) as n, round(max(severity), 6) as max_severity,
    case when max(severity) > 0.7 then 'red' when max(severity) > 0.4 then 'amber' else 'yellow' end as band from found group by 1""")
def flagship(spark, sf):
    """Positions, headway, rolling z-scores, anomaly type, station rollup."""
    strength = F.greatest(
        F.abs(F.coalesce("headway_seconds_zscore", F.lit(0.0))), F.abs(F.coalesce("dwell_time_seconds_zscore", F.lit(0.0))),
        F.abs("delay_seconds") / 300.0)
    found = typed(spark, sf).filter("kind <> 'combined'").select(
        F.col("current_station").alias("station_id"), F.least(F.lit(1.0), strength / 10).alias("severity"))
    return reports.station_rollup(found).select("station_id", "n", r6("max_severity").alias("max_severity"), "band")


@query("severity_scaled", f"""with {ANOMALIES}, s as (select id, -0.4e0 - severity / 4 as score from anomalies)
    select id, round(score / (select min(score) from s), 6) as severity from s""")
def _(spark, sf):
    scored = derived.anomalies(spark, sf).select("id", (-0.4 - F.col("severity") / 4).alias("score"))
    return forest.with_batch_severity(scored).select("id", r6("severity").alias("severity"))


@query("error_severity", f"""with {ANOMALIES}, t as (select quantile_cont(value, 0.95) as t from anomalies)
    select id, round(least(1.0, value / (2 * t)), 6) as severity, value > t as anomalous from anomalies, t""")
def _(spark, sf):
    df = derived.table(spark, sf, "events").select(F.col("event_id").alias("id"), "value")
    threshold = exact_percentiles(df, "value", {"t": 0.95}).scalar()
    return df.select("id", r6(fx.error_severity("value", threshold)).alias("severity"), (F.col("value") > threshold).alias("anomalous"))


@query("score_metrics", f"""with s as (select event_id, -0.4e0 - value / 1000 as score from events), t as (select quantile_cont(score, 0.05) as t from s)
    select cast(count(*) as double) as train_samples, round(avg(case when score < t then 1e0 else 0e0 end), 5) as anomaly_rate, round(avg(score), 5) as score_mean,
    round(stddev_pop(score), 5) as score_std, round(any_value(t), 5) as score_threshold from s, t""")
def _(spark, sf):
    scored = derived.table(spark, sf, "events").select((-0.4 - F.col("value") / 1000).alias("score"))
    out = forest.score_metrics(scored, exact_percentiles(scored, "score", {"t": 0.05}).scalar())
    return out.select("train_samples", *[F.round(c, 5).alias(c) for c in out.columns if c != "train_samples"])


@query("detector_union", f"with {DETECTIONS} select station_id, line, anomaly_type, round(severity, 6) as severity, model_name, id as source_position_id from detections")
def _(spark, sf):
    return rule_detections(spark, sf).select(
        "station_id", "line", "anomaly_type", r6("severity").alias("severity"), "model_name", "source_position_id")


_KEYED = "keyed as (select *, time_bucket(interval '5 minutes', timestamp) as bucket from detections)"


@query("ensemble_5min", f"""with {DETECTIONS}, {_KEYED}
    select station_id, line, {sql_stamp('bucket')} as bucket, case when count(*) > 1 then 'ensemble' else any_value(anomaly_type) end as anomaly_type,
      round(max(severity), 6) as severity, case when count(*) > 1 then 'ensemble_' || count(*) else 'v1' end as model_version,
      count(*) as detection_count, count(distinct model_name) as distinct_models, arg_min(delay_seconds, (model_rank, id)) as first_delay,
      round(arg_max(case when model_rank = 0 then severity end, id), 6) as delay_rule_severity,
      round(arg_max(case when model_rank = 1 then severity end, id), 6) as zscore_rule_severity
    from keyed group by station_id, line, bucket""")
def _(spark, sf):
    out = combine_detections(rule_detections(spark, sf), model_order=RULE_ORDER)
    parts = [r6(F.try_element_at("individual_severities", F.lit(m))).alias(f"{m}_severity") for m in RULE_ORDER]
    return out.select(
        "station_id", "line", stamp("bucket").alias("bucket"), "anomaly_type", r6("severity").alias("severity"), "model_version",
        "detection_count", "distinct_models", F.col("features")["delay_seconds"].cast("int").alias("first_delay"), *parts)


@query("ensemble_station_line", f"""with {DETECTIONS} select station_id, line, count(*) as detection_count, round(max(severity), 6) as severity,
    count(*) filter (model_rank = 0) as delay_rule_count, count(*) filter (model_rank = 1) as zscore_rule_count from detections group by 1, 2""")
def _(spark, sf):
    # detections without a time in their metadata share one bucket per station and line
    timeless = rule_detections(spark, sf).withColumn("meta_data", F.map_filter("meta_data", lambda k, _: k != "timestamp"))
    out = combine_detections(timeless, "metadata", RULE_ORDER)
    return out.select("station_id", "line", "detection_count", r6("severity").alias("severity"), *[
        F.coalesce(F.try_element_at("model_counts", F.lit(m)), F.lit(0)).alias(f"{m}_count") for m in RULE_ORDER])


@query("ensemble_members", f"with {DETECTIONS}, {_KEYED} select station_id, line, {sql_stamp('bucket')} as bucket, model_name, id as source_position_id from keyed")
def _(spark, sf):
    return matching.ensemble_members(rule_detections(spark, sf), ensemble_bucket()).withColumn("bucket", stamp("bucket"))


_JUDGED = f"""{POSITIONS}, {LABELS}, judged as (select p.id, l.is_anomaly, cast(abs(p.delay_seconds) > 300 as int) as predicted
    from positions p join labelled l using (id))"""


def judged(spark, sf):
    rows = derived.positions(spark, sf)
    marked = matching.mark_detected(rows, rules.delay_rule(rows)).select("id", "predicted")
    return matching.with_labels(marked, derived.labels(spark, sf))


@query("prediction_labels", f"with {_JUDGED} select id, predicted, is_anomaly from judged")
def _(spark, sf):
    return judged(spark, sf)


_COUNTS = """c as (select count(*) filter (is_anomaly = 1 and predicted = 1) as tp, count(*) filter (is_anomaly = 0 and predicted = 1) as fp,
    count(*) filter (is_anomaly = 1 and predicted = 0) as fn from judged)"""


@query("evaluate_prf", f"""with {_JUDGED}, {_COUNTS} select tp, fp, fn, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall,
    round(2 * tp / (2 * tp + fp + fn), 6) as f1, tp + fn as support from c""")
def _(spark, sf):
    out = evaluate.precision_recall(judged(spark, sf))
    return out.select("tp", "fp", "fn", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("class_report", f"""with {_JUDGED}, k as (select unnest([0, 1]) as class) select class,
    round(coalesce(count(*) filter (is_anomaly = class and predicted = class) / nullif(count(*) filter (predicted = class), 0), 0), 6) as precision,
    round(coalesce(count(*) filter (is_anomaly = class and predicted = class) / nullif(count(*) filter (is_anomaly = class), 0), 0), 6) as recall,
    count(*) filter (is_anomaly = class) as support from judged, k group by class""")
def _(spark, sf):
    return evaluate.class_report(judged(spark, sf)).select("class", r6("precision").alias("precision"), r6("recall").alias("recall"), "support")


@query("severity_statistics", f"""with {ANOMALIES} select round(avg(severity), 6) as mean, round(stddev_pop(severity), 6) as std, round(min(severity), 6) as min,
    round(max(severity), 6) as max, round(quantile_cont(severity, 0.25), 6) as q25, round(quantile_cont(severity, 0.5), 6) as q50,
    round(quantile_cont(severity, 0.75), 6) as q75 from anomalies""")
def _(spark, sf):
    out = evaluate.severity_statistics(derived.anomalies(spark, sf))
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query("detection_rate", f"""with {POSITIONS} select count(*) as positions_checked, count(*) filter (abs(delay_seconds) > 300) as anomalies_detected,
    round(count(*) filter (abs(delay_seconds) > 300) / count(*), 6) as anomaly_rate from positions""")
def _(spark, sf):
    rows = derived.positions(spark, sf)
    return evaluate.detection_rate(rows, rules.delay_rule(rows)).withColumn("anomaly_rate", r6("anomaly_rate"))


def model_rows(spark, sf):
    return with_calendar(moving(spark, sf))


@query("forest_anomalies")
def _(spark, sf):
    rows = model_rows(spark, sf)
    model = forest.fit_forest(rows, BASE_FEATURES)
    out = forest.forest_detections(rows, model)
    return out.select("source_position_id", "station_id", "line", "anomaly_type", "severity", "model_name")


@query("sequence_anomalies")
def _(spark, sf):
    rows = model_rows(spark, sf)
    model = reconstruct.fit_sequences(rows)
    return reconstruct.sequence_detections(rows, model).select(
        "source_position_id", "station_id", "line", "anomaly_type", "severity", "model_name")


@query("recurrent_anomalies")
def _(spark, sf):
    rows = model_rows(spark, sf)
    model = recurrent.fit_recurrent(rows)
    return reconstruct.sequence_detections(rows, model, name="recurrent_model").select(
        "source_position_id", "station_id", "line", "anomaly_type", "severity", "model_name")


# a small model whose arithmetic SQL can write out: two units each way over sequences of three rows of one column
_TINY = recurrent.RecurrentModel(
    ["delay_seconds"], 3, {"delay_seconds_mean": 200.0, "delay_seconds_std": 400.0},
    ((np.array([[0.5, -0.25], [0.25, 0.5]]), np.array([[1.0], [-0.5]]), np.array([0.0, 0.25])),
     (np.array([[-0.5, 0.25], [0.5, 0.25]]), np.array([[0.5], [1.0]]), np.array([0.25, -0.5]))),
    np.array([[0.125], [0.75], [-0.5], [0.25], [0.5]]), threshold=0.25)
_TINY_STATES = f"""{POSITIONS}, numbered as (
    select *, (coalesce(delay_seconds, 0) - 200e0) / 400e0 as x, row_number() over w - 1 as n from positions
    window w as (partition by line, direction order by timestamp, id)),
  triples as (select n as first, array[id, lead(id) over w, lead(id, 2) over w] as ids, x as x0, lead(x) over w as x1, lead(x, 2) over w as x2
    from numbered window w as (partition by line, direction order by n)),
  ends as (select *, tanh(x0) as p0, tanh(0.25e0 - 0.5e0 * x0) as q0, tanh(0.25e0 + 0.5e0 * x2) as r2, tanh(x2 - 0.5e0) as s2 from triples where x2 is not null),
  mids as (select *, tanh(0.5e0 * p0 - 0.25e0 * q0 + x1) as p1, tanh(0.25e0 * p0 + 0.5e0 * q0 - 0.5e0 * x1 + 0.25e0) as q1,
    tanh(0.25e0 * s2 - 0.5e0 * r2 + 0.5e0 * x1 + 0.25e0) as r1, tanh(0.5e0 * r2 + 0.25e0 * s2 + x1 - 0.5e0) as s1 from ends),
  states as (
    select ids[1] as id, first, 0 as position, x0 as x, 0e0 as p, 0e0 as q, r1 as r, s1 as s from mids
    union all select ids[2], first, 1, x1, p0, q0, r2, s2 from mids
    union all select ids[3], first, 2, x2, p1, q1, 0e0, 0e0 from mids)"""


def tiny_rows(spark, sf):
    return reconstruct.numbered_rows(derived.positions(spark, sf), _TINY.columns, _TINY.normaliser)


@query("recurrent_errors", f"""with {_TINY_STATES}, errors as (select *, pow(x - (0.125e0 + 0.75e0 * p - 0.5e0 * q + 0.25e0 * r + 0.5e0 * s), 2) as error from states)
    select id, first as start, position, round(error, 6) as error from errors where error > 0.25""")
def _(spark, sf):
    """Rows of sequences that a fixed model reconstructs badly."""
    return reconstruct.sequence_errors(tiny_rows(spark, sf), _TINY, _TINY.threshold).withColumn("error", r6("error"))


@query("recurrent_products", f"""with {_TINY_STATES}, cells as (
      select unnest([1e0, p, q, r, s]) as a, unnest([0, 1, 2, 3, 4]) as i, [1e0, p, q, r, s, x] as row from states),
    pairs as (select i, a, unnest(row) as b, unnest([0, 1, 2, 3, 4, 5]) as j from cells)
    select cast(i as int) as i, cast(j as int) as j, round(sum(a * b), 4) as value from pairs group by i, j""")
def _(spark, sf):
    """The sums that a read-out is solved from."""
    return recurrent.state_products(tiny_rows(spark, sf), _TINY).withColumn("value", F.round("value", 4))


@query("synthetic_labels")
def _(spark, sf):
    return evaluate.synthetic_labels(moving(spark, sf)).select("id", "is_anomaly")


@query("augmented_rows")
def _(spark, sf):
    rows = moving(spark, sf).join(derived.labels(spark, sf), "id")
    return evaluate.augment_anomalies(rows).select("id", "headway_seconds", "dwell_time_seconds", "delay_seconds", "is_anomaly")


@query("shuffled_rows", f"with {POSITIONS} select id, line, delay_seconds from positions")
def _(spark, sf):
    return evaluate.shuffled(derived.positions(spark, sf)).select("id", "line", "delay_seconds")
