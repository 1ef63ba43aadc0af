"""Stored tables: append-only facts partitioned by date, and small versioned tables.

Facts are never rewritten; batches of past dates can be copied into few large files. Resolutions are an append-only log applied on read. A small mutable table (stations, model
registry) is written whole under a new version; readers take the newest version, so a failed write is never seen.
"""

from __future__ import annotations

import time
import uuid
import zlib
from datetime import date, timedelta

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from railtempo.operators.upsert import activate, apply_resolutions


def batch_label(checkpoint: str, batch_id: int) -> str:
    """Name of a stream's micro-batch, the same when the batch is repeated after a failure."""
    return f"{zlib.crc32(checkpoint.encode()):08x}-{batch_id}"


def append_by_date(df: DataFrame, path: str, ts: str, batch: str | None = None) -> None:
    """Append to a fact table, laid out as ``date=.../batch=...``, so that a date predicate prunes before batches are listed.

    A repeated micro-batch overwrites its own folders, so nothing is stored twice. Rows are rebalanced by date: small dates
    share a task and large ones are split, which bounds both file count and task size. Files are sorted by time for
    row-group skipping.
    """
    dated = df.withColumn("date", F.to_date(ts)).withColumn("batch", F.lit(batch or uuid.uuid4().hex)).hint("rebalance", F.col("date"))
    dated.sortWithinPartitions("date", ts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "date", "batch").parquet(path)


def _facts(spark: SparkSession, path: str, dates: Column) -> DataFrame:
    """Rows with ``date`` and ``batch`` where ``dates`` holds: from closed dates' newest copy what it has, and all
    else from the batches."""
    batches, copies = _parts(spark, path)
    batches = batches.filter(dates)
    if copies is None:
        return batches
    copied = _newest(copies.filter(dates))
    return batches.join(copied.select("date", "batch").distinct(), ["date", "batch"], "left_anti").select(*batches.columns).unionByName(copied)


def _schema(spark: SparkSession, path: str) -> T.StructType:
    """Columns of the facts, from the copies where no batch is left. Folder names do not decide types: a label of digits stays
    text, and dates are dates where only rows without one are left."""
    try:
        found = spark.read.parquet(path).schema
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        found = spark.read.parquet(copies_of(path)).drop("generation").schema
    kinds = {"date": T.DateType(), "batch": T.StringType()}
    return T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in found.fields])


def _parts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """All batches, and all copies if there are any. Batches are listed first, so a copy finished in between hides them."""
    schema = _schema(spark, path)
    batches = spark.read.schema(schema).parquet(path)
    try:
        return batches, spark.read.schema(T.StructType([*schema.fields, T.StructField("generation", T.LongType())])).parquet(copies_of(path))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return batches, None


def _newest(copies: DataFrame) -> DataFrame:
    newest = copies.groupBy("date").agg(F.max("generation").alias("generation"))
    return copies.join(newest, ["date", "generation"], "left_semi").drop("generation")


def copies_of(path: str) -> str:
    """Folder of a fact table's compacted dates."""
    return f"{path.rstrip('/')}-closed"


def compact(spark: SparkSession, path: str, ts: str, before: date) -> list[date]:
    """Copy the dates before ``before`` that have batches not copied yet, all batches of a date into few large files. Returns these dates.

    A copy is a new folder that appears as a whole when the job commits (a rename), so a reader sees either the batches or the
    copy. The batches stay until :func:`remove_compacted`, and an older copy does as well: who listed them before can go on
    reading. A compaction that fails leaves nothing to be seen; a repeated one finds nothing to do. Rows that come for
    a date already copied are a batch beside its copy, and join it in the next compaction. One compaction at a time.
    """
    closed = F.col("date") < F.lit(before)
    batches, copies = _parts(spark, path)
    waiting = batches.filter(closed).select("date", "batch").distinct()
    if copies is not None:
        waiting = waiting.join(_newest(copies).select("date", "batch").distinct(), ["date", "batch"], "left_anti")
    dates = sorted(r[0] for r in waiting.select("date").distinct().collect())  # as many as days
    if dates:
        rows = _facts(spark, path, F.col("date").isin(dates)).withColumn("generation", F.lit(time.time_ns()))
        rows.hint("rebalance", F.col("date")).sortWithinPartitions("date", ts).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("date", "generation").parquet(copies_of(path))
    return dates


def remove_compacted(spark: SparkSession, path: str, grace: timedelta = timedelta(days=1)) -> int:
    """Delete batches that a copy at least ``grace`` old has, and copies that a newer one of that age replaces. Returns the number of folders.

    ``grace`` must be longer than any reader takes. Only folder names pass through the driver.
    """
    _, copies = _parts(spark, path)
    if copies is None:
        return 0
    aged = copies.filter(F.col("generation") <= time.time_ns() - int(grace.total_seconds() * 1e9))
    pairs = aged.select("date", "batch").distinct().collect()
    newest = F.max("generation").over(W.partitionBy("date"))
    replaced = aged.select("date", "generation").distinct().withColumn("_newest", newest).filter("generation < _newest").collect()
    folders = [f"{path.rstrip('/')}/date={r['date']}/batch={r['batch']}" for r in pairs]
    folders += [f"{copies_of(path)}/date={r['date']}/generation={r['generation']}" for r in replaced]
    removed = 0
    for folder in folders:
        store, name = fs.FileSystem.from_uri(folder)
        if store.get_file_info(name).type == fs.FileType.Directory:
            store.delete_dir(name)
            removed += 1
    return removed


def read_range(spark: SparkSession, path: str, ts: str, start=None, end=None) -> DataFrame:
    """Fact rows in [start, end], compacted or not. The date predicate next to the time predicate prunes partitions."""
    dates, times = F.lit(True), F.lit(True)
    if start is not None:
        dates, times = dates & (F.col("date") >= F.to_date(F.lit(start))), times & (F.col(ts) >= F.lit(start))
    if end is not None:
        dates, times = dates & (F.col("date") <= F.to_date(F.lit(end))), times & (F.col(ts) <= F.lit(end))
    return _facts(spark, path, dates).filter(times).drop("date", "batch")


def append_positions(df: DataFrame, path: str, batch: str | None = None) -> None:
    """Positions with the defaults of missing values: timestamp now, direction 0, delay 0."""
    have = set(df.columns)
    filled = df.withColumns({
        "timestamp": F.coalesce(F.col("timestamp"), F.current_timestamp()) if "timestamp" in have else F.current_timestamp(),
        "direction": F.coalesce(F.col("direction"), F.lit(0)) if "direction" in have else F.lit(0),
        "delay_seconds": F.coalesce(F.col("delay_seconds"), F.lit(0)) if "delay_seconds" in have else F.lit(0),
    })
    for name, kind in (("current_station", "string"), ("next_station", "string"), ("arrival_time", "timestamp"),
                       ("departure_time", "timestamp"), ("headway_seconds", "int"), ("dwell_time_seconds", "int"),
                       ("schedule_adherence", "double")):
        if name not in have:
            filled = filled.withColumn(name, F.lit(None).cast(kind))
    append_by_date(filled, path, "timestamp", batch)


def append_anomalies(df: DataFrame, path: str, batch: str | None = None) -> None:
    """Anomalies with detected_at now (unless given) and not resolved; the id is a hash of the content."""
    have = set(df.columns)
    rows = df.withColumns({
        "detected_at": F.coalesce(F.col("detected_at"), F.current_timestamp()) if "detected_at" in have else F.current_timestamp(),
        "resolved": F.lit(False),
        "resolved_at": F.lit(None).cast("timestamp"),
    })
    if "id" not in have:
        rows = rows.withColumn("id", F.xxhash64(
            "station_id", "line", "anomaly_type", "severity", "model_name", "model_version", "detected_at",
            *[c for c in ("event_time", "source_position_id") if c in have]))
    append_by_date(rows, path, "detected_at", batch)


def append_resolution(spark: SparkSession, anomaly_id: int, anomalies: DataFrame, log_path: str) -> bool:
    """Record that an anomaly was resolved; False if there is no such anomaly."""
    hit = anomalies.filter(F.col("id") == anomaly_id).limit(1).select("id", F.current_timestamp().alias("resolved_at"))
    if hit.isEmpty():
        return False
    hit.write.mode("append").parquet(log_path)
    return True


def read_anomalies(spark: SparkSession, path: str, log_path: str | None = None, start=None, end=None) -> DataFrame:
    rows = read_range(spark, path, "detected_at", start, end)
    return apply_resolutions(rows, spark.read.parquet(log_path)) if log_path else rows


def replace_table(df: DataFrame, path: str) -> int:
    """Write a small table whole as a new version; single writer. Returns the version."""
    version = time.time_ns()
    df.withColumn("version_no", F.lit(version)).write.mode("append").partitionBy("version_no").parquet(path)
    return version


def replace_if_changed(df: DataFrame, path: str) -> bool:
    """As :func:`replace_table`, unless the table's rows are those it has. Small tables only; what ``df`` takes from the table
    must come from its newest version."""
    old = read_table(df.sparkSession, path)
    changed = not (df.exceptAll(old).isEmpty() and old.exceptAll(df).isEmpty())
    if changed:
        replace_table(df, path)
    return changed


def read_table(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.filter(F.col("version_no") == df.agg(F.max("version_no")).scalar()).drop("version_no")


def record_artifact(spark: SparkSession, path: str, model_type: str, version: str, metrics: dict[str, float],
                    artifact_path: str, samples: int, existing: DataFrame | None = None) -> DataFrame:
    """Registry with a new active artifact of the type."""
    row = spark.createDataFrame([(model_type, version, {k: float(v) for k, v in metrics.items()}, artifact_path, samples)],
                                "model_type string, version string, metrics map<string,double>, artifact_path string, training_samples long")
    row = row.select(
        F.xxhash64("model_type", "version").alias("id"), "model_type", "version", F.current_timestamp().alias("trained_at"),
        F.lit(None).cast("string").alias("git_sha"), "metrics",
        F.create_map().cast("map<string,string>").alias("hyperparameters"), "training_samples", "artifact_path",
        F.lit(False).alias("is_active"),
    )
    registry = row if existing is None else existing.unionByName(row)
    registry = activate(registry, row.select("model_type", "version"))
    replace_table(registry, path)
    return read_table(spark, path)


def json_safe(df: DataFrame, out: str = "json") -> DataFrame:
    """All columns as one JSON text: decimals as doubles, dates and times as ISO text."""
    from railtempo.functions.scalar import iso_text

    def safe(field):
        c = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            return c.cast("double").alias(field.name)
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            return iso_text(c).alias(field.name)
        if isinstance(field.dataType, T.DateType):
            return F.date_format(c, "yyyy-MM-dd").alias(field.name)
        return c

    return df.select(F.to_json(F.struct(*[safe(f) for f in df.schema.fields]), {"ignoreNullFields": "false"}).alias(out))
