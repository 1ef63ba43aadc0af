"""Late rows parted from a stream before they reach any state.

A row is late when it is older than the newest row of all earlier micro-batches less a delay. Late rows go to a table of their own,
all others to a table that the next query reads as a stream. Since none of its rows is behind the watermark of the
same delay, its windows lose nothing, and on-time and late rows together are the input.

The two queries take turns: the second runs with ``availableNow`` whenever the first has ended a run. Side by side, it could see some
files of a micro-batch before the others, and its watermark pass the rest.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from railtempo.sources.tables import batch_label

DELAY = "30 minutes"


def _newest_before(spark: SparkSession, path: str, checkpoint: str, batch_id: int) -> datetime | None:
    """The newest instant of the batches before this one; each batch's line also covers those before it."""
    if batch_id == 0:
        return None
    return spark.read.schema("newest timestamp").parquet(f"{path}/newest/{batch_label(checkpoint, batch_id - 1)}").first()["newest"]


def start_split(rows: DataFrame, path: str, checkpoint: str, ts: str = "timestamp", delay: str = DELAY, once: bool = False) -> StreamingQuery:
    """Writes each micro-batch's rows to ``<path>/on_time`` and ``<path>/late``, and its counts to ``<path>/counts``.

    The counts are observed while the rows are written, not by jobs of their own. A repeated micro-batch overwrites its own folders
    and finds the same limit again, so that rows never change sides. Rows without a time are late. Batches without rows write
    nothing but keep the limit.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark, label = batch.sparkSession, batch_label(checkpoint, batch_id)
        before = _newest_before(spark, path, checkpoint, batch_id)
        limit = F.lit(before).cast("timestamp") - F.expr(f"interval {delay}")
        seen = Observation()
        late = F.col(ts).isNull() | F.coalesce(F.col(ts).cast("timestamp") < limit, F.lit(False))
        parted = batch.withColumn("_late", late).observe(
            seen, F.count_if("_late").alias("late"), F.count_if(~F.col("_late")).alias("on_time"), F.max(F.col(ts).cast("timestamp")).alias("newest")).persist()
        try:
            parted.filter("not _late").drop("_late").write.mode("overwrite").parquet(f"{path}/on_time/batch={label}")
            parted.filter("_late").drop("_late").write.mode("overwrite").parquet(f"{path}/late/batch={label}")
        finally:
            parted.unpersist()
        got = seen.get
        newest = max((t for t in (before, got["newest"]) if t is not None), default=None)
        counts = spark.createDataFrame([(batch_id, got["on_time"], got["late"], newest)], "batch_id long, on_time long, late long, newest timestamp")
        counts.drop("newest").coalesce(1).write.mode("overwrite").parquet(f"{path}/counts/batch={label}")
        counts.select("newest").coalesce(1).write.mode("overwrite").parquet(f"{path}/newest/{label}")

    trigger = {"availableNow": True} if once else {"processingTime": "30 seconds"}
    return rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def on_time(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows on time as a stream; all that is there is one micro-batch."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{path}/on_time")


def late_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{path}/late")


def split_counts(spark: SparkSession, path: str) -> DataFrame:
    """(batch_id, on_time, late) of every micro-batch."""
    return spark.read.schema("batch_id long, on_time long, late long").option("recursiveFileLookup", True).parquet(f"{path}/counts")
