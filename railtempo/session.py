"""Session settings shared by tests, bench and jobs."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # keep cores busy on small inputs as well; large ones are cut by the advisory size
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a map built from repeated keys keeps the later entry
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def build_session(app: str = "railtempo", master: str | None = None, **extra: str) -> SparkSession:
    """Session with the settings above. ``extra`` keys use ``__`` for a dot."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def use_settings(spark: SparkSession) -> SparkSession:
    """Apply the result-relevant runtime settings to a session we did not build."""
    for key in ("spark.sql.session.timeZone", "spark.sql.mapKeyDedupPolicy"):
        spark.conf.set(key, SETTINGS[key])
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and materialised tables.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset (local tests) do we make a folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="railtempo-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def checkpointed(df):
    """Cut lineage through the shared checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(os.path.join(checkpoint_root(df.sparkSession), "rdd"))
    return df.checkpoint(eager=True)
