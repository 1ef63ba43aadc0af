"""Small tables of settings, such as templates or weights, as DataFrames without Python on any executor."""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rows_of(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def sampled(df: DataFrame, about: int, *by: str, seed: int = 17) -> DataFrame:
    """Rows of about ``about`` (all of them, if there are fewer): those whose hash of ``by`` is small enough.

    The share comes from a count, so no task sorts or gathers candidates from all others, whatever the table's size. For
    samples that models are fitted on; equal rows go together.
    """
    rows = df.count()
    if rows <= about:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(1 << 40)) < int(about / rows * (1 << 40)))
