"""Fixed-length row sequences per line and direction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from railtempo.functions.scalar import floor_div
from railtempo.operators.ranks import with_position

SEQUENCE_KEYS = ["line", "direction"]


def sliding_sequences(
    df: DataFrame,
    item_columns: list[str],
    length: int = 24,
    stride: int = 1,
    keys: list[str] | None = None,
    ts: str = "timestamp",
    tie: str = "id",
    block_rows: int = 4096,
) -> DataFrame:
    """Each window of ``length`` consecutive rows per key whose start is a multiple of ``stride``.

    Output: keys, ``start`` (position of the first row) and ``items`` (array of structs in order). Rows are numbered per
    key first; then blocks of ``block_rows`` positions, each with the first rows of the next block, are windowed, so that
    no task holds a whole key.
    """
    keys = keys or SEQUENCE_KEYS
    numbered = with_position(df.select(*dict.fromkeys([*keys, ts, tie, *item_columns])), keys, ts, tie)
    return windows_of(numbered, item_columns, length, stride, keys, block_rows)


def windows_of(numbered: DataFrame, item_columns: list[str], length: int, stride: int = 1, keys: list[str] | None = None,
               block_rows: int = 4096) -> DataFrame:
    """Sequences of rows that already carry their ``position`` per key."""
    keys = keys or SEQUENCE_KEYS
    if block_rows < length:
        raise ValueError("a block must hold at least one sequence")
    block = floor_div(F.col("position"), block_rows)
    lead_in = (F.col("position") % block_rows < length - 1) & (block > 0)
    blocks = numbered.select(*dict.fromkeys([*keys, "position", *item_columns])).withColumn(
        "_block", F.explode(F.when(lead_in, F.array(block, block - 1)).otherwise(F.array(block))))
    ahead = W.partitionBy(*keys, "_block").orderBy("position").rowsBetween(0, length - 1)
    items = F.collect_list(F.struct(*item_columns)).over(ahead)
    starts = (F.col("position") % stride == 0) & (block == F.col("_block"))
    return (
        blocks.withColumn("items", items)
        .filter(starts & (F.size("items") == length))
        .select(*keys, F.col("position").alias("start"), "items")
    )
