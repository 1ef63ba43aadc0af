"""Connected components of an edge table by star contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railtempo.session import checkpointed


def _hang_on_smallest(edges: DataFrame) -> DataFrame:
    """One round: larger neighbours move to each node's smallest neighbour, then smaller ones do (edges have lo < hi)."""
    both = edges.union(edges.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
    least = both.groupBy("lo").agg(F.least(F.min("hi"), F.col("lo")).alias("m"))
    large = both.filter("hi > lo").join(least, "lo").select(F.col("m").alias("lo"), "hi").distinct()
    parent = large.groupBy("hi").agg(F.min("lo").alias("m"))
    small = large.join(parent, "hi")
    return small.select(F.col("m").alias("lo"), F.explode(F.array("lo", "hi")).alias("hi")).filter("lo < hi").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node that has an edge; the component is its smallest node.

    Alternating large and small stars: a few shuffles per round and a number of rounds that grows with the logarithm of
    the edges. A node with very many neighbours is only ever aggregated by ``min``, never gathered. Each round is
    checkpointed in the shared folder; only its size and a hash sum reach the driver.
    """
    edges = edges.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct()
    state = F.struct(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")))
    edges, before = checkpointed(edges), None
    while (now := edges.select(state.alias("s")).first()[0]) != before:
        edges, before = checkpointed(_hang_on_smallest(edges)), now
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        edges.select("lo", "lo").distinct())
