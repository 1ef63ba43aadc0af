"""Isolation forest: bounded samples are drawn on Spark, one tree is grown per group, scoring is an Arrow function."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from railtempo.operators.draws import first_draws
from railtempo.operators.ranks import exact_percentiles
from railtempo.session import checkpointed

NODE_SCHEMA = "tree int, node int, feature int, cut double, low int, high int, depth double"


def unsuccessful_search(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def tree_key(rng: np.random.Generator) -> int:
    """The number from which all cuts of a tree are drawn."""
    return int(rng.integers(1 << 62))


def cut_of(key: int, path: int, low: np.ndarray, high: np.ndarray) -> tuple[int, float] | None:
    """(feature, cut) of the node at ``path`` (root 1, children 2p and 2p + 1) whose rows lie between ``low`` and ``high``; None if no
    feature can be cut. It depends on nothing else, so it makes no difference who grows the node."""
    usable = np.flatnonzero(low < high)
    if not len(usable):
        return None
    rng = np.random.default_rng([key, path])
    f = int(usable[rng.integers(len(usable))])
    cut = float(low[f] + rng.random() * (high[f] - low[f]))
    return f, cut if low[f] <= cut < high[f] else float(low[f])


def cuts_of(key: int, paths: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``cut_of`` for many nodes: features and cuts; ``low`` and ``high`` have a row for each column and a column for each node, all of which
    can be cut."""
    usable = low < high
    number, unit = first_draws(key, paths, usable.sum(axis=0))
    f = (np.cumsum(usable, axis=0) > number).argmax(axis=0)
    at = np.arange(len(f))
    low, high = low[f, at], high[f, at]
    with np.errstate(invalid="ignore", over="ignore"):
        cut = low + unit * (high - low)
        return f, np.where((low <= cut) & (cut < high), cut, low)


def grow_tree(x: np.ndarray, limit: int, rng: np.random.Generator, path: int = 1, depth: int = 0) -> dict[str, np.ndarray]:
    """Nodes of one isolation tree, or of its part below ``path``; ``feature`` is -1 in leaves, whose ``depth`` already holds the
    expected rest path. All nodes of a level are cut together; a node's children stand next to each other, after it."""
    key = tree_key(rng)
    with np.errstate(invalid="ignore", over="ignore"):
        short = x.astype("float32")
    x = np.ascontiguousarray((short if ((short == x) | np.isnan(x)).all() else x).T)  # the same values, half the bytes
    begin, paths, grown, levels = np.zeros(1, dtype="int64"), np.array([path]), 1, []
    while len(begin):
        size = np.diff(begin, append=x.shape[1])
        low, high = np.minimum.reduceat(x, begin, axis=1), np.maximum.reduceat(x, begin, axis=1)
        inner = np.flatnonzero((size > 1) & (low < high).any(axis=0)) if depth < limit else np.zeros(0, dtype="int64")
        level = {"feature": np.full(len(begin), -1), "cut": np.zeros(len(begin)), "low": np.full(len(begin), -1)}
        sizes, which = np.unique(size, return_inverse=True)
        level["depth"] = np.array([depth + unsuccessful_search(int(n)) for n in sizes])[which]
        f, cut = cuts_of(key, paths[inner], low[:, inner].astype("float64"), high[:, inner].astype("float64"))
        level["feature"][inner], level["cut"][inner], level["depth"][inner] = f, cut, 0.0
        level["low"][inner] = grown + 2 * np.arange(len(inner))
        levels.append(level)
        grown += 2 * len(inner)
        if not len(inner):
            break
        # the rows that go on, those below a cut before the others of their node
        size = size[inner]
        first = np.cumsum(size) - size
        place = np.arange(size.sum())
        at = place + np.repeat(begin[inner] - first, size)
        below = x.reshape(-1)[at + np.repeat(f * x.shape[1], size)] <= np.repeat(cut, size)
        left = np.add.reduceat(below, first, dtype="int64")
        order = np.empty(len(at), dtype="int64")
        for side, count, start in ((below, left, first), (~below, size - left, first + left)):
            order[place[:count.sum()] + np.repeat(start - (np.cumsum(count) - count), count)] = at[side]
        x = np.take(x, order, axis=1)
        begin, paths = np.ravel([first, first + left], "F"), np.ravel([2 * paths[inner], 2 * paths[inner] + 1], "F")
        depth += 1
    nodes = {k: np.concatenate([level[k] for level in levels]) for k in ("feature", "cut", "low", "depth")}
    return nodes | {"high": np.where(nodes["low"] >= 0, nodes["low"] + 1, -1)}


@dataclass
class Forest:
    """Trees as flat arrays, one after the other. Size is bounded by trees times twice the sample size."""

    columns: list[str]
    sample_size: int
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    depth: np.ndarray
    threshold: float | None = None
    contamination: float = 0.05
    version: str = "v1"
    metrics: dict[str, float] = field(default_factory=dict)

    def arrays(self) -> dict:
        """What scoring needs, as plain arrays that any worker can unpickle."""
        return {"roots": self.roots, "feature": self.feature, "cut": self.cut, "low": self.low, "high": self.high,
                "depth": self.depth, "norm": max(unsuccessful_search(self.sample_size), 1e-9)}


def tree_scores(arrays: dict, x: np.ndarray, trees: int | None = None, chunk: int = 2048) -> np.ndarray:
    """Scores in [-1, 0) from the mean path length: the lower, the more anomalous."""
    roots = arrays["roots"] if trees is None else arrays["roots"][:trees]
    feature, cut, low, high = (arrays[k] for k in ("feature", "cut", "low", "high"))
    out = np.empty(len(x))
    for begin in range(0, len(x), chunk):
        part = x[begin:begin + chunk]
        at = np.broadcast_to(roots, (len(part), len(roots))).copy()
        row = np.arange(len(part))[:, None]
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            below = part[row, np.maximum(f, 0)] <= cut[at]
            at = np.where(inner, np.where(below, low[at], high[at]), at)
        out[begin:begin + chunk] = arrays["depth"][at].mean(axis=1)
    return -np.power(2.0, -out / arrays["norm"])


def vector_of(columns: list[str]) -> Column:
    """The columns as one array of doubles; nulls are 0."""
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])


def unit_hash(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / float(1 << 40)


def resolve_sample_size(max_samples: str | int | float, n: int) -> int:
    """``auto`` is 256, a fraction is that share of the rows."""
    if max_samples == "auto":
        wanted = 256
    elif isinstance(max_samples, float):
        wanted = int(max_samples * n)
    else:
        wanted = int(max_samples)
    return max(1, min(wanted, n))


def tree_samples(df: DataFrame, columns: list[str], n: int, trees: int, size: int, key: str, seed: int) -> DataFrame:
    """``size`` distinct rows per tree, chosen by hash: (tree, x).

    A hash filter first reduces the table to a pool of about four times what all trees need together; the pool's size
    does not depend on the table's.
    """
    pool_rows = min(n, 4 * trees * size)
    share = pool_rows / n
    pool = df.filter(unit_hash(F.col(key), F.lit(seed)) < 1.0 if share >= 1 else unit_hash(F.col(key), F.lit(seed)) < share)
    pool = pool.select(key, vector_of(columns).alias("x"))
    chance = min(1.0, (size * 1.15 + 6 * math.sqrt(size) + 20) / pool_rows)
    drawn = (
        # only the trees that a row is drawn for become rows
        pool.withColumn("tree", F.explode(F.filter(
            F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: unit_hash(F.col(key), t, F.lit(seed)) < chance)))
        .withColumn("_h", unit_hash(F.col(key), F.col("tree"), F.lit(seed)))
    )
    order = W.partitionBy("tree").orderBy("_h", key)
    return drawn.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= size).select("tree", key, "x")


def grow_forest(df: DataFrame, columns: list[str], trees: int = 100, max_samples: str | int | float = "auto",
                key: str = "id", seed: int = 42, rows_per_tree: int = 500_000, rows_in_all: int = 2_000_000) -> Forest:
    """Forest over ``columns`` (nulls count as 0). Only the trees themselves come to the driver.

    Trees over more than ``rows_per_tree`` rows, or ``rows_in_all`` together, grow level by level (``large_forest``) and stay
    distributed below their upper part.
    """
    n = df.count()
    if n == 0:
        raise ValueError("no rows to train on")
    size = resolve_sample_size(max_samples, n)
    if size > rows_per_tree or size * trees > rows_in_all:
        from railtempo.operators.large_forest import grow_large

        return grow_large(df, columns, trees, size, key, seed, rows_per_tree)
    samples = tree_samples(df, columns, n, trees, size, key, seed)
    limit = max(1, math.ceil(math.log2(max(size, 2))))

    def grow(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(group[0])
        x = np.stack(pdf.sort_values(key)["x"].to_numpy())
        nodes = pd.DataFrame(grow_tree(x, limit, np.random.default_rng([seed, tree])))[["feature", "cut", "low", "high", "depth"]]
        nodes.insert(0, "node", np.arange(len(nodes)))
        nodes.insert(0, "tree", tree)
        return nodes

    # the samples are small in bytes but growing is work: a fixed task count keeps them from being merged into one task
    tasks = min(trees, df.sparkSession.sparkContext.defaultParallelism)
    nodes = samples.repartition(tasks, "tree").groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas().sort_values(["tree", "node"])
    counts = nodes.groupby("tree").size().to_numpy()
    roots = np.concatenate(([0], np.cumsum(counts)[:-1]))
    shift = np.repeat(roots, counts)
    return Forest(
        columns=list(columns), sample_size=size, roots=roots.astype("int64"),
        feature=nodes["feature"].to_numpy("int64"), cut=nodes["cut"].to_numpy("float64"),
        low=nodes["low"].to_numpy("int64") + shift, high=nodes["high"].to_numpy("int64") + shift,
        depth=nodes["depth"].to_numpy("float64"),
    )


def with_scores(df: DataFrame, forest: Forest, out: str = "score", trees: int | None = None) -> DataFrame:
    if hasattr(forest, "subtrees"):
        from railtempo.operators.large_forest import large_scores

        return large_scores(df, forest, {out: trees or len(forest.roots)})
    shared = df.sparkSession.sparkContext.broadcast(forest.arrays())

    @F.pandas_udf("double")
    def score(*values: pd.Series) -> pd.Series:
        return pd.Series(tree_scores(shared.value, np.column_stack([v.to_numpy("float64") for v in values]), trees))

    return df.withColumn(out, score(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in forest.columns]))


def fit_forest(df: DataFrame, columns: list[str], contamination: float = 0.05, version: str = "v1", **options) -> Forest:
    """Grown forest with its score threshold and training metrics. The rows are scored once; only scores are kept."""
    forest = grow_forest(df, columns, **options)
    forest.contamination, forest.version = contamination, version
    scored = checkpointed(with_scores(df, forest).select("score"))
    forest.threshold = exact_percentiles(scored, "score", {"t": contamination}).first()["t"]
    forest.metrics = score_metrics(scored, forest.threshold).first().asDict()
    return forest


def score_metrics(scored: DataFrame, threshold: float | Column) -> DataFrame:
    """Row count, share below the threshold, mean and population deviation of the scores."""
    cut = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return scored.agg(
        F.count("*").cast("double").alias("train_samples"),
        F.avg(F.when(F.col("score") < cut, 1.0).otherwise(0.0)).alias("anomaly_rate"),
        F.avg("score").alias("score_mean"),
        F.stddev_pop("score").alias("score_std"),
        F.first(cut).alias("score_threshold"),
    )


def with_batch_severity(scored: DataFrame, floor: float | None = None) -> DataFrame:
    """Severity relative to the lowest score of the batch, which becomes 1.

    ``floor`` gives that lowest score from outside (a stream has no whole batch); severity is then held to [0, 1].
    """
    if floor is None:
        return scored.withColumn("severity", F.col("score") / scored.agg(F.min("score")).scalar())
    return scored.withColumn("severity", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") / floor)))


def forest_detections(df: DataFrame, forest: Forest, floor: float | None = None) -> DataFrame:
    """Rows scoring below the threshold as detections. Missing z-scores leave the kind to the other measures.

    The lowest score of the batch is below the threshold whenever any score is, so it is found among the detections; they
    are materialised for that instead of scoring everything twice. With ``floor`` the result stays lazy.
    """
    from railtempo.functions import scalar as fx
    from railtempo.operators.rules import as_detections

    found = with_scores(df, forest).filter(F.col("score") < forest.threshold)
    if floor is None:
        found = checkpointed(found)
    found = with_batch_severity(found, floor)
    have = set(df.columns)
    z = {c: F.col(c) if c in have else F.lit(None).cast("double") for c in ("headway_seconds_zscore", "dwell_time_seconds_zscore")}
    kind = fx.anomaly_kind(z["headway_seconds_zscore"], z["dwell_time_seconds_zscore"], F.col("delay_seconds"))
    return as_detections(found, kind, F.col("severity"), "isolation_forest", forest.version, forest.columns)
