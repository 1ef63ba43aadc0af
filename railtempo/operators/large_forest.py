"""Isolation forest whose trees have more sample rows than a task should hold.

The upper part of all trees grows level by level: one pass over the rows finds the ranges of all open nodes, with a partial aggregate.
A node that holds few enough rows becomes the root of a subtree, which one group grows to its end. Cuts are drawn from the
tree's key and the node's path, so the trees are those that a single task would have grown.

Every row visits every tree, so visits are not rows of Spark's: those of a batch to one node travel as one packed piece.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from railtempo.operators.draws import tree_hashes
from railtempo.operators.forest import Forest, cut_of, grow_tree, tree_key, unsuccessful_search, vector_of
from railtempo.session import checkpointed

# ``cut`` holds the depth in leaves, and a node's upper child stands after its lower one
SUBTREE = "node int, feature array<tinyint>, cut array<double>, low array<int>"
PIECE = "kind string, data binary"  # packed rows: a numpy type of one field per column, and the rows
PATHS = "chunk long, tree int, at binary, depth binary"  # of the rows ``at`` of a chunk of row numbers
CHUNK = 14  # row numbers of a chunk, as a power of two
DEPTH_UNIT = 2.0 ** 44  # depths are summed as whole numbers, so that their order makes no difference
BUCKETS = 4096  # of a hash, when the largest one of a sample is looked for
BUCKET_BITS = 28  # of the 40 bits of a hash, below its bucket


@dataclass
class LargeForest(Forest):
    """``Forest`` whose arrays hold the upper part; leaves marked in ``open`` go on in the row of ``subtrees`` that has their number."""

    open: np.ndarray | None = None
    subtrees: DataFrame | None = None
    subtree_rows: int = 500_000

    def arrays(self) -> dict:
        return super().arrays() | {"open": self.open}


def drawn_rows(df: DataFrame, columns: list[str], trees: int, size: int, key: str, seed: int) -> DataFrame:
    """(x, trees): rows and the trees whose sample they are in; ``size`` rows per tree, those with the smallest hashes.

    The last hash of each sample is bracketed by counts per bucket; only the rows of that bucket are ranked.
    Rows that repeat key and hash stand in the order of their values.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("_key"), vector_of(columns).alias("x"), F.xxhash64(F.col(key)).alias("_h"))

    def hashes(batches: Iterator[pa.RecordBatch], most: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        step = max(1, most // trees)
        for batch in batches:
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                yield part, tree_hashes(part["_h"].to_numpy(), trees, seed)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(trees * BUCKETS, dtype="int64")
        for _, h in hashes(batches):
            total += np.bincount(((h >> BUCKET_BITS) + np.arange(trees) * BUCKETS).ravel(), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"tree": (at // BUCKETS).astype("int32"), "_b": at % BUCKETS, "count": total[at]})

    counts = rows.select("_h").mapInArrow(counted, "tree int, _b long, count long").groupBy("tree", "_b").agg(F.sum("count").alias("count"))
    before = F.sum("count").over(W.partitionBy("tree").orderBy("_b")) - F.col("count")
    last = counts.withColumn("_before", before).filter((F.col("_before") < size) & (F.col("_before") + F.col("count") >= size)).collect()  # one row a tree
    limits, wanted = np.full(trees, BUCKETS), np.zeros(trees, dtype="int64")
    for r in last:
        limits[r["tree"]], wanted[r["tree"]] = r["_b"], size - r["_before"]
    shared = spark.sparkContext.broadcast(limits)

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, h in hashes(batches):
            row, tree = np.nonzero((h >> BUCKET_BITS) < shared.value)
            held, begin = np.unique(row, return_index=True)
            if len(held):
                ends = pa.array(np.append(begin, len(row)).astype("int32"))
                yield pa.RecordBatch.from_arrays([part["x"].take(pa.array(held)), pa.ListArray.from_arrays(ends, tree.astype("int32"))], ["x", "trees"])

    def edge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, h in hashes(batches):
            row, tree = np.nonzero((h >> BUCKET_BITS) == shared.value)
            if len(row):
                own = part.select(["_key", "x"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(tree.astype("int32")), pa.array(h[row, tree])], ["_key", "x", "tree", "_u"])

    schema = rows.select("_key", "x").schema.add("tree", T.IntegerType()).add("_u", T.LongType())
    order = W.partitionBy("tree").orderBy("_u", "_key", "x")
    left = F.array(*(F.lit(int(n)) for n in wanted))
    within = rows.mapInArrow(edge, schema).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= F.get(left, F.col("tree")))
    return rows.select("x", "_h").mapInArrow(below, "x array<double>, trees array<int>").union(within.select("x", F.array("tree")))


def walk(top: dict, x: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Nodes without children reached from the nodes ``at`` by the rows numbered ``rows``."""
    at, flat = at.copy(), np.ascontiguousarray(x).reshape(-1)
    going, node, begin = np.arange(len(at)), at, rows * x.shape[1]  # of the visits that are not at their end
    while True:
        feature = top["feature"][node]
        inner = np.flatnonzero(feature >= 0)
        if len(inner) < len(node):
            at[going] = node
            going, node, begin, feature = going[inner], node[inner], begin[inner], feature[inner]
        if not len(node):
            return at
        below = flat[begin + feature] <= top["cut"][node]
        node = np.where(below, top["low"][node], top["high"][node])


def narrowed(x: np.ndarray) -> np.ndarray:
    """The rows with each column in the smallest type that holds its values exactly."""
    columns = []
    for column in x.T:
        with np.errstate(invalid="ignore", over="ignore"):
            columns.append(next((c for c in map(column.astype, ("i1", "i2", "i4", "f4")) if (c == column).all()), column))
    out = np.empty(len(x), [(f"f{i}", c.dtype) for i, c in enumerate(columns)])
    for i, c in enumerate(columns):
        out[f"f{i}"] = c
    return out


def kind_of(rows: np.ndarray) -> str:
    return ",".join(rows.dtype[i].str for i in range(len(rows.dtype)))


def widened(pieces: pd.DataFrame) -> np.ndarray:
    """All rows of packed pieces, one after the other."""
    parts = []
    for kind, data in zip(pieces["kind"], pieces["data"]):
        rows = np.frombuffer(data, [(f"f{i}", k) for i, k in enumerate(kind.split(","))])
        parts.append(np.column_stack([rows[f].astype("float64") for f in rows.dtype.names]))
    return np.concatenate(parts)


def visits(batches: Iterator[pa.RecordBatch], top: dict, trees: int | None = None, most: int = 1_000_000) -> Iterator[tuple]:
    """(part, x, row, tree, node) for parts of the rows: all visits of rows to trees, those named in ``trees`` of the rows or the first
    ``trees``; ``row`` numbers the rows of the part. A part is within one chunk of row numbers, if the rows have such."""
    step = max(1, most // len(top["roots"]))
    for batch in batches:
        n = batch.num_rows
        ends = set(range(step, n, step)) | {n}
        if "_rid" in batch.schema.names:
            ends |= set((np.flatnonzero(np.diff(batch["_rid"].to_numpy() >> CHUNK)) + 1).tolist())
        begin = 0
        for end in sorted(ends - {0}):
            part = batch.slice(begin, end - begin)
            begin = end
            x = part["x"].flatten().to_numpy().reshape(part.num_rows, -1)
            if trees is None:
                row = np.repeat(np.arange(part.num_rows), part["trees"].value_lengths().to_numpy())
                tree = part["trees"].flatten().to_numpy().astype("int64")
            else:
                row, tree = np.repeat(np.arange(part.num_rows), trees), np.tile(np.arange(trees), part.num_rows)
            yield part, x, row, tree, walk(top, x, top["roots"][tree], row)


def by_node(node: np.ndarray, keep: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(node, numbers of its visits) among the visits ``keep``."""
    held = np.flatnonzero(keep)
    if len(held):
        held = held[np.argsort(node[held].astype("uint16") if node.max() < 1 << 16 else node[held], kind="stable")]
        for visit in np.split(held, np.flatnonzero(np.diff(node[held])) + 1):
            yield int(node[visit[0]]), visit


def node_ranges(rows: DataFrame, top: dict, width: int) -> DataFrame:
    """(node, n, lo0, hi0, ...) of the nodes marked open that rows reach."""
    shared = rows.sparkSession.sparkContext.broadcast(top)
    bounds = [f"{side}{i}" for i in range(width) for side in ("lo", "hi")]

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, row, _, node in visits(batches, shared.value):
            held = np.flatnonzero(shared.value["open"][node])
            if not len(held):
                continue
            held = held[np.argsort(node[held].astype("uint16") if node.max() < 1 << 16 else node[held], kind="stable")]
            first = np.flatnonzero(np.diff(node[held], prepend=-1))
            out = {"node": node[held][first], "n": np.diff(np.append(first, len(held)))}
            for i in range(width):
                values = x[row[held], i]
                out |= {f"lo{i}": np.minimum.reduceat(values, first), f"hi{i}": np.maximum.reduceat(values, first)}
            yield pa.RecordBatch.from_pydict(out)

    found = rows.mapInArrow(ranges, "node long, n long, " + ", ".join(f"{b} double" for b in bounds))
    return found.groupBy("node").agg(F.sum("n").alias("n"), *((F.min if b[:2] == "lo" else F.max)(b).alias(b) for b in bounds))


def grow_large(df: DataFrame, columns: list[str], trees: int, size: int, key: str, seed: int, subtree_rows: int) -> LargeForest:
    """Forest over samples of ``size`` rows per tree; a task holds at most ``subtree_rows`` of them.

    The driver holds the upper parts: for each tree some ``size / subtree_rows`` nodes a level. Nulls count as 0. A node that can't be
    cut (equal rows, or at the depth limit) ends in the upper part, however many rows it has.
    """
    rows = checkpointed(drawn_rows(df, columns, trees, size, key, seed))
    limit, width = max(1, math.ceil(math.log2(max(size, 2)))), len(columns)
    keys = [tree_key(np.random.default_rng([seed, t])) for t in range(trees)]
    top = {"roots": np.arange(trees), "feature": np.full(trees, -1), "cut": np.zeros(trees), "low": np.full(trees, -1), "high": np.full(trees, -1),
           "depth": np.zeros(trees), "open": np.ones(trees, dtype=bool)}
    tree, path, level, small = np.arange(trees), np.ones(trees, dtype="int64"), 0, []
    while top["open"].any():
        found = node_ranges(rows, top, width).collect()
        top["open"][:] = False
        cuts = []
        for r in sorted(found, key=lambda r: r["node"]):
            at = r["node"]
            if r["n"] <= subtree_rows:
                small.append(at)
                continue
            spans = np.array([r[f"lo{i}"] for i in range(width)]), np.array([r[f"hi{i}"] for i in range(width)])
            cut = None if level >= limit else cut_of(keys[tree[at]], int(path[at]), *spans)
            if cut is None:
                top["depth"][at] = level + unsuccessful_search(r["n"])
            else:
                cuts.append((at, *cut))
        if cuts:
            at, feature, cut = (np.array(c) for c in zip(*cuts))
            new = len(tree) + np.arange(2 * len(at))
            top["feature"][at], top["cut"][at], top["low"][at], top["high"][at] = feature, cut, new[::2], new[1::2]
            tree = np.append(tree, np.repeat(tree[at], 2))
            path = np.append(path, np.ravel([2 * path[at], 2 * path[at] + 1], "F"))
            blank = {"feature": -1, "cut": 0.0, "low": -1, "high": -1, "depth": 0.0, "open": True}
            for name, value in blank.items():
                top[name] = np.append(top[name], np.full(len(new), value))
        level += 1
    top["open"][small] = True
    depths = np.array([int(p).bit_length() - 1 for p in path])
    shared = df.sparkSession.sparkContext.broadcast(top)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, row, _, node in visits(batches, shared.value):
            packed, pieces = narrowed(x), [(at, visit) for at, visit in by_node(node, shared.value["open"][node])]
            if pieces:
                yield pa.RecordBatch.from_pydict({
                    "node": pa.array([at for at, _ in pieces], pa.int32()), "kind": [kind_of(packed)] * len(pieces),
                    "data": [packed[row[visit]].tobytes() for _, visit in pieces]})

    def grow(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at = int(group[0])
        nodes = grow_tree(widened(pdf), limit, np.random.default_rng([seed, int(tree[at])]), int(path[at]), int(depths[at]))
        cut = np.where(nodes["feature"] < 0, nodes["depth"], nodes["cut"])
        return pd.DataFrame({"node": [at], "feature": [nodes["feature"].astype("int8")], "cut": [cut], "low": [nodes["low"].astype("int32")]})

    # pieces are small in bytes but growing is work, as in grow_forest
    spread_rows = rows.mapInArrow(spread, f"node int, {PIECE}").repartition(tasks_for(df.sparkSession, len(small)), "node")
    subtrees = checkpointed(spread_rows.groupBy("node").applyInPandas(grow, SUBTREE))
    return LargeForest(list(columns), size, top["roots"], top["feature"], top["cut"], top["low"], top["high"], top["depth"],
                       open=top["open"], subtrees=subtrees, subtree_rows=subtree_rows)


def tasks_for(spark: SparkSession, groups: int) -> int:
    """Tasks for so many groups of work: not fewer than the session's partitions, which Spark would merge by their bytes."""
    return max(1, min(groups, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)))


def path_depths(rows: DataFrame, forest: LargeForest, trees: int) -> DataFrame:
    """(chunk, tree, at, depth) pieces: depths of rows (_rid, x) in the first ``trees`` trees. Rows meet the subtree they fall into in blocks
    of about ``subtree_rows``, so a subtree that many rows fall into is sent to several tasks."""
    spark, most = rows.sparkSession, forest.subtree_rows
    shared = spark.sparkContext.broadcast(forest.arrays())

    def positions(part: pa.RecordBatch) -> tuple[int, np.ndarray]:
        own = part["_rid"].to_numpy()
        return int(own[0] >> CHUNK), (own & ((1 << CHUNK) - 1)).astype("uint16")

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, row, tree, node in visits(batches, shared.value, trees):
            chunk, own = positions(part)
            pieces = [(int(t), visit) for t, visit in by_node(tree, ~shared.value["open"][node])]
            if pieces:
                units = np.rint(shared.value["depth"] * DEPTH_UNIT).astype("int64")
                yield pa.RecordBatch.from_pydict({
                    "chunk": [chunk] * len(pieces), "tree": pa.array([t for t, _ in pieces], pa.int32()),
                    "at": [own[row[v]].tobytes() for _, v in pieces], "depth": [units[node[v]].tobytes() for _, v in pieces]})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, node in visits(batches, shared.value, trees):
            at, n = np.unique(node[shared.value["open"][node]], return_counts=True)
            yield pa.RecordBatch.from_pydict({"node": at.astype("int32"), "n": n})

    counts = checkpointed(rows.mapInArrow(counted, "node int, n long").groupBy("node").agg(F.sum("n").alias("n")))
    blocks = np.ones(len(forest.feature), dtype="int64")
    for r in counts.collect():  # nodes of the upper part, as the driver holds them already
        blocks[r["node"]] = -(-r["n"] // most)
    split = spark.sparkContext.broadcast(blocks)

    def entering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, row, tree, node in visits(batches, shared.value, trees):
            chunk, own = positions(part)
            packed, pieces = narrowed(x), [(at, visit) for at, visit in by_node(node, shared.value["open"][node])]
            if pieces:
                yield pa.RecordBatch.from_pydict({
                    "node": pa.array([at for at, _ in pieces], pa.int32()), "block": pa.array([chunk % int(split.value[at]) for at, _ in pieces], pa.int32()),
                    "chunk": [chunk] * len(pieces), "tree": pa.array([int(tree[v[0]]) for _, v in pieces], pa.int32()),
                    "at": [own[row[v]].tobytes() for _, v in pieces], "kind": [kind_of(packed)] * len(pieces),
                    "data": [packed[row[v]].tobytes() for _, v in pieces]})

    def descend(inside: pd.DataFrame, subtree: pd.DataFrame) -> pd.DataFrame:
        if not len(inside):
            return pd.DataFrame({"chunk": [], "tree": [], "at": [], "depth": []})
        feature, cut, low = (np.asarray(subtree[k].iloc[0]) for k in ("feature", "cut", "low"))
        nodes, depth = {"feature": feature, "cut": cut, "low": low, "high": low + 1}, []
        units = np.where(feature < 0, np.rint(np.where(feature < 0, cut, 0) * DEPTH_UNIT), 0).astype("int64")
        for _, piece in inside.groupby(np.arange(len(inside)) // 64):  # some pieces at a time
            x = widened(piece)
            at = walk(nodes, x, np.zeros(len(x), dtype="int64"), np.arange(len(x)))
            ends = np.cumsum(piece["at"].map(len).to_numpy() // 2)
            depth += [d.tobytes() for d in np.split(units[at], ends[:-1])]
        return inside[["chunk", "tree", "at"]].assign(depth=depth)

    tasks = tasks_for(spark, int(blocks.sum()))
    inside = rows.mapInArrow(entering, f"node int, block int, chunk long, tree int, at binary, {PIECE}").repartition(tasks, "node", "block")
    needed = forest.subtrees.join(counts, "node").withColumn(
        "block", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / most) - 1).cast("int")))).drop("n").repartition(tasks, "node", "block")
    below = inside.groupBy("node", "block").cogroup(needed.groupBy("node", "block")).applyInPandas(descend, PATHS)
    return rows.mapInArrow(ended, PATHS).unionByName(below) if not forest.open[forest.feature < 0].all() else below


def large_scores(df: DataFrame, forest: LargeForest, tree_counts: dict[str, int]) -> DataFrame:
    """``df`` with a score column for each name: that of the first so many trees."""
    kept = checkpointed(df.withColumn("_rid", F.monotonically_increasing_id()))
    paths = path_depths(kept.select("_rid", vector_of(forest.columns).alias("x")), forest, max(tree_counts.values()))
    norm = max(unsuccessful_search(forest.sample_size), 1e-9)
    steps = sorted(set(tree_counts.values()))

    def summed(group: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        sums, seen = np.zeros((1 << CHUNK, len(steps)), dtype="int64"), np.zeros(1 << CHUNK, dtype=bool)
        for tree, at, depth in zip(pieces["tree"], pieces["at"], pieces["depth"]):
            rows = np.frombuffer(at, "uint16")  # each row once: a piece is of one tree
            sums[rows, np.searchsorted(steps, tree, side="right")] += np.frombuffer(depth, "int64")
            seen[rows] = True
        rows = np.flatnonzero(seen)
        total = np.cumsum(sums[rows], axis=1) / DEPTH_UNIT
        scores = {name: -np.power(2.0, -total[:, steps.index(t)] / t / norm) for name, t in tree_counts.items()}
        return pd.DataFrame({"_rid": (int(group[0]) << CHUNK) + rows} | scores)

    names = ", ".join(f"`{name}` double" for name in tree_counts)
    sums = paths.groupBy("chunk").applyInPandas(summed, f"_rid long, {names}")
    return kept.drop(*tree_counts).join(sums, "_rid").drop("_rid")
