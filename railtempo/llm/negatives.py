"""Hard negatives by inner product: cover trees over norm-augmented vectors, descended best first inside score windows.

A vector x of squared norm at most M gets one more component, sqrt(M - |x|^2). An anchor q gets a 0 there, so that the distance D of
q and a node's centre says everything about inner products: |q|^2 + M - 2 q.x = D^2. All vectors below a node lie within its covering
radius r of the centre, hence their products with q lie between (|q|^2 + M - (D + r)^2) / 2 and (|q|^2 + M - max(0, D - r)^2) / 2.
Nodes outside all windows, or below what is already found, are never opened; rows of opened leaves are compared in whole numbers.

The tree's top is a bounded net of centres that every task knows; below it each block of rows has a tree of its own.
"""

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railtempo.llm.settings import sampled
from railtempo.session import checkpointed

LEAF = 32  # rows that a node keeps without children
SHRINK = 0.6  # the covering radius from one level to the next


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; beyond 64 bits with Python's."""
    if x.size and q.size and int(np.abs(x).max()) * int(np.abs(q).max()) * len(q) >= 1 << 62:
        return x.astype(object) @ q.astype(object)
    return x @ q


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    """Rows with the component that brings their squared norm to ``most``."""
    x = x.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(0, most - (x * x).sum(1)))])


class CoverTree:
    """Nodes level by level over the rows of one block; each has a centre, a covering radius and rows or children."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        squares = (x.astype(np.float64) ** 2).sum(1)
        self.most = float(squares.max()) if len(x) else 0.0
        self.wide = augmented(x, self.most)
        self.blur = 1e-7 * math.sqrt(self.most)  # distances come from products; different rows are at least 1 apart
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.rows: list[np.ndarray | None] = []
        self.children: list[np.ndarray] = []
        if len(x):
            every = np.arange(len(x))
            far = self._distance(self.wide, 0)
            level = [(self._node(0, every, far), every, far, float(far.max()))]
            while level:
                level = [below for node in level for below in self._split(*node)]
        self.points = self.wide[self.centre] if self.centre else np.empty((0, 1))
        self.radii = np.array(self.radius)

    def _distance(self, wide: np.ndarray, to: int) -> np.ndarray:
        """From augmented rows, whose norms are all equal, to one of them."""
        d = np.sqrt(2 * np.maximum(0, self.most - wide @ self.wide[to]))
        return np.where(d <= self.blur, 0, d)

    def _node(self, centre: int, rows: np.ndarray, far: np.ndarray) -> int:
        self.centre.append(centre)
        self.radius.append(float(far.max()) + self.blur)
        small = len(rows) <= LEAF or not far.any()
        self.rows.append(rows if small else None)
        self.children.append(np.empty(0, np.int64))
        return len(self.centre) - 1

    def _split(self, node: int, rows: np.ndarray, far: np.ndarray, reach: float) -> Iterator[tuple]:
        """Children with smaller reach: a net of centres, the node's own first, each the farthest from those before; rows go to the nearest."""
        if self.rows[node] is not None:
            return
        reach = min(reach, self.radius[node]) * SHRINK
        nearest, owner, centres, wide = far.copy(), np.zeros(len(rows), np.int64), [self.centre[node]], self.wide[rows]
        while nearest.max() > reach:
            centres.append(int(rows[nearest.argmax()]))
            new = self._distance(wide, centres[-1])
            closer = new < nearest
            nearest[closer], owner[closer] = new[closer], len(centres) - 1
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(len(centres) + 1))
        below = []
        for i, c in enumerate(centres):
            part = order[cuts[i]:cuts[i + 1]]
            below.append((self._node(c, rows[part], nearest[part]), rows[part], nearest[part], reach))
        self.children[node] = np.array([b[0] for b in below])
        yield from below

    def _bounds(self, nodes: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product with anything below each node, widened by what rounding may take."""
        norm = float(q @ q) + self.most
        d, r = np.sqrt(((self.points[nodes] - np.append(q, 0.0)) ** 2).sum(1)), self.radii[nodes]
        slack = 1e-9 * norm + 1e-6
        return (norm - (d + r) ** 2) / 2 - slack, (norm - np.maximum(0, d - r) ** 2) / 2 + slack

    def best(self, q: np.ndarray, k: int, usable, windows: list[tuple[float, float]]) -> list[list[tuple[int, int]]]:
        """For each window (low, high) the first ``k`` (score, id) by falling score and rising id, of rows with low <= score <= high
        whose (ids, labels) are ``usable``."""
        found: list[list[tuple[int, int]]] = [[] for _ in windows]
        if not len(self.x) or not windows or not k:
            return found
        least, most = (np.array([w[i] for w in windows], np.float64) for i in (0, 1))

        def wanted(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            floor = np.array([max(w, f[-1][0]) if len(f) == k else w for w, f in zip(least, found)], np.float64)
            return ((high[:, None] >= floor) & (low[:, None] <= most)).any(1)

        def verify(nodes: list[int]) -> None:
            rows = np.concatenate([self.rows[n] for n in nodes])
            rows = rows[usable(self.ids[rows], self.labels[rows])]
            scores = _products(self.x[rows], q)
            for w, f in zip(windows, found):
                inside = (scores >= (f[-1][0] if len(f) == k else w[0])) & (scores >= w[0]) & (scores <= w[1])
                if inside.any():
                    f += [(int(s), int(i)) for s, i in zip(scores[inside], self.ids[rows[inside]])]
                    f.sort(key=lambda p: (-p[0], p[1]))
                    del f[k:]

        # the heap holds the best child still to be visited of every opened node; its siblings follow by falling bound
        as_float, heap = q.astype(np.float64), []

        def put(low: np.ndarray, high: np.ndarray, nodes: np.ndarray) -> None:
            if len(nodes):
                heapq.heappush(heap, (-high[0], int(nodes[0]), low, high, nodes))

        def visit(nodes: np.ndarray) -> None:
            low, high = self._bounds(nodes, as_float)
            met = np.flatnonzero(wanted(low, high))
            met = met[np.argsort(-high[met], kind="stable")]
            put(low[met], high[met], nodes[met])

        visit(np.zeros(1, np.int64))
        while heap:
            _, _, low, high, nodes = heapq.heappop(heap)
            # the best few siblings at a time: small leaves are compared together
            put(low[LEAF:], high[LEAF:], nodes[LEAF:])
            met = nodes[:LEAF][wanted(low[:LEAF], high[:LEAF])].tolist()
            if leaves := [n for n in met if self.rows[n] is not None]:
                verify(leaves)
            for n in met:
                if self.rows[n] is None:
                    visit(self.children[n])
        return found


def net(x: np.ndarray, size: int) -> np.ndarray:
    """At most ``size`` rows of x, each the farthest from those before."""
    chosen = [0]
    nearest = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < size and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Lists of whole numbers as rows of one width (the longest, by default); what a shorter list lacks is 0."""
    lists = column.to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), max(map(len, lists), default=0) if width is None else width), np.int64)
    for i, v in enumerate(lists):
        out[i, :len(v)] = v[:out.shape[1]]
    return out


def _placed(rows: DataFrame, centres: np.ndarray, most: float) -> DataFrame:
    """Adds the nearest centre and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = augmented(_matrix(batch.column("vector"), centres.shape[1] - 1), most)
            near, cell = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
            for c, centre in enumerate(centres):
                d = ((x - centre) ** 2).sum(1)
                cell[d < near], near = c, np.minimum(near, d)
            yield pa.record_batch([*batch.columns, pa.array(cell), pa.array(np.sqrt(near))], names=[*batch.schema.names, "cell", "far"])

    return rows.mapInArrow(run, "id bigint, label bigint, vector array<bigint>, cell bigint, far double")


def _searched(rows: DataFrame, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """(key, window, score, id): the first ``k`` rows of a block for each anchor and window.

    Both sides have a ``block``. A block's rows come first, make its tree, and its anchors stream past: a task holds one block and
    one batch of anchors.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    empty = F.array().cast("array<struct<low: bigint, high: bigint>>")
    both = rows.select("block", F.lit(0).alias("side"), F.lit(0).cast("bigint").alias("key"), "id", "label", "vector", empty.alias("windows")).union(
        anchors.select("block", F.lit(1), "key", "id", "label", "vector", "windows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, tree = None, [], None
        for batch in batches:
            names, sides = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((names[1:] != names[:-1]) | (sides[1:] != sides[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if a == b:
                    continue
                if names[a] != block:
                    block, parts, tree = names[a], [], None
                part = batch.slice(a, b - a)
                if sides[a] == 0:
                    parts.append(part)
                    continue
                if tree is None:
                    tree = _tree(parts)
                    parts = []
                out: list[tuple[int, int, int, int]] = []
                width = tree.x.shape[1]
                for key, me, label, q, windows in zip(*(part.column(c).to_pylist() for c in ("key", "id", "label", "vector", "windows"))):
                    q = np.array((q + [0] * width)[:width], np.int64)  # what one side lacks is 0, so adds nothing

                    def usable(ids, labels, me=me, label=label):
                        return (ids != me) & ((labels == label) if same else (labels != label))

                    got = tree.best(q, k, usable, [(w["low"], w["high"]) for w in windows] or [(-math.inf, math.inf)])
                    out += [(key, n, s, i) for n, f in enumerate(got) for s, i in f]
                if out:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=["key", "window", "score", "id"])

    sent = both.withColumn("_task", F.pmod(F.xxhash64("block"), F.lit(tasks)).cast("int"))
    return sent.repartitionById(tasks, "_task").sortWithinPartitions("block", "side", "key").drop("_task").mapInArrow(
        run, "key bigint, window bigint, score bigint, id bigint")


def _tree(parts: list[pa.RecordBatch]) -> CoverTree:
    if not parts:
        return CoverTree(np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 0), np.int64))
    table = pa.Table.from_batches(parts).combine_chunks()
    ids, labels, x = table["id"].to_numpy(), table["label"].to_numpy(), _matrix(table["vector"].combine_chunks())
    own = np.unique(np.column_stack([ids, labels, x]), axis=0, return_index=True)[1]  # repeated rows count once
    return CoverTree(ids[own], labels[own], x[own])


def _first(found: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, block_rows: int = 2_048,
    anchors_per_slice: int = 16_384, cells: int = 64, sample_rows: int = 4_096,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows of (id, label, vector of whole numbers).

    Scores are inner products; higher come first, then smaller ids. An anchor's positives are its first ``positives`` other rows of its
    label; for each of them the first ``negatives`` rows of other labels with low * p <= 100 * score <= high * p are returned.

    Positives are looked for in the blocks of the anchor's label, negatives in blocks of ``block_rows`` rows around centres of the
    top net (``cells`` of them at most, chosen from about ``sample_rows`` rows; they only steer pruning) whose bounds meet the
    anchor's windows. Hot labels and cells are so many blocks; many anchors of a block are cut into slices. The net and one line a
    cell are all that reaches the driver.

    Rows with a null in any column or in the vector take no part. Rows and anchors repeated in all three columns count once; rows that share an
    id are never each other's positive or negative. Shorter vectors lack nothing but zeros. Products should stay within
    64 bits. Other columns are not looked at; no anchors, or no rows, give an empty result.
    """
    spark = vectors.sparkSession
    whole = F.col("label").isNotNull() & F.col("id").isNotNull() & ~F.exists("vector", lambda v: v.isNull())
    kinds = [F.col("id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), F.col("vector").cast("array<bigint>").alias("vector")]
    rows = vectors.select(*kinds).filter(whole)
    key = F.xxhash64("id", "label", "vector").alias("key")
    asked = checkpointed(anchors.select(*kinds).filter(whole).select(key, "id", "label", "vector").dropDuplicates(["key"]))
    norm = F.aggregate("vector", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    size = rows.agg(F.count("*").alias("n"), F.max(norm).alias("most"), F.max(F.size("vector")).alias("width")).first()
    most, count = size["most"] or 0.0, asked.count()
    slices = max(1, -(-count // anchors_per_slice))
    wanted = min(cells, max(1, -(-size["n"] // block_rows)))
    some = sampled(rows, sample_rows, "id").select("vector").limit(2 * sample_rows).toArrow().column(0).combine_chunks()
    width = size["width"] or 0
    centres = net(augmented(_matrix(some, width), most) if len(some) else np.zeros((1, width + 1)), wanted)
    placed = checkpointed(_placed(rows, centres, most))
    # a slice of the anchors meets its own copy of a block; no slice has more than so many anchors
    part, slice_ = F.pmod(F.xxhash64("id"), F.col("parts")), F.pmod(F.col("key"), F.lit(slices))

    def blocks(by: str) -> DataFrame:
        return placed.groupBy(by).agg(F.ceil(F.count("*") / block_rows).alias("parts"), F.max("far").alias("reach"))

    def rows_in(sizes: DataFrame, by: str) -> DataFrame:
        return placed.join(sizes, by).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select(
            F.xxhash64(by, part, "_slice").alias("block"), "id", "label", "vector")

    def anchors_in(of: DataFrame, by: str) -> DataFrame:
        each = of.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
        return each.select(F.xxhash64(by, "_part", slice_.cast("int")).alias("block"), "key", "id", "label", "vector", "windows")

    everything = F.array().cast("array<struct<low: bigint, high: bigint>>").alias("windows")
    labels = blocks("label")
    near = _searched(rows_in(labels, "label"), anchors_in(asked.join(labels, "label").select("*", everything), "label"), positives, same=True)
    chosen = checkpointed(_first(near, positives, "key").select("key", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "rank"))
    # the window of a positive: whole scores from low / 100 to high / 100 of its own
    window = F.struct(F.expr(f"cast(ceil(cast({low} as decimal(38, 0)) * positive_score / 100) as bigint)").alias("low"),
                      F.expr(f"cast(floor(cast({high} as decimal(38, 0)) * positive_score / 100) as bigint)").alias("high"))
    windows = chosen.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", window.alias("w")))).alias("_w")).select(
        "key", F.transform("_w", lambda w: w["w"]).alias("windows"))
    by_cell = blocks("cell")
    known = by_cell.collect()  # a line for each of at most ``cells`` centres
    reach = _reachable(asked.join(windows, "key"), centres, most, {r["cell"]: (r["parts"], r["reach"]) for r in known})
    far = _searched(rows_in(by_cell, "cell"), anchors_in(reach, "cell"), negatives, same=False)
    ranked = _first(far, negatives, "key", "window").withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    met = chosen.withColumn("window", F.col("rank").cast("bigint") - 1).drop("rank").join(ranked, ["key", "window"])
    return met.join(asked.select("key", F.col("id").alias("anchor_id")), "key").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _reachable(asked: DataFrame, centres: np.ndarray, most: float, cells: dict[int, tuple[int, float]]) -> DataFrame:
    """Anchors with each cell whose bounds meet one of their windows."""
    names = np.array(sorted(cells), np.int64)
    parts, reach = (np.array([cells[c][i] for c in names.tolist()]) for i in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = _matrix(batch.column("vector"), centres.shape[1] - 1).astype(np.float64)  # what no row has adds nothing
            q, norm = np.column_stack([given, np.zeros(len(given))]), (given ** 2).sum(1) + most
            slack = 1e-9 * norm + 1e-6
            asked_for = batch.column("windows").to_pylist()
            most_windows = max(map(len, asked_for), default=0)
            low, high = np.full((len(q), most_windows), np.inf), np.full((len(q), most_windows), -np.inf)
            for i, ws in enumerate(asked_for):
                low[i, :len(ws)], high[i, :len(ws)] = [w["low"] for w in ws], [w["high"] for w in ws]
            meets = np.zeros((len(q), len(names)), bool)
            for j, c in enumerate(names.tolist()):
                d = np.sqrt(((q - centres[c]) ** 2).sum(1))
                least, top = (norm - (d + reach[j]) ** 2) / 2 - slack, (norm - np.maximum(0, d - reach[j]) ** 2) / 2 + slack
                meets[:, j] = ((top[:, None] >= low) & (least[:, None] <= high)).any(1)
            row, cell = np.nonzero(meets)
            taken = batch.take(pa.array(row, pa.int64()))
            yield pa.record_batch([*taken.columns, pa.array(names[cell]), pa.array(parts[cell].astype(np.int64))], names=[*batch.schema.names, "cell", "parts"])

    kind = "key bigint, id bigint, label bigint, vector array<bigint>, windows array<struct<low: bigint, high: bigint>>, cell bigint, parts bigint"
    return asked.select("key", "id", "label", "vector", "windows").mapInArrow(run, kind)
