"""Hard negatives against all products, and trees on odd shapes."""

import math
import random

import numpy as np
import pytest
from oracle import connect

from railtempo.llm import negatives, queries


def plain(rows, anchors, positives=5, k=5, low=80, high=100):
    out = []
    for me, label, q in set(anchors):
        scored = [(sum(a * b for a, b in zip(q, v)), i, other) for i, other, v in set(rows) if i != me]
        best = sorted((-s, i) for s, i, other in scored if other == label)[:positives]
        for p, positive in best:
            p = -p
            hard = sorted((-s, i) for s, i, other in scored if other != label and low * p <= 100 * s <= high * p)[:k]
            out += [(me, positive, rank + 1, i, p, -s) for rank, (s, i) in enumerate(hard)]
    return sorted(out)


def table_rows(sf):
    rows = []
    for i, v, label in connect(sf).execute("select vec_id, embedding, label from embeddings").fetchall():
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        rows.append((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(x)) for x in v)))
    return rows


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_query(spark, sf):
    rows = table_rows(sf)
    got = queries.QUERIES["op12_hard_negatives"](spark, sf)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, [r for r in rows if r[0] % 100 == 0])


def test_small_blocks_cells_and_slices(spark):
    rng = random.Random(2)
    centres = [[rng.randint(-99, 99) for _ in range(4)] for _ in range(6)]
    rows = [(i, rng.randint(0, 3), tuple(c + rng.randint(-9, 9) for c in rng.choice(centres))) for i in range(400)]
    rows += [(1000 + i, 1, (50, 0, 0, 0)) for i in range(150)] + [(2000 + i, 2, (48, 0, 0, 0)) for i in range(9)]  # a hot vector, ties
    rows += [(3000, 1, (0, 0, 0, 0)), (3001, 2, (-5, -5, -5, -5))] + rows[:20]
    df = spark.createDataFrame(rows, "id long, label int, vector array<long>")
    asked = [r for r in rows if r[0] % 10 == 0]
    anchors = spark.createDataFrame(asked, df.schema)
    got = negatives.hard_negatives(df, anchors, 3, 4, block_rows=40, anchors_per_slice=25, cells=8, sample_rows=100)
    assert sorted(map(tuple, got.collect())) == plain(rows, asked, 3, 4)


def test_tree_prunes_and_finds_all():
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(30, 1, 8)) * 3_000 + rng.normal(size=(30, 60, 8)) * 40).reshape(-1, 8).astype(np.int64)
    ids, labels = np.arange(len(x)), rng.integers(0, 2, len(x))
    tree = negatives.CoverTree(ids, labels, x)
    opened = [0]
    bounds = tree._bounds

    def counted(nodes, q):
        opened[0] += len(nodes)
        low, high = bounds(nodes, q)
        for n, lo, hi in zip(nodes.tolist(), low, high):
            below, todo = [], [n]
            while todo:
                m = todo.pop()
                below += [] if tree.rows[m] is None else tree.rows[m].tolist()
                todo += tree.children[m].tolist()
            s = x[below] @ q.astype(np.int64)
            assert lo <= s.min() and s.max() <= hi
        return low, high

    tree._bounds = counted
    for me in range(0, len(x), 200):
        s = x @ x[me]
        for window in ((-math.inf, math.inf), (0.8 * s.max(), 0.9 * s.max()), (s.max() + 1, math.inf)):
            [got] = tree.best(x[me], 5, lambda i, c: c == 1, [window])
            assert got == sorted(((int(v), i) for i, v in enumerate(s) if labels[i] == 1 and window[0] <= v <= window[1]), key=lambda p: (-p[0], p[1]))[:5]
    assert opened[0] < 27 * len(tree.centre) / 4  # most nodes are never looked at
    assert tree.best(x[0], 0, lambda i, c: c == 1, []) == []


def test_odd_rows(spark):
    kind = "id long, label int, vector array<long>, rank string"
    rows = [(1, 0, [3, 4], "x"), (1, 0, [3, 4], "y"), (2, 0, [3, 4], None), (3, 1, [3, 3], "x"), (4, 1, [3], "x"), (5, None, [9, 9], "x"), (6, 1, None, "x"),
            (None, 1, [3, 4], "x"), (7, 1, [3, None], "x"), (8, 1, [], "x"), (9, 1, [3, 3, 0, 0], "x"), (1, 1, [3, 4], "x"), (10, 1, [2, 4, 7], "x")]
    df = spark.createDataFrame(rows, kind)
    got = negatives.hard_negatives(df, df.filter("id = 1 and label = 0"))
    # the only positive scores 25; rows with id 1 are no negatives
    assert sorted(map(tuple, got.collect())) == [(1, 2, 1, 10, 25, 22), (1, 2, 2, 3, 25, 21), (1, 2, 3, 9, 25, 21)]
    for a, b in ((df, df.limit(0)), (df.limit(0), df), (df.limit(0), df.limit(0))):
        assert negatives.hard_negatives(a, b).collect() == []
    big = spark.createDataFrame([(1, 0, [1 << 40]), (2, 0, [1]), (3, 1, [1]), (4, 0, [-(1 << 20)])], "id long, label int, vector array<long>")
    assert sorted(map(tuple, negatives.hard_negatives(big, big.filter("id in (1, 4)")).collect())) == [(1, 2, 1, 3, 1 << 40, 1 << 40)]
    odd = spark.createDataFrame([(1, [1.0, float("nan")], 1), (2, [1.0, float("-inf")], 1), (3, None, 1), (4, [0.5, -0.001], None), (5, [0.5, None], 1), (7, [0.5, -0.001], 9)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in queries.whole_vectors(odd).collect()] == [(7, 0, [128, -1])]
