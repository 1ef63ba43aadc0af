"""Nearest neighbours where ids repeat, with the same and with different vectors."""

import numpy as np
import pytest

from railtempo.llm import ann


def plain_nearest(given, query, k):
    q, best = next(v for i, v in given if i == query), {}
    for i, v in given:
        if i != query:
            best[i] = max(best.get(i, -2), q @ v / np.sqrt((q @ q) * (v @ v)))
    return sorted(best, key=lambda i: (-best[i], i))[:k]


@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("copies", [2, 5, 40])
def test_repeated_ids_take_one_place(spark, same, copies):
    rng = np.random.default_rng(6)
    q = rng.normal(size=16)
    near = [q + rng.normal(size=16) * 0.01 * (i + 3) for i in range(20)]
    given = [(1, q)] + [(7, q + 0.001 * (np.ones(16) if same else rng.normal(size=16))) for _ in range(copies)] + [(100 + i, v) for i, v in enumerate(near)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in given], "vec_id bigint, embedding array<double>")
    for block in (8_192, 8):
        got = sorted(ann.nearest(df, df.filter("vec_id = 1"), 5, ann.CrossPolytope(tables=1, block=block)).collect(), key=lambda r: r["rank"])
        assert [r.vec_id for r in got] == plain_nearest(given, 1, 5)


def test_probing_counts_ids(spark):
    rng = np.random.default_rng(3)
    q = np.eye(8)[0]
    given = [(1, q)] + [(7, q + rng.normal(size=8) * 0.01) for _ in range(50)] + [(10 + i, v) for i, v in enumerate(-np.eye(8)[:5] - 0.1)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in given], "vec_id bigint, embedding array<double>")
    got = ann.nearest(df, df.filter("vec_id = 1"), 5, ann.CrossPolytope(tables=1, probes=1)).collect()
    assert len({r.vec_id for r in got}) == 5
