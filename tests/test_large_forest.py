"""Trees grown level by level against those a single task grows."""

from unittest import mock

import numpy as np
import pytest
from pyspark.sql import functions as F

from railtempo.operators import forest
from railtempo.operators.large_forest import LargeForest, drawn_rows
from railtempo.plans import training

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    """Skewed, rounded and constant columns, nulls, many equal rows, one far outlier."""
    rng = np.random.default_rng(3)
    a, b = rng.exponential(5, 900), rng.integers(0, 4, 900) / 2
    data = [(i, float(a[i]), None if i % 7 == 0 else float(b[i]), 1.0) for i in range(900)]
    data += [(i, 2.0, 0.5, 1.0) for i in range(900, 1300)] + [(1300, 900.0, -40.0, 1.0)]
    return spark.createDataFrame(data, "id long, a double, b double, c double").repartition(5).persist()


def scores(rows, model):
    return {r["id"]: r["score"] for r in forest.with_scores(rows, model).select("id", "score").collect()}


@pytest.fixture(scope="module")
def both(rows):
    return [forest.grow_forest(rows, COLUMNS, trees=7, max_samples=0.8, seed=5, rows_per_tree=most) for most in (5_000, 60)]


def test_same_sample(rows):
    drawn = drawn_rows(rows, COLUMNS, 6, 700, "id", 9).select("x", F.explode("trees").alias("tree"))
    plain = forest.tree_samples(rows, COLUMNS, 1301, 6, 700, "id", 9).select("x", "tree")
    assert drawn.exceptAll(plain).isEmpty() and plain.exceptAll(drawn).isEmpty() and drawn.count() == 6 * 700


def test_same_trees_as_one_task(rows, both):
    small, large = both
    assert not isinstance(small, LargeForest) and isinstance(large, LargeForest) and large.subtrees.count() > 7 * 5
    one, other = scores(rows, small), scores(rows, large)
    assert len(one) == len(other) == 1301
    assert max(abs(one[i] - other[i]) for i in one) < 1e-12
    assert min(other, key=other.get) == 1300
    # every cut of the upper part is a cut of the whole trees
    inner = large.feature >= 0
    assert set(zip(large.feature[inner], large.cut[inner])) <= set(zip(small.feature, small.cut))


def test_rows_far_beyond_the_sample(spark, rows, both):
    """Many equal rows fall into one subtree and are split; values the trees never saw, nulls and repeated ids have scores too."""
    more = spark.range(4_000).selectExpr("id % 3 as id", "2.0D as a", "0.5D as b", "1.0D as c", "'x' as score").union(
        spark.sql("select -1L, 1e300D, null, double('-infinity'), null"))
    one, other = (sorted(r["score"] for r in forest.with_scores(more, m).collect()) for m in both)
    np.testing.assert_allclose(one, other, rtol=1e-12)
    assert len(other) == 4_001
    assert forest.with_scores(more.limit(0), both[1]).count() == 0


def test_prefixes_and_storage(spark, rows, both, tmp_path):
    one, other = (training.score_prefixes(rows, m, [2, 7]).orderBy("id").toPandas() for m in both)
    np.testing.assert_allclose(one[["s2", "s7"]], other[["s2", "s7"]], rtol=1e-12)
    both[1].threshold = -0.6
    training.save_forest(spark, both[1], str(tmp_path / "large"))
    loaded = training.load_forest(spark, str(tmp_path / "large"))
    assert loaded.threshold == -0.6 and scores(rows, loaded) == pytest.approx(scores(rows, both[1]), abs=1e-14)


def test_equal_rows_end_in_the_upper_part(spark):
    same = spark.range(500).selectExpr("id", "1.0D as a", "2.0D as b", "3.0D as c")
    model = forest.grow_forest(same, COLUMNS, trees=3, max_samples=400, rows_per_tree=50)
    assert not model.open.any() and (model.feature == -1).all()
    assert model.depth == pytest.approx(forest.unsuccessful_search(400))
    assert forest.with_scores(same, model).select("score").distinct().count() == 1
    assert forest.fit_forest(same, COLUMNS, trees=3, max_samples=400, rows_per_tree=50).metrics["train_samples"] == 500


def test_search_beyond_a_task(rows):
    grid = {"contamination": [0.05], "n_estimators": [3], "max_samples": ["auto", 0.8]}
    def small_tasks(*args, **options):
        return forest.grow_forest(*args, **options, rows_per_tree=300)

    with mock.patch.object(training, "grow_forest", small_tasks):
        found = training.forest_search(rows, rows.withColumns({c: F.lit(1.0) for c in ("headway_seconds", "dwell_time_seconds", "delay_seconds")}),
                                       grid, COLUMNS)
        assert found.count() == 2


def test_draws_equal_those_of_a_generator():
    from railtempo.operators.draws import first_draws

    rng = np.random.default_rng(4)
    paths = np.concatenate([np.arange(1, 300), rng.integers(1, 1 << 62, 300)])
    n = np.arange(len(paths)) % 9 + 1
    for key in (7, 1 << 32, int(rng.integers(1 << 62))):
        number, unit = first_draws(key, paths, n)
        for i, (p, k) in enumerate(zip(paths.tolist(), n.tolist())):
            own = np.random.default_rng([key, p])
            assert (own.integers(k), own.random()) == (number[i], unit[i])


def test_hashes_of_trees_equal_sparks(spark):
    from railtempo.operators.draws import tree_hashes

    odd = spark.createDataFrame([(None, "é"), (-1, None), (1 << 62, ""), (0, "x" * 50)], "a long, b string").union(
        spark.range(40).selectExpr("id - 20", "string(id)"))
    for key in ("a", "b"):
        for seed in (0, 42, -3, 1 << 40):
            got = odd.select(F.xxhash64(key).alias("h"), F.transform(F.sequence(F.lit(0), F.lit(8)), lambda t: forest.unit_hash(F.col(key), t, F.lit(seed))).alias("u")).collect()
            np.testing.assert_array_equal(tree_hashes(np.array([r.h for r in got]), 9, seed) / float(1 << 40), [r.u for r in got])


def test_samples_take_no_row_for_each_tree(rows):
    """Hashes of rows and trees are counted and chosen in arrays: no plan makes rows times trees."""
    drawn = drawn_rows(rows.drop("id").withColumn("id", F.lit(None).cast("string")), COLUMNS, 6, 700, "id", 9)
    plan = drawn._jdf.queryExecution().toString()
    assert "explode" not in plan and plan.count("xxhash64") <= 2 * plan.count("xxhash64(id")
    assert drawn.select(F.explode("trees").alias("tree")).groupBy("tree").count().filter("count = 700").count() == 6


def test_walk_equals_steps_one_by_one():
    from railtempo.operators.large_forest import walk

    rng = np.random.default_rng(2)
    x = np.column_stack([rng.exponential(5, 500), rng.integers(0, 4, 500) / 3, np.full(500, 0.1)])
    x[3, 0], x[5, 1] = np.inf, np.nan
    nodes = forest.grow_tree(x, 9, np.random.default_rng(1))
    rows_at, at = np.array([4, 4, 3, 5, 499, 0]), np.array([0, 1, 0, 0, 2, 0])
    want = []
    for r, n in zip(rows_at, at):
        while nodes["feature"][n] >= 0:
            n = nodes["low"][n] if x[r, nodes["feature"][n]] <= nodes["cut"][n] else nodes["high"][n]
        want.append(n)
    assert walk(nodes, x, at, rows_at).tolist() == want and at.tolist() == [0, 1, 0, 0, 2, 0]
    assert walk(nodes, x, at[:0], rows_at[:0]).tolist() == []


def test_nodes_cut_together_are_those_cut_one_by_one():
    """Equal rows, constant columns, infinities, NaN and limits: every node of the tree is what ``cut_of`` gives for the rows that reach it."""
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.exponential(5, 700), rng.integers(0, 4, 700) / 2, np.ones(700)])
    x[3, 0], x[4, 0], x[5, 1] = np.inf, -np.inf, np.nan
    key = forest.tree_key(np.random.default_rng(8))
    for limit, path, depth in ((10, 1, 0), (3, 1, 0), (9, 37, 5)):
        nodes = forest.grow_tree(x, limit, np.random.default_rng(8), path, depth)
        left = [(0, path, depth, np.arange(700))]
        while left:
            at, path_at, deep, rows_at = left.pop()
            cut = None if deep >= limit or len(rows_at) < 2 else forest.cut_of(key, path_at, x[rows_at].min(axis=0), x[rows_at].max(axis=0))
            if cut is None:
                assert nodes["feature"][at] == -1 and nodes["depth"][at] == deep + forest.unsuccessful_search(len(rows_at))
                continue
            assert (nodes["feature"][at], nodes["cut"][at]) == cut
            below = x[rows_at, cut[0]] <= cut[1]
            left += [(nodes["low"][at], 2 * path_at, deep + 1, rows_at[below]), (nodes["high"][at], 2 * path_at + 1, deep + 1, rows_at[~below])]


def test_many_small_trees_stay_off_the_driver(rows):
    """Trees that each fit a task but not the driver together are kept as subtrees, with the scores of those that are not."""
    one = forest.grow_forest(rows, COLUMNS, trees=7, max_samples=0.8, seed=5)
    other = forest.grow_forest(rows, COLUMNS, trees=7, max_samples=0.8, seed=5, rows_in_all=5_000)
    assert not isinstance(one, LargeForest) and isinstance(other, LargeForest) and len(other.feature) == 7
    first, second = scores(rows, one), scores(rows, other)
    assert max(abs(first[i] - second[i]) for i in first) < 1e-12


def test_columns_are_packed_exactly():
    import pandas as pd

    from railtempo.operators.large_forest import kind_of, narrowed, widened

    x = np.array([[1.0, 300.0, 1e9, 0.5, 0.1, np.nan, 1e300], [-2.0, -5.0, 3.0, 2.0, 1 / 3, 1.0, -np.inf]])
    packed = narrowed(x)
    assert kind_of(packed).replace("|", "").replace("<", "") == "i1,i2,i4,f4,f8,f8,f8"
    pieces = pd.DataFrame({"kind": [kind_of(packed)] * 2, "data": [packed.tobytes(), packed[1:].tobytes()]})
    np.testing.assert_array_equal(widened(pieces), np.vstack([x, x[1:]]))
