"""Isolation forests: samples, features of a tree, draws with replacement, scores and fingerprints."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tendersift.operators import detectors, tree_growth

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def training(spark):
    rng = np.random.default_rng(3)
    data = [(f"t{i:03}", "w", *map(float, rng.normal(size=4))) for i in range(200)] + [("odd", "w", 40.0, 40.0, 40.0, 40.0)]
    return spark.createDataFrame(data, "transaction_id string, award_id string, a double, b double, c double, d double").repartition(4).cache()


def leaves(tree):
    return [n for n in tree if n[0] < 0]


def path(tree, x):
    at = 0
    while tree[at][0] >= 0:
        f, cut, lo, hi, _ = tree[at]
        at = lo if x[f] < cut else hi
    return tree[at][4]


@pytest.mark.parametrize("how", [{}, {"sample": 0.25}, {"sample": 1000}, {"tree_features": 2}, {"tree_features": 0.5, "bootstrap": True}])
def test_scores_equal_walked_paths(training, how):
    forest = detectors.fit_forest(training, NAMES, trees=12, seed=5, **how)
    size = {0.25: 50, 1000: 201}.get(how.get("sample"), 201)
    assert forest.sample == size and len(forest.trees) == 12
    used = [{n[0] for n in t if n[0] >= 0} for t in forest.trees]
    assert max(map(len, used)) <= (2 if "tree_features" in how else 4) and set().union(*used) == {0, 1, 2, 3}
    got = {r.transaction_id: r.score for r in detectors.forest_scores(training, forest).collect()}
    chance = float(tree_growth.average_path(size))
    for r in training.collect():
        mean = np.mean([path(t, [r[n] for n in NAMES]) for t in forest.trees])
        assert abs(got[r.transaction_id] - 2 ** -(mean / chance)) < 1e-12
    assert max(got, key=got.get) == "odd"


def test_fingerprint_tells_models_apart(training):
    fit = lambda **how: detectors.fit_forest(training, NAMES, trees=4, sample=32, **how).fingerprint()
    assert fit(seed=1) == fit(seed=1)
    assert len({fit(seed=1), fit(seed=2), fit(seed=1, bootstrap=True), fit(seed=1, tree_features=3)}) == 4


def test_draws_with_replacement_repeat_rows(spark):
    """All rows differ, so without depth limit each distinct row ends in a leaf of its own; repeats make leaves fewer."""
    df = spark.createDataFrame([(f"t{i}", "w", float(i)) for i in range(64)], "transaction_id string, award_id string, a double")
    whole, drawn = [np.mean([len(leaves(t)) for t in detectors.fit_forest(df, ["a"], 20, 64, 1, bootstrap=b).trees]) for b in (False, True)]
    assert drawn < 0.85 * whole


def test_settings_are_checked(training):
    for how in ({"sample": 0}, {"sample": 1.5}, {"tree_features": 0.0}):
        with pytest.raises(ValueError):
            detectors.fit_forest(training, NAMES, 2, **how)
    with pytest.raises(ValueError, match="one row"):
        detectors.fit_forest(training.limit(0), NAMES)


def table_of(forest):
    """Nodes by tree and number, from a forest in the driver."""
    out = {}
    for t, nodes in enumerate(forest.trees):
        todo = [(0, 1)]
        while todo:
            at, node = todo.pop()
            f, cut, lo, hi, depth = nodes[at]
            out[t, node] = (f, cut, round(depth, 9))
            todo += [(lo, 2 * node), (hi, 2 * node + 1)] if f >= 0 else []
    return out


@pytest.mark.parametrize("how", [{}, {"sample": 0.5}, {"tree_features": 2}])
def test_growth_by_levels_gives_the_same_trees(training, how):
    small = detectors.fit_forest(training, NAMES, trees=3, seed=9, **how)
    large = detectors.fit_forest(training, NAMES, trees=3, seed=9, most_rows=1, **how)
    assert isinstance(large, detectors.ForestTable) and large.sample == small.sample
    assert {(r.tree, r.node): (r.feature, r.cut, round(r.depth, 9)) for r in large.nodes.collect()} == table_of(small)
    a, b = [{r.transaction_id: r.score for r in detectors.forest_scores(training, f).collect()} for f in (small, large)]
    assert len(a) == 201 and all(abs(a[k] - b[k]) < 1e-12 for k in a)
    assert large.fingerprint() == detectors.fit_forest(training, NAMES, trees=3, seed=9, most_rows=1, **how).fingerprint()


def test_growth_by_levels_with_repeated_draws_and_equal_rows(spark):
    df = spark.createDataFrame([(f"t{i}", "w", float(i % 8), 1.0) for i in range(300)], "transaction_id string, award_id string, a double, b double")
    forest = detectors.fit_forest(df, ["a", "b"], 4, 300, 2, bootstrap=True, most_rows=10)
    sums = {r.tree: (r.rows, r.leaves) for r in forest.nodes.filter("feature < 0").groupBy("tree").agg(F.sum("size").alias("rows"), F.count("*").alias("leaves")).collect()}
    assert sums == {t: (300, 8) for t in range(4)}  # each value of a ends in one leaf, b never splits
    assert forest.nodes.filter("feature = 1").count() == 0


def test_draws_are_those_of_spark(spark):
    df = spark.createDataFrame([(t, n) for t in (0, 7) for n in (1, 2, 1 << 40)], "tree int, node bigint")
    for r in df.select("tree", "node", tree_growth.drawn(5, F.col("tree"), F.col("node"), 2).alias("u")).collect():
        assert r.u == tree_growth.drawn_here(5, r.tree, r.node, 2) and 0 < r.u <= 1
