"""Forests: the same trees however their nodes are dealt, importances without nodes, brute force, odd tables."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler

from gapline.operators import models as md
from gapline.operators import trees as tr


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (900, 3))
    y = 5 + 2 * x[:, 0] + np.sin(3 * x[:, 1]) + rng.normal(0, 0.05, 900)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="x").transform(df).repartition(3).cache()


def _forest(local_rows=None, **changed):
    given = {"trees": 4, "depth": 7, "min_leaf": 3, "bins": 32, "subset": "all", "seed": 1} | changed
    return tr.Forest("x", "y", local_rows=local_rows, **given)


def _predictions(model, rows):
    return np.array([r[0] for r in model.transform(rows).orderBy("a").select("prediction").collect()])


def test_nodes_split_by_all_tasks_or_by_one_give_the_same_trees(rows):
    whole, dealt = _forest().fit(rows), _forest(local_rows=60).fit(rows)
    assert [len(t.feature) for t in whole.trees] == [len(t.feature) for t in dealt.trees]
    assert _predictions(whole, rows) == pytest.approx(_predictions(dealt, rows), rel=1e-9)
    assert whole.featureImportances.toArray() == pytest.approx(dealt.featureImportances.toArray(), rel=1e-6)
    y = np.array([r["y"] for r in rows.orderBy("a").collect()])
    assert np.mean((y - _predictions(whole, rows)) ** 2) < 0.1 * y.var()


def test_importances_leave_the_nodes_where_they_are(rows, monkeypatch):
    want = _forest(depth=30, min_leaf=1).fit(rows).featureImportances.toArray()

    def refused(*a):
        raise AssertionError("nodes of a forest came to the driver")

    monkeypatch.setattr(tr, "ForestModel", refused)
    assert _forest(depth=30, min_leaf=1).importances(rows).toArray() == pytest.approx(want, rel=1e-9)
    assert want.argmax() == 0 and want.sum() == pytest.approx(1)
    assert md.top_features(rows.drop("x"), ["a", "b", "c"], "y", 2, md.forest(3, 30, 1)) == ["a", "b"]


def test_a_split_is_the_best_of_all(rng=np.random.default_rng(7)):
    codes = rng.integers(0, 6, (3, 80)).astype(np.uint8)
    y, w = rng.normal(0, 1, 80), rng.poisson(1.0, 80)
    codes, y, w = codes[:, w > 0], y[w > 0], w[w > 0]
    feature, cut, left, value, gains = tr.grow(codes, y, w, depth=1, min_leaf=5, bins=6, tries=3, rng=rng)

    def error(keep):
        mean = np.average(y[keep], weights=w[keep])
        return (w[keep] * (y[keep] - mean) ** 2).sum()

    every = {(f, c): error(codes[f] >= 0) - error(codes[f] <= c) - error(codes[f] > c)
             for f in range(3) for c in range(5) if w[codes[f] <= c].sum() >= 5 and w[codes[f] > c].sum() >= 5}
    best = max(every, key=every.get)
    assert (feature[0], cut[0]) == best and gains[best[0]] == pytest.approx(every[best])
    right = codes[best[0]] > best[1]
    assert value[left[0] + 1] == pytest.approx(np.average(y[right], weights=w[right]))


def test_constant_targets_single_rows_and_leaf_sizes(spark, rows):
    one = _forest().fit(rows.limit(1).cache())
    y = rows.limit(1).first()["y"]
    assert _predictions(one, rows.limit(1)) == pytest.approx([y])
    from pyspark.sql import functions as F
    flat = _forest(trees=2).fit(rows.withColumn("y", F.lit(3.0)))
    assert set(_predictions(flat, rows)) == {3.0} and [len(t.feature) for t in flat.trees] == [1, 1]
    assert _forest(subset="sqrt").tries(11) == 4 and _forest(subset="onethird").tries(11) == 4
    assert _forest(subset="0.8").tries(11) == 9 and _forest(subset="2").tries(11) == 2
