"""Boosted trees: the same however rows are dealt, one Spark job for all rounds, closed forms, odd tables."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from gapline.operators import boosting as bo
from gapline.operators import models as md
from gapline.operators.trees import _codes
from gapline.sources.models import load_model, save_model


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (900, 3))
    y = 5 + 2 * x[:, 0] + np.sin(3 * x[:, 1]) + rng.normal(0, 0.05, 900)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))],
                               "id bigint, a double, b double, c double, y double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="x").transform(df).repartition(3).cache()


def _booster(**changed):
    given = {"loss": "squared", "rounds": 20, "depth": 4, "step": 0.1, "share": 0.8, "subset": "0.8", "seed": 1}
    return bo.Booster("x", "y", **given | changed)


def _predictions(model, rows):
    return np.array([r[0] for r in model.transform(rows).orderBy("id").select("prediction").collect()])


def test_tasks_that_exchange_sums_give_the_trees_of_one_task(rows, monkeypatch):
    marked = rows.withColumn("held", F.col("id") % 10 == 0)
    monkeypatch.setattr(bo, "MESSAGE_BYTES", 1024)
    one, many = (_booster(rounds=2, depth=3, held="held", task_rows=n).fit(marked) for n in (10_000, 300))
    assert [len(t.feature) for t in one.trees] == [len(t.feature) for t in many.trees] and one.getNumTrees == 2
    assert _predictions(one, rows) == pytest.approx(_predictions(many, rows), rel=1e-9)


@pytest.mark.parametrize("loss", ["squared", "absolute"])
def test_boosters_learn(rows, loss):
    model = _booster(loss=loss).fit(rows)
    y = np.array([r["y"] for r in rows.orderBy("id").collect()])
    assert np.mean(np.abs(y - _predictions(model, rows))) < 0.5 * np.mean(np.abs(y - y.mean()))


def test_the_number_of_spark_jobs_does_not_grow_with_the_rounds(spark, rows):
    def jobs(rounds):
        group = f"boosting {rounds}"
        spark.sparkContext.setJobGroup(group, group)
        model = _booster(rounds=rounds, depth=3).fit(rows)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert model.getNumTrees == rounds
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(30) == jobs(2) > 0


def test_rounds_follow_their_definition():
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (400, 2))
    y = x[:, 0] + 0.1 * rng.normal(0, 1, 400)
    y -= y.mean()
    cuts = [np.quantile(x[:, f], np.linspace(0, 1, 17)[1:-1]) for f in range(2)]
    codes, names, none = _codes(x, cuts), np.arange(400, dtype=np.uint64), np.zeros(400, bool)
    given = {"depth": 1, "step": 0.1, "share": 1.1, "tries": 2, "bins": 16, "seed": 1, "tolerance": 0.0, "unit": 1.0}
    for loss in ("squared", "absolute"):
        trees, _ = bo.boost(codes, y, names, none, lambda a: a, loss=loss, rounds=3, **given)
        guess = np.zeros(400)
        for r, tree in enumerate(trees):
            left = y - guess
            goal = y if r == 0 else 2 * left if loss == "squared" else np.where(left < 0, -1.0, 1.0)

            def error(f, c):
                side = codes[f] <= c
                return sum(((goal[s] - goal[s].mean()) ** 2).sum() for s in (side, ~side))

            f, c = min(((f, c) for f in range(2) for c in range(15)), key=lambda p: error(*p))
            assert error(tree.feature[0], tree.cut[0]) == pytest.approx(error(f, c))
            side = codes[tree.feature[0]] <= tree.cut[0]
            own = np.where(side, goal[side].mean(), goal[~side].mean()) * (0.1 if r else 1.0)
            assert tree.value[tree.place(codes)] == pytest.approx(own)
            guess += own


def test_the_best_round_is_the_last_kept(rows):
    noise = rows.withColumn("y", F.rand(3)).withColumn("held", F.col("id") % 4 == 0).cache()
    model = _booster(rounds=60, step=0.3, held="held").fit(noise)
    assert 1 <= model.getNumTrees < 60
    y, p = zip(*((r["y"], r["prediction"]) for r in model.transform(noise.filter("held")).collect()))
    longer = bo.BoostedModel("x", model.cuts, model.trees[:-1])
    q = [r["prediction"] for r in longer.transform(noise.filter("held")).collect()]
    if model.getNumTrees > 1:
        assert np.mean((np.array(y) - p) ** 2) < np.mean((np.array(y) - q) ** 2)


def test_constant_targets_single_rows_and_saving(spark, rows, tmp_path):
    assert set(_predictions(_booster(rounds=3).fit(rows.withColumn("y", F.lit(3.0))), rows)) == {3.0}
    one = rows.limit(1).cache()
    assert _predictions(_booster(rounds=3, share=1.1).fit(one), one) == pytest.approx([one.first()["y"]])
    with pytest.raises(ValueError):
        _booster().fit(rows.limit(0))
    model = md.fit(md.boosting(rounds=4, depth=3), rows.drop("x"), ["a", "b", "c"], "y")
    save_model(model, str(tmp_path / "m"), ["a", "b", "c"], spark)
    before, after = (md.predict(m, rows.drop("x")).select("id", "predicted").orderBy("id").collect()
                     for m in (model, load_model(str(tmp_path / "m"))))
    assert before == after and md.importances(spark, model, ["a", "b", "c"]).first()["feature"] == "a"
