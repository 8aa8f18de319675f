"""Models: closed forms, ensembles between their bases, saving and loading."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapline.operators import metrics as m
from gapline.operators import models as md
from gapline.sources.models import load_metadata, load_model, save_model


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 2, (240, 3))
    y = np.exp(1 + 0.3 * x[:, 0] - 0.1 * x[:, 1] + rng.normal(0, 0.1, 240))
    rows = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))],
                                 "id bigint, a double, b double, c double, y double")
    return x, y, rows.cache()


def test_ridge_equals_its_closed_form(data):
    x, y, rows = data
    model = md.fit(md.ridge(10.0), rows, ["a", "b", "c"], "y")
    got = [r["predicted"] for r in md.predict(model, rows).orderBy("id").collect()]
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    t = np.log1p(y)
    w = np.linalg.solve(z.T @ z + 10 * np.eye(3), z.T @ (t - t.mean()))
    assert got == pytest.approx(list(np.expm1(t.mean() + z @ w)), rel=1e-7)


def test_forest_comparison_ensembles_and_importance(spark, data):
    _, _, rows = data
    train, test = rows.filter("id % 5 <> 0"), rows.filter("id % 5 = 0")
    done = md.train_and_compare(
        {"ridge": md.ridge(1.0), "forest": md.forest(10, 5, 2)}, train, test, ["a", "b", "c"], "y",
        ensemble=["ridge", "forest"], keep=["id"])
    out = done.predictions.collect()
    for r in out:
        low, high = sorted((r["ridge"], r["forest"]))
        assert low - 1e-9 <= r["average"] <= high + 1e-9
        assert low - 1e-9 <= r["weighted"] <= high + 1e-9
    ranked = done.table().collect()
    assert [r["accuracy"] for r in ranked] == sorted((r["accuracy"] for r in ranked), reverse=True)
    assert {r["model"] for r in ranked} == {"ridge", "forest", "weighted", "average"}
    assert m.best_model(done.table()).first()["model"] == ranked[0]["model"]
    top = md.importances(spark, done.models["forest"], ["a", "b", "c"]).first()
    assert top["feature"] == "a"


def test_out_of_fold_covers_every_row_once(data):
    _, _, rows = data
    held = md.out_of_fold({"ridge": md.ridge(1.0)}, rows, ["a", "b"], "y", ["id"], folds=3)
    assert held.count() == 240 and held.select("id").distinct().count() == 240
    assert held.filter(F.col("ridge").isNull()).count() == 0


def test_stack_predicts_better_than_the_mean(data):
    _, _, rows = data
    fitted = md.stack({"ridge": md.ridge(1.0), "forest": md.forest(5, 4, 2)}, rows, ["a", "b", "c"],
                      "y", ["id"], folds=2)
    row = m.regression_metrics(fitted.predict(rows), "y", "predicted").first()
    assert row["r2"] > 0.8


def test_saved_model_predicts_the_same(spark, data, tmp_path):
    _, _, rows = data
    model = md.fit(md.forest(5, 4, 2), rows, ["a", "b"], "y")
    save_model(model, str(tmp_path / "m"), ["a", "b"], spark, accuracy=90.0)
    before = md.predict(model, rows).select("id", "predicted").orderBy("id").collect()
    after = md.predict(load_model(str(tmp_path / "m")), rows).select("id", "predicted").orderBy("id").collect()
    info = load_metadata(spark, str(tmp_path / "m")).first()
    assert before == after
    assert (info["features"], info["accuracy"], len(info["scaler_mean"])) == (["a", "b"], 90.0, 2)


def test_deeper_trees_than_mllib_grows_are_refused():
    with pytest.raises(ValueError):
        md.forest(depth=50)
    assert max(f["depth"] for f in (md.FOREST_EVENTS, md.FOREST_DEVICES, md.FOREST_TOP_FEATURES)) <= md.MAX_DEPTH


def test_training_rows_are_spread_up_only(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(md, "TASK_ROWS", 10)
    many = md._spread(spark.range(1000).repartition(3 * cores))
    one = md._spread(spark.range(1000).coalesce(1))
    assert (many.rdd.getNumPartitions(), one.rdd.getNumPartitions()) == (3 * cores, max(cores, 2))


def test_unknown_numbers_get_the_training_median(spark):
    from gapline.plans.training import filled

    train = spark.createDataFrame([(1.0, None), (3.0, None), (None, None)], "a double, b double")
    one, two = filled(train, [train.filter("a is null")], ["a", "b"])
    assert [tuple(r) for r in two.collect()] == [(2.0, 0.0)] and one.filter("a is null").count() == 0


def test_event_control_with_unknown_durations(spark):
    from gapline.plans import training as tr

    rows = [(i % 30, float(i % 7), None if i % 5 == 0 else float(i % 11), f"s{i % 3}", 20.0 + i % 13)
            for i in range(400)]
    events = spark.createDataFrame(rows, "device int, a double, b double, station string, gap_h double")
    out = tr.event_predictions(events, "device", ["a", "b"], "gap_h", md.ridge(1.0), 3, md.forest(4, 4, 1),
                               categories=["station"])
    assert out.count() > 50 and out.filter("predicted is null").count() == 0


def test_boosting_ends_early_and_says_when(data):
    _, _, rows = data
    limit = 60
    noise = rows.withColumn("y", F.lit(2.0) + F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 4), 16, 10) / 65536)
    early = md.fit(md.boosting(rounds=limit, depth=3, ids=["id"], held=0.25), noise, ["a", "b"], "y")
    assert 1 <= md.rounds_used(early) < limit
    # Nothing held back: all rounds run.
    none = md.fit(md.boosting(rounds=4, depth=2, ids=["id"], held=0.0), rows, ["a", "b"], "y")
    assert md.rounds_used(none) == 4


def test_a_stack_takes_models_that_are_fitted_already(data):
    _, _, rows = data
    learners = {"ridge": md.ridge(1.0), "small": md.boosting(rounds=3, depth=2)}
    ready = {"ridge": md.fit(learners["ridge"], rows, ["a", "b"], "y")}
    fitted = md.stack(learners, rows, ["a", "b"], "y", ["id"], folds=2, bases=ready)
    assert fitted.bases[md.BASE + "ridge"] is ready["ridge"] and md.BASE + "small" in fitted.bases
    assert md.rounds_used(fitted) is None
    assert fitted.predict(rows).filter("predicted is null").count() == 0
