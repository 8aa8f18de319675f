"""Tasks of a booster exchange their sums by files, and by Spark where they share no folder."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapline.operators import boosting as bo


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (900, 3))
    y = np.sin(x[:, 0]) + x[:, 1] ** 2
    made = spark.createDataFrame([(int(i), r.tolist(), float(v)) for i, (r, v) in enumerate(zip(x, y))],
                                 "id bigint, a array<double>, y double")
    from pyspark.ml.functions import array_to_vector
    return made.withColumn("x", array_to_vector("a")).withColumn("held", F.col("id") % 7 == 0).cache()


def booster(rounds, task_rows, held="held"):
    return bo.Booster("x", "y", "squared", rounds, 3, 0.1, 0.8, "all", 5, held=held, task_rows=task_rows)


def same(a, b):
    assert len(a.trees) == len(b.trees)
    for s, t in zip(a.trees, b.trees):
        assert s.feature.tolist() == t.feature.tolist() and s.cut.tolist() == t.cut.tolist()
        assert s.value == pytest.approx(t.value, abs=1e-9)


def test_an_exchange_takes_no_second(spark, rows):
    one = booster(30, 10_000, None).fit(rows)
    began = time.monotonic()
    three = booster(30, 300, None).fit(rows)
    assert len(three.trees) == 30 and time.monotonic() - began < 60     # 120 exchanges
    same(one, three)
    shared = bo._mounted_folder(spark.sparkContext)
    assert not [x for x in os.listdir(shared) if x.startswith("boosting")]


def test_tasks_without_a_shared_folder_exchange_by_spark(rows, monkeypatch):
    monkeypatch.setattr(bo, "_mounted_folder", lambda context: "/proc/none")
    same(booster(2, 10_000).fit(rows), booster(2, 300).fit(rows))


def test_large_tables_go_to_several_tasks(rows, monkeypatch):
    seen = []
    monkeypatch.setattr(bo, "FILE_ROWS", 300)
    monkeypatch.setattr(bo, "_mounted_folder", lambda context: seen.append(bo.FILE_ROWS) or "/proc/none")
    same(booster(1, None).fit(rows), booster(1, 10_000).fit(rows))
    assert seen
