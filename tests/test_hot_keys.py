"""Hot keys far more than the driver should hold: tasks follow the rows, lookups leave the broadcast."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gapline.operators import scale
from gapline.operators.devices import device_mtbf
from gapline.operators.history import with_history
from gapline.operators.quantiles import quantiles
from tests.test_history import TL, failures, spark_rows


def test_tasks_follow_the_rows_and_segments_stay_short(spark):
    rows = spark.range(60_000).select((F.col("id") % 3_000).alias("k"), "id")
    cold, hot = scale.split_hot(rows, "k", ["id"], hot_rows=8)
    assert cold.isEmpty() and hot.count() == 60_000
    # 60,000 / 8 = 7,500 tasks before.
    assert hot.rdd.getNumPartitions() <= max(spark.sparkContext.defaultParallelism, 2)
    cut = hot.groupBy("k", scale.SEGMENT).agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
    assert cut.agg(F.max("n")).first()[0] <= 8 and cut.count() <= scale.summaries(hot)
    spans = cut.orderBy("k", scale.SEGMENT).collect()
    assert all(a.high < b.low for a, b in zip(spans, spans[1:]) if a.k == b.k)


@pytest.mark.parametrize("hot_rows", [25, 4])
def test_many_hot_keys_are_joined_by_a_shuffle(spark, monkeypatch, hot_rows):
    rows = spark_rows(spark, failures(40, 5, hot_share=0.34)).withColumn(
        "device", F.when(F.col("device") != 2, F.col("device"))).localCheckpoint()

    def results(**limit):
        history = with_history(rows, TL, **limit)
        return [df.toPandas().sort_values(by, ignore_index=True) for df, by in (
            (history.select(sorted(history.columns)), "no"), (device_mtbf(rows, TL, {}, **limit), "device"))]

    plain = results()
    monkeypatch.setattr(scale, "MAX_LOOKUP_ROWS", 1)
    for a, b in zip(plain, results(hot_rows=hot_rows)):
        pd.testing.assert_frame_equal(a, b, rtol=1e-9, atol=1e-9)


def test_many_small_hot_groups_keep_brackets_only(spark, monkeypatch):
    from gapline.operators import quantiles as q

    df = spark.range(4_000).select((F.col("id") % 500).alias("g"), F.when(F.col("g") != 7, F.col("id") * 1.0).alias("v"))
    want = {r["g"]: r["p"] for r in df.groupBy("g").agg(F.percentile("v", F.lit(0.3)).alias("p")).collect()}
    kept, points = [], []
    grid, cut = q._grid, q.cut_lineage
    monkeypatch.setattr(q, "_grid", lambda rows, key, cells, *a: points.append(cells) or grid(rows, key, cells, *a))
    monkeypatch.setattr(q, "cut_lineage", lambda df: kept.append(df.columns) or cut(df))
    monkeypatch.setattr(scale, "MAX_LOOKUP_ROWS", 1)
    got = {r["g"]: r["p"] for r in quantiles(df, "v", {"p": 0.3}, "g", hot_rows=1).collect()}
    assert got.keys() == want.keys() and got[7] is None
    assert all(got[k] == pytest.approx(want[k]) for k in want if k != 7)
    assert max(points) <= 100 and not any("_grid" in c for c in kept)
