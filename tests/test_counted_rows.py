"""Full-row duplicates: only rows whose hash repeats are shuffled, and the counts stay exact."""

import pytest
from pyspark.sql import functions as F

from gapline.operators.cleaning import counted_rows, drop_duplicate_rows


@pytest.mark.parametrize("bits", [29, 15])
def test_copies_are_counted_with_chance_hits_nulls_and_odd_names(spark, bits):
    df = spark.range(12_000).select(
        (F.col("id") % 9_000).alias("a.b"), F.when(F.col("id") % 3 == 0, F.md5((F.col("id") % 9_000).cast("string"))).alias("t"),
        F.lit(None).cast("string").alias("z"), F.when(F.col("id") % 2 == 0, 0.0).otherwise(-0.0).alias("d"))
    got = sorted(tuple(r) for r in counted_rows(df, bits).select("`a.b`", "copies").collect())
    assert got == [(i, 2 if i < 3_000 else 1) for i in range(9_000)]


def test_rows_without_an_equal_are_not_shuffled(spark):
    df = spark.range(5_000).select("id", F.repeat(F.md5(F.col("id").cast("string")), 40).alias("text"))
    plan = drop_duplicate_rows(df)._jdf.queryExecution().optimizedPlan()
    once = plan.children().apply(0).toString()
    # Before, all rows went through one aggregate over every column.
    assert "Union" in plan.toString().splitlines()[0] and "Aggregate [id" not in once
    assert drop_duplicate_rows(df.union(df)).count() == 5_000
