"""Quantiles, collinearity, neighbors and splits against numpy and by their invariants."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as some
from pyspark.sql import functions as F

from gapline.operators import encode, split, stats
from gapline.operators.nearest import nearest, oversample
from gapline.operators.quantiles import quantiles
from gapline.operators.scale import lookup_join


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(some.lists(some.floats(-1e6, 1e6), min_size=12, max_size=300),
       some.sampled_from([0.0, 0.05, 0.5, 0.92, 0.95, 1.0]))
def test_narrowed_quantile_equals_numpy(spark, values, p):
    rows = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = quantiles(rows, "v", {"q": p}, hot_rows=10, accuracy=50).first()["q"]
    assert got == pytest.approx(np.percentile(values, p * 100), rel=1e-9, abs=1e-9)


def test_quantile_of_nothing_is_one_null_row(spark):
    rows = spark.createDataFrame([], "v double")
    assert [tuple(r) for r in quantiles(rows, "v", {"q": 0.5}).collect()] == [(None,)]


def table(spark, seed=0, n=400):
    rng = np.random.default_rng(seed)
    x = rng.normal(3, 1, (n, 4))
    x[:, 2] = x[:, 0] * 0.9 + rng.normal(0, 0.3, n)
    rows = [tuple(map(float, r)) for r in x]
    return x, spark.createDataFrame(rows, "a double, b double, c double, d double")


def test_vif_equals_least_squares(spark):
    x, rows = table(spark)
    for centered in (False, True):
        m = x - x.mean(axis=0) if centered else x
        want = {}
        for i, name in enumerate("abcd"):
            others = np.delete(m, i, axis=1)
            fit = others @ np.linalg.lstsq(others, m[:, i], rcond=None)[0]
            want[name] = (m[:, i] ** 2).sum() / ((m[:, i] - fit) ** 2).sum()
        got = stats.variance_inflation(rows, list("abcd"), centered)
        assert got == pytest.approx(want, rel=1e-8)


def test_vif_of_tied_columns_is_infinite(spark):
    _, rows = table(spark)
    got = stats.variance_inflation(rows.withColumn("e", F.col("a") + F.col("b")), list("abde"))
    assert np.isinf([got["a"], got["b"], got["e"]]).all() and np.isfinite(got["d"])


def test_histogram_equals_numpy(spark):
    x, rows = table(spark)
    counts, edges = np.histogram(x[:, 0], 17)
    got = stats.histogram(rows, F.col("a"), 17).orderBy("bin").collect()
    assert [r["rows"] for r in got] == list(counts)
    assert [r["left"] for r in got] == pytest.approx(list(edges[:-1]))


@pytest.mark.parametrize("bucket_rows", [25, 10_000])
def test_nearest_equals_brute_force(spark, bucket_rows):
    rng = np.random.default_rng(3)
    points = rng.normal(0, 1, (300, 5))
    points[100:200] = points[0]          # a third of the rows are copies of one
    rows = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)],
                                 "id bigint, v array<double>")
    got = nearest(rows, rows, id_col="id", vector="v", k=4, exclude_self=True,
                  bucket_rows=bucket_rows).orderBy("query", "place").collect()
    d = ((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :4]
    assert [r["neighbor"] for r in got] == list(order.ravel())
    assert len(got) == 1200


@pytest.mark.parametrize("bucket_rows", [20, 10_000])
def test_nearest_stays_inside_its_group(spark, bucket_rows):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(0, 1, (240, 3)), 1)        # many equal distances
    x[:120] *= 50                                       # a far group of few rows to a cell
    kinds = ["far" if i < 120 else None if i % 40 == 0 else "near" for i in range(240)]
    rows = spark.createDataFrame([(i, g, [float(v) for v in p]) for i, (g, p) in enumerate(zip(kinds, x))],
                                 "id bigint, g string, v array<double>")
    got = nearest(rows.filter("id % 3 = 0"), rows, id_col="id", vector="v", k=3, exclude_self=True, group="g",
                  bucket_rows=bucket_rows).collect()
    for i in range(0, 240, 3):
        mine = sorted((float(((x[i] - x[j]) ** 2).sum()), j) for j in range(240)
                      if kinds[i] is not None and kinds[j] == kinds[i] and i != j)[:3]
        assert [r["neighbor"] for r in sorted((r for r in got if r["query"] == i), key=lambda r: r["place"])] == [
            j for _, j in mine]


def test_queries_travel_to_bands_and_not_to_rings(spark, monkeypatch):
    import gapline.operators.nearest as near

    rng, moved = np.random.default_rng(3), []
    points = rng.normal(0, 1, (600, 12)).round(1)
    rows = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id bigint, v array<double>")
    search = near._search_bands

    def seen(asked, *rest):
        moved.append(asked.select(F.sum(F.size("_bands"))).first()[0])
        return search(asked, *rest)

    monkeypatch.setattr(near, "_search_bands", seen)
    monkeypatch.setattr(near, "QUERY_BLOCK", 50)
    monkeypatch.setattr(near, "BASE_BLOCK", 7)
    got = near.nearest(rows, rows, id_col="id", vector="v", k=4, exclude_self=True, bucket_rows=10).collect()
    d = ((points[:, None] - points[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    want = {(i, p + 1, j) for i in range(600) for p, j in enumerate(np.lexsort((np.arange(600), d[i]))[:4])}
    assert {(r["query"], r["place"], r["neighbor"]) for r in got} == want
    # 60 rings or more, about 1,000 visits to rings a query would be 36,000; bands follow the cores.
    assert moved[0] <= 600 * 2 * (int((4 * spark.sparkContext.defaultParallelism) ** 0.5) + 2)


def test_nearest_of_nothing(spark):
    rows = spark.createDataFrame([(1, [1.0])], "id bigint, v array<double>")
    assert nearest(rows, rows.limit(0), id_col="id", vector="v").count() == 0
    assert nearest(rows.limit(0), rows, id_col="id", vector="v").count() == 0
    assert nearest(rows, rows, id_col="id", vector="v", exclude_self=True).count() == 0


def test_oversampling_fills_every_stratum(spark):
    _, rows = table(spark)
    rows = rows.withColumn("id", F.monotonically_increasing_id()).withColumn(
        "s", F.when(F.col("a") > 4, 1).when(F.col("a") > 3.5, 2).otherwise(0))
    sizes = {r[0]: r[1] for r in rows.groupBy("s").count().collect()}
    extra = oversample(rows, "s", ["a", "b"], "id")
    grown = {r[0]: r[1] for r in extra.groupBy("s").count().collect()}
    assert all(sizes[s] + grown.get(s, 0) == max(sizes.values()) for s in sizes)
    ends = rows.groupBy("s").agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
    assert extra.join(ends, "s").filter("b < lo or b > hi").count() == 0


def test_split_sides_share_nothing_and_keep_the_share(spark):
    rows = spark.range(500).withColumn("s", (F.col("id") % 7).cast("int"))
    parts = split.group_split(rows, "id", stratum="s")
    assert parts.count() == 500
    shares = parts.join(rows, "id").groupBy("s").agg(
        F.count_if("is_test").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    assert all(abs(r["t"] - 0.2 * r["n"]) <= 1 for r in shares)
    train, test = (split.take_side(rows, parts, "id", side) for side in (False, True))
    assert split.shared_keys(train, test, "id").count() == 0
    assert train.count() + test.count() == 500


def test_unseen_and_missing_categories(spark):
    train = spark.createDataFrame([("b", 1.0), ("a", 2.0), (None, 3.0), ("b", 5.0)], "k string, y double")
    other = spark.createDataFrame([("a",), ("z",), (None,)], "k string")
    fitted = encode.fit(train, ["k"], "y", prior=1)
    got = {r["k"]: r for r in encode.encode(other, fitted, codes={"k": "code"}, shares={"k": "share"},
                                            target_means={"k": "mean"}).collect()}
    assert (got["a"]["code"], got["z"]["code"], got[None]["code"]) == (0, None, 2)
    assert got["a"]["share"] == pytest.approx(1 / 3) and got[None]["share"] is None
    assert got["a"]["mean"] == pytest.approx((2.0 + 2.75) / 2)


def test_lookup_is_broadcast_only_when_small(spark):
    big, table_ = spark.range(100), spark.range(50).withColumn("x", F.col("id") * 2)
    small = lookup_join(big, table_, "id")._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = lookup_join(big, table_, "id", max_rows=10)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in small and "SortMergeJoin" in large


def test_only_rows_inside_a_bracket_are_ranked(spark, monkeypatch):
    from pyspark.sql import functions as F

    from gapline.operators import quantiles as q

    left = []
    step = q._step

    def counted(*args):
        found, rest = step(*args)
        left.append(rest.count())
        return found, rest

    monkeypatch.setattr(q, "_step", counted)
    df = spark.range(6000).select((F.col("id") % 2).alias("g"), (F.col("id") * 1.5).alias("v"))
    got = q.quantiles(df, "v", {"q": 0.5}, "g", hot_rows=100).orderBy("g").collect()
    assert [r["q"] for r in got] == [4498.5, 4500.0]
    assert left and max(left) < 60


def test_every_hot_key_is_found(spark):
    from pyspark.sql import functions as F

    from gapline.operators.scale import heavy_keys

    df = spark.range(30_000).select((F.col("id") % 12_000).alias("k"))
    assert len(heavy_keys(df, "k", hot_rows=1)) == 12_000


def test_neighbours_of_text_ids_and_one_row_strata(spark):
    from gapline.operators.nearest import oversample

    rows = [(f"AFC{i:03d}", s, float(i), float(i % 4)) for i, s in enumerate([0] * 20 + [1] * 7 + [2])]
    df = spark.createDataFrame(rows, "assetnum string, s int, a double, b double")
    made = {r["s"]: r["count"] for r in oversample(df, "s", ["a", "b"], "assetnum").groupBy("s").count().collect()}
    assert made == {1: 13, 2: 19}


def test_each_column_is_broadcast_by_its_own_size(spark):
    from pyspark.sql import functions as F

    from gapline.operators.encode import encode, fit

    df = spark.range(500).select((F.col("id") % 3).cast("string").alias("brand"), F.md5(F.col("id").cast("string")).alias("text"))
    fitted = fit(df, ["brand", "text"], max_rows=100)
    assert fitted.small == {"brand"}
    plan = encode(df, fitted, codes={"brand": "b"})._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_ranks_are_selected_through_several_narrowings(spark, monkeypatch):
    """Brackets stay far above `hot_rows` for rounds; heavy ties, two groups and a null group."""
    import numpy as np

    from gapline.operators import quantiles as q

    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(size=4000), "b": np.repeat([1.0, 2.0, 3.0], [1500, 1, 1500]), None: rng.integers(0, 40, 2000) * 1.0}
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    probs = {"p0": 0.0, "p3": 0.3, "p50": 0.5, "p92": 0.92, "p100": 1.0}
    rounds = []
    step = q._step
    monkeypatch.setattr(q, "_step", lambda *a: rounds.append(1) or step(*a))
    got = {r["g"]: [r[n] for n in probs] for r in q.quantiles(df, "v", probs, "g", hot_rows=20, accuracy=100).collect()}
    assert len(rounds) > 2
    for k, values in groups.items():
        assert np.allclose(got[k], np.quantile(values, list(probs.values())), rtol=0, atol=1e-12)
    near = {r["g"]: r["p50"] for r in q.quantiles(df, "v", {"p50": 0.5}, "g", exact=False).collect()}
    assert all(abs(near[k] - np.quantile(v, 0.5)) < 1 for k, v in groups.items())


def test_a_heavy_category_is_joined_where_it_is(spark):
    from gapline.operators.encode import fit_categories, Categories
    from gapline.operators.scale import split_join

    rows = spark.range(4_000).select("id", F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 10 == 1, None)
                                     .otherwise(F.concat(F.lit("c"), F.col("id") % 97)).alias("k"))
    table_ = spark.range(200_000).select(
        F.when(F.col("id") == 7, "hot").otherwise(F.concat(F.lit("c"), "id")).alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("left", "inner"):
        got = split_join(rows, table_, "k", how, hot_rows=500, max_rows=1_000)
        want = rows.join(table_, "k", how).select("id", "k", "v")
        assert sorted(got.select("id", "k", "v").collect(), key=lambda r: r["id"]) == sorted(
            want.collect(), key=lambda r: r["id"])
    # Two parts, and the lookup rows of the heavy key are a local table of one row.
    optimized = split_join(rows, table_, "k", hot_rows=500)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in optimized and optimized.count("LocalRelation") + optimized.count("LogicalRDD") >= 2
    # Without a heavy key, and beyond the bound, the rows are the same.
    for limits in ({"hot_rows": 5_000}, {"hot_rows": 0, "max_rows": 3}):
        assert split_join(rows, table_, "k", **limits).count() == 4_000
    fitted = Categories(fit_categories(rows, ["k"]), max_rows=3, hot_rows=500)
    wide = fitted.join(rows, "k", "share", "s")
    assert wide.columns == ["id", "k", "s"] and wide.filter("k is null and s is not null").count() == 0
    assert wide.filter("k = 'hot'").select("s").distinct().collect()[0][0] == pytest.approx(2000 / 3600)


def test_a_table_of_wide_rows_is_not_broadcast(spark):
    from gapline.operators.scale import bounded_rows

    wide_rows = spark.range(50).select("id", F.repeat(F.lit("x"), 1_000).alias("t"))
    assert bounded_rows(wide_rows, 100, 10_000) is None and bounded_rows(wide_rows, 49) is None
    assert bounded_rows(wide_rows, 100).count() == 50


def test_a_row_of_the_split_tells_the_sides_apart(spark):
    rows = spark.range(500).select(F.when(F.col("id") % 50 != 7, F.col("id") % 97).alias("device"), "id")
    sides = split.group_split(rows, "device", seed=5)
    want = {(r["device"], r["is_test"]) for r in sides.filter("device is not null").collect()}
    got = split.with_side(rows, "device", seed=5)
    assert {(r["device"], r["is_test"]) for r in got.filter("device is not null").collect()} == want
    assert got.count() == 500 and got.filter("device is null and is_test is null").count() == 10
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan.split("Subquery")[0]


def test_categories_that_are_all_heavy_need_no_count_of_the_rows(spark, monkeypatch):
    rows = spark.range(400).select("id", F.concat(F.lit("c"), F.col("id") % 20).alias("c"))
    fitted = encode.fit(rows, ["c"], max_rows=3, hot_rows=10)
    monkeypatch.setattr(encode, "split_join", lambda *a: pytest.fail("the rows are read again"))
    coded = encode.encode(rows, fitted, codes={"c": "code"})
    names = sorted(f"c{i}" for i in range(20))
    assert {(r["c"], r["code"]) for r in coded.collect()} == {(c, i) for i, c in enumerate(names)}
    # One light category: the rows are split as before.
    monkeypatch.undo()
    more = rows.unionByName(spark.sql("select 400L as id, 'd' as c"))
    coded = encode.encode(more, encode.fit(more, ["c"], max_rows=3, hot_rows=10), codes={"c": "code"})
    assert coded.filter("c = 'd' and code = 20").count() == 1 and coded.count() == 401
