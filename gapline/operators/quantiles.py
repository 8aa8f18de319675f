"""Exact quantiles with linear interpolation, without gathering a big group in one task.

Groups up to HOT_ROWS use the built-in `percentile`. In a larger group each wanted rank is selected by narrowing: a
mergeable sketch gives GRID points of the group; the two around the rank bracket it; one pass counts what lies below
and on the ends, so the rank within the bracket is known. Rows strictly inside the bracket, about 3 in GRID, are kept
and narrowed again until a bracket has at most HOT_ROWS rows, which one task sorts. A value with many copies cannot stop
this: it becomes an end of a bracket, and ranks that fall on an end are answered. `exact=False` takes the sketch alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapline.operators.scale import HOT_ROWS, ONE_GROUP, Sides, cut_lineage, if_few, sides, union_parts

SKETCH_ACCURACY = 20_000   # rank error of a sketch point is 1/SKETCH_ACCURACY of the group
GRID = 1_000               # sketch points, and at most a tenth of the accuracy


def quantiles(df: DataFrame, value: str, probs: dict[str, float], by: str | None = None,
              hot_rows: int = HOT_ROWS, accuracy: int = SKETCH_ACCURACY, exact: bool = True,
              copied: bool = True) -> DataFrame:
    """One row per group (one row without `by`) with a column per named probability.

    Nulls are ignored; a group without values gives nulls. Without `exact` the values are within 1/accuracy of the wanted
    rank, from one mergeable aggregate. The values of hot groups are read three times: from a copy, or with `copied`
    off from `df` itself, which must then give the same rows each time and should be cheap to read.
    """
    if by is None:
        keyed = df.select(F.lit(0).alias(ONE_GROUP), value)
        out = quantiles(keyed, value, probs, ONE_GROUP, hot_rows, accuracy, exact, copied)
        # A global aggregate keeps its one row even when there is no input at all.
        return out.agg(*[F.max(n).alias(n) for n in probs])
    rows = df.select(by, F.col(value).cast("double").alias("_v"))
    if not exact:
        return rows.groupBy(by).agg(*[F.percentile_approx("_v", float(p), accuracy).alias(n) for n, p in probs.items()])
    found = sides(rows, by, hot_rows, "_v")
    cold = found.cold.groupBy(by).agg(*[F.percentile("_v", F.lit(p)).alias(n) for n, p in probs.items()])
    return cold if found.hot is None else union_parts(cold, _narrowed(found, by, probs, accuracy, hot_rows, copied))


def _narrowed(sized: Sides, by: str, probs: dict[str, float], accuracy: int, hot_rows: int,
              copied: bool) -> DataFrame:
    """Quantiles of hot groups, from one copy of their values or without one.

    What is known of a group joins its values by broadcast while the groups are few, else by a shuffle.
    """
    rows = sized.hot.filter(F.col("_v").isNotNull()).select(F.col(by).alias("_key"), "_v")
    rows = cut_lineage(rows) if copied else rows
    # Hardly more points than the largest group has rows, but enough that every bracket narrows.
    cells = _cells(min(accuracy, 10 * max(sized.largest, 100)))
    groups, targets = sized.keys, sized.keys * 2 * len(probs)
    wanted = []
    for i, p in enumerate(probs.values()):
        rank = F.lit(float(p)) * (F.col("_n") - 1)
        wanted += [F.struct(F.lit(2 * i).alias("_t"), F.floor(rank).alias("_k")),
                   F.struct(F.lit(2 * i + 1).alias("_t"), F.ceil(rank).alias("_k"))]
    grid = _grid(rows, ["_key"], cells, accuracy).select("_key", "_n", "_grid", F.array(*wanted).alias("_wanted"))
    # One row per hot group; of its points only the brackets are kept.
    marks = cut_lineage(grid.select("_key", "_n", "_wanted", F.transform(
        "_wanted", lambda w: _bracket(w["_t"], w["_k"], F.col("_n"), F.col("_grid"), cells)).alias("_brackets")))
    ranks = marks.select("_key", "_n", F.inline("_wanted"))
    tagged = rows.join(if_few(marks.select(F.col("_key").alias("_same"), "_brackets"), groups),
                       F.col("_key").eqNullSafe(F.col("_same")))
    found, rest = _step(tagged, ranks.drop("_n"), 2 * len(probs), targets)
    while not rest.isEmpty():
        rest = cut_lineage(rest)
        sizes = cut_lineage(rest.groupBy("_key", "_t").agg(F.count("_v").alias("_n"), F.first("_k").alias("_k")))
        large = sizes.filter(F.col("_n") > hot_rows)
        small = rest if large.isEmpty() else _only(rest, sizes.filter(F.col("_n") <= hot_rows), targets)
        place = F.row_number().over(Window.partitionBy("_key", "_t").orderBy("_v"))
        found = found.unionByName(small.withColumn("_place", place).filter(F.col("_place") == F.col("_k") + 1).select(
            "_key", "_t", "_v"))
        if large.isEmpty():
            break
        hot = _only(rest, large, targets)
        grid = _grid(hot, ["_key", "_t"], cells, accuracy).join(
            if_few(sizes.select(F.col("_key").alias("_same"), F.col("_t").alias("_same_t"), "_k"), targets),
            F.col("_key").eqNullSafe(F.col("_same")) & (F.col("_t") == F.col("_same_t")))
        marks = cut_lineage(grid.select("_same", "_same_t", F.array(_bracket(
            F.col("_t"), F.col("_k"), F.col("_n"), F.col("_grid"), cells)).alias("_brackets")))
        tagged = hot.drop("_k").join(if_few(marks, targets), F.col("_key").eqNullSafe(F.col("_same"))
                                     & (F.col("_t") == F.col("_same_t")))
        more, rest = _step(tagged.drop("_t"), large.select("_key", "_t", "_k"), 1, targets)
        found = found.unionByName(more)
    values = found.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("_t", "_v"))).alias("_at"))
    sized = values.join(if_few(ranks.select(F.col("_key").alias("_same"), F.col("_n").alias("_rows")).distinct(), groups),
                        F.col("_key").eqNullSafe(F.col("_same")))

    def quantile(i: int, p: float) -> Column:
        rank = F.lit(float(p)) * (F.col("_rows") - 1)
        share = rank - F.floor(rank)
        low, high = F.col("_at")[2 * i], F.col("_at")[2 * i + 1]
        return F.when(share == 0, low).otherwise((1 - share) * low + share * high)

    return sized.select(F.col("_key").alias(by), *[quantile(i, p).alias(n) for i, (n, p) in enumerate(probs.items())])


def _grid(rows: DataFrame, key: list[str], cells: int, accuracy: int) -> DataFrame:
    points = [i / cells for i in range(cells + 1)]
    return rows.groupBy(*key).agg(F.count("_v").alias("_n"), F.percentile_approx("_v", points, accuracy).alias("_grid"))


def _cells(accuracy: int) -> int:
    return max(1, min(GRID, accuracy // 10))


def _bracket(target: Column, rank: Column, n: Column, grid: Column, cells: int) -> Column:
    """Sketch points that surely hold the rank between them; null where the group's end does."""
    cell = F.floor(F.try_divide(rank * cells, n - 1)).cast("int")
    return F.struct(target.alias("t"), rank.alias("k"),
                    F.when(cell > 1, F.get(grid, cell - 1)).alias("low"),
                    F.when(cell + 2 < cells, F.get(grid, cell + 2)).alias("high"))


def _inside(v: Column, b: Column) -> Column:
    return F.coalesce(v > b["low"], F.lit(True)) & F.coalesce(v < b["high"], F.lit(True))


def _step(tagged: DataFrame, ranks: DataFrame, n: int, targets: int) -> tuple[DataFrame, DataFrame]:
    """(answers for ranks on an end of their bracket, rows strictly inside the others with the rank among them).

    `tagged` are values with the `_brackets` of their group; `ranks` say (_key, _t, _k), at most `targets` of them.
    """
    v, b = F.col("_v"), [F.col("_brackets")[i] for i in range(n)]
    counts = tagged.groupBy("_key", "_brackets").agg(
        F.array(*[F.struct(F.count_if(v < x["low"]).alias("below"), F.count_if(v == x["low"]).alias("on"),
                           F.count_if(_inside(v, x)).alias("inside")) for x in b]).alias("_counts"))
    each = counts.select("_key", F.inline(F.zip_with("_brackets", "_counts", lambda x, y: F.struct(
        x["t"].alias("_t"), x["k"].alias("_k"), x["low"].alias("_low"), x["high"].alias("_high"),
        (y["below"] + y["on"]).alias("_upto"), y["inside"].alias("_inside")))))
    each = cut_lineage(each)
    at_low = F.col("_k") < F.col("_upto")
    at_high = F.col("_k") >= F.col("_upto") + F.col("_inside")
    found = each.filter(at_low | at_high).select("_key", "_t", F.when(at_low, F.col("_low")).otherwise(
        F.col("_high")).alias("_v"))
    still = each.filter(~(at_low | at_high)).select(F.col("_key").alias("_own"), "_t", (F.col("_k") - F.col("_upto")).alias("_k"))
    rows = tagged.select("_key", "_v", F.explode(F.filter("_brackets", lambda x: _inside(F.col("_v"), x))).alias("_in"))
    rows = rows.withColumn("_in_t", F.col("_in.t"))
    rest = rows.join(if_few(still, targets), F.col("_key").eqNullSafe(F.col("_own")) & (F.col("_in_t") == F.col("_t")))
    return found, rest.select("_key", "_t", "_k", "_v")


def _only(rows: DataFrame, keys: DataFrame, targets: int) -> DataFrame:
    keys = keys.select(F.col("_key").alias("_same"), F.col("_t").alias("_same_t"))
    return rows.join(if_few(keys, targets), F.col("_key").eqNullSafe(F.col("_same")) & (F.col("_t") == F.col("_same_t")), "left_semi")


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: dict[str, float],
                     hot_rows: int = HOT_ROWS, copied: bool = True) -> DataFrame:
    """One row (column, named quantiles...) per numeric column of the table.

    Of a large table the columns are copied as they are, or not at all (see `quantiles`): in long form they would
    be many times their size.
    """
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    if values.count() > hot_rows:
        values = cut_lineage(values) if copied else values
        long = values.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).alias("_value")) for c in columns])))
        return quantiles(long, "_value", probs, "column", hot_rows, copied=False)
    wide = values.agg(*[
        F.struct(F.lit(c).alias("column"),
                 *[F.percentile(c, F.lit(p)).alias(n) for n, p in probs.items()]).alias(c)
        for c in columns])
    return wide.select(F.inline(F.array(*[F.col(c) for c in columns])))
