"""Skew handling shared by the ordered operators.

A window over a device sends all rows of that device to one task. That is fine for
ordinary devices and fatal for one that holds a third of the table, so every ordered
operator first asks `split_hot` for the keys too big for one task. Those keys are cut
into consecutive segments by a range partitioning on (key, order); the operator works
per segment, and a short per-segment summary carries the state across the cuts.
No row is dropped, and with no hot key the plan is the plain one-exchange window.
"""

from __future__ import annotations

import gc
import tempfile
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOT_ROWS = 5_000_000      # rows of one key that a single task sorts without trouble
TASK_ROWS = 500_000       # rows of many short segments that go into one task
MAX_LOOKUP_ROWS = 100_000  # rows of a lookup table that may be broadcast
MAX_LOOKUP_BYTES = 64 << 20  # and their bytes, about
FREE_AFTER = 10.0         # seconds of work whose shuffle files are worth a garbage collection of the driver
SEGMENT = "_segment"
SUMMARIES = "summaries"    # metadata of the segment column
ONE_GROUP = "_all"


def checkpoint_folder(spark: SparkSession) -> None:
    """Point the session at its shared checkpoint folder; local sessions may get a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="gapline-checkpoint-")
        context.setCheckpointDir(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder of the session, so lost executors cost no recompute."""
    spark, began = df.sparkSession, time.monotonic()
    checkpoint_folder(spark)
    kept = df.checkpoint(eager=True)
    del df
    free_shuffles(spark, began)
    return kept


def free_shuffles(spark: SparkSession, began: float) -> None:
    """After long work let Spark delete the shuffle files that no table needs any more.

    It does so when the driver collects its garbage, which a driver with little to do may never do, and the
    files of all jobs of a plan then lie on the disks at once.
    """
    if time.monotonic() - began < FREE_AFTER:
        return
    gc.collect()                   # Python's names for tables of the driver, released a moment later
    for _ in range(2):
        time.sleep(0.2)
        spark._jvm.System.gc()


def key_counts(df: DataFrame, key: str, hot_rows: int = HOT_ROWS, value: str | None = None) -> DataFrame:
    """Keys above `hot_rows` with their `_rows` (those with a value, if one is named). None is left out."""
    n = F.count(F.lit(1) if value is None else F.col(value))
    return df.groupBy(key).agg(n.alias("_rows")).filter(F.col("_rows") > hot_rows)


def heavy_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> list[tuple[object, int]]:
    """The largest keys above `hot_rows`, as (key, rows), for tables known to have few of them."""
    counts = key_counts(df, key, hot_rows)
    return [(r[0], r[1]) for r in counts.orderBy(F.desc("_rows"), F.col(key)).collect()]


@dataclass(frozen=True)
class Sides:
    """Ordinary rows, rows of hot keys (None without hot keys), and how many and how large those keys are."""

    cold: DataFrame
    hot: DataFrame | None
    keys: int = 0
    rows: int = 0
    largest: int = 0


def sides(df: DataFrame, key: str, hot_rows: int = HOT_ROWS, value: str | None = None) -> Sides:
    """Rows of keys above `hot_rows` (counted by `value`, if named) apart from the others.

    The hot keys stay a table: broadcast while they are few, else joined by a shuffle, so neither the driver
    nor a filter holds them.
    """
    began = time.monotonic()
    counts = key_counts(df, key, hot_rows, value).select(F.col(key).alias("_hot_key"), "_rows").persist()
    try:
        seen = counts.agg(F.count(F.lit(1)).alias("keys"), F.sum("_rows").alias("rows"),
                          F.max("_rows").alias("largest")).first()
        if not seen["keys"]:
            return Sides(df, None)
        names = counts.select("_hot_key")
        small = bounded_rows(names, MAX_LOOKUP_ROWS)
        hot = cut_lineage(names) if small is None else F.broadcast(small)
    finally:
        counts.unpersist()
        free_shuffles(df.sparkSession, began)
    same = F.col(key).eqNullSafe(F.col("_hot_key"))
    return Sides(df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi"), *seen)


def if_few(table: DataFrame, rows: int) -> DataFrame:
    """A lookup side known to have at most `rows` rows: broadcast if that is little, else left to the planner."""
    return F.broadcast(table) if rows <= MAX_LOOKUP_ROWS else table


def split_hot(df: DataFrame, key: str, order: Sequence[str],
              hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """Ordinary rows, and the rows of hot keys with a `_segment` number (None without hot keys).

    Segments follow the order columns inside a key and hold at most `hot_rows` rows. A task takes many segments
    where they are short, so the tasks follow the rows and not `hot_rows`. Segments are fixed by a checkpoint,
    because the cut points come from a sample and must agree in every later use.
    """
    found = sides(df, key, hot_rows)
    if found.hot is None:
        return df, None
    length = max(hot_rows, 1)
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(2, min(found.rows // length + 1, max(cores, found.rows // TASK_ROWS + 1)))
    rows = found.hot.repartitionByRange(tasks, key, *order).sortWithinPartitions(key, *order)
    # The id counts the sorted rows of a partition in its lower 33 bits.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    segment = F.shiftleft(F.spark_partition_id().cast("bigint"), 33) + F.floor(place / F.lit(length)).cast("bigint")
    # A segment ends at a partition, after `length` rows, or at the next key.
    many = found.rows // length + tasks + found.keys
    return found.cold, cut_lineage(rows.withColumn(SEGMENT, segment)).withMetadata(SEGMENT, {SUMMARIES: many})


def summaries(rows: DataFrame) -> int:
    """The most (key, segment) pairs that rows of `split_hot` can have."""
    return rows.schema[SEGMENT].metadata[SUMMARIES]


def carry(rows: DataFrame, key: str, summary: dict[str, Column],
          carried: Callable[[Window, Window], dict[str, Column]],
          shared: Callable[[Window], dict[str, Column]] | None = None) -> DataFrame:
    """Join to every row the state accumulated in earlier segments of its key.

    `summary` is aggregated per (key, segment); `shared` adds columns to it from a window over all segments of
    the key. `carried` builds the joined columns from
    two windows over those summaries: the earlier segments, and the earlier ones plus
    this one. There is about one summary per `hot_rows` rows: a broadcast of a few
    millionths of the hot rows, or a shuffle where the summaries are many.
    """
    per_segment = rows.groupBy(key, SEGMENT).agg(*[c.alias(n) for n, c in summary.items()])
    order = Window.partitionBy(key).orderBy(SEGMENT)
    if shared is not None:
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        per_segment = per_segment.withColumns(shared(whole))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    until = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = per_segment.select(
        F.col(key).alias("_carry_key"), F.col(SEGMENT).alias("_carry_segment"),
        *[c.alias(n) for n, c in carried(before, until).items()])
    same = F.col(key).eqNullSafe(F.col("_carry_key")) & (F.col(SEGMENT) == F.col("_carry_segment"))
    return rows.join(if_few(state, summaries(rows)), same, "left").drop("_carry_key", "_carry_segment")


def union_parts(cold: DataFrame, hot: DataFrame | None) -> DataFrame:
    return cold if hot is None else cold.unionByName(hot.select(*cold.columns))


def row_numbers(df: DataFrame, order: Sequence[str], key: str | None = None,
                name: str = "row_no", hot_rows: int = HOT_ROWS) -> DataFrame:
    """1-based position inside each key, or in the whole table, in the given ascending order."""
    if key is None:
        keyed = df.withColumn(ONE_GROUP, F.lit(0))
        return row_numbers(keyed, order, ONE_GROUP, name, hot_rows).drop(ONE_GROUP)
    cold, hot = split_hot(df, key, order, hot_rows)
    w = Window.partitionBy(key).orderBy(*order)
    cold = cold.withColumn(name, F.row_number().over(w).cast("bigint"))
    if hot is None:
        return cold
    hot = carry(hot, key, {"_n": F.count(F.lit(1))},
                lambda before, until: {"_n_before": F.coalesce(F.sum("_n").over(before), F.lit(0))})
    w = Window.partitionBy(key, SEGMENT).orderBy(*order)
    return union_parts(cold, hot.withColumn(name, F.col("_n_before") + F.row_number().over(w)))


def bounded_rows(df: DataFrame, max_rows: int, max_bytes: int = MAX_LOOKUP_BYTES) -> DataFrame | None:
    """The table as a local relation when it has at most `max_rows` rows and about `max_bytes`, else None.

    Rows and bytes are counted by the executors first, so a table of wide rows never reaches the driver.
    """
    wide = {"string": F.octet_length, "binary": F.octet_length, "array": _json_bytes, "map": _json_bytes,
            "struct": _json_bytes}
    sizes = [F.coalesce(wide[f.dataType.typeName()](F.col(f"`{f.name}`")), F.lit(0))
             for f in df.schema if f.dataType.typeName() in wide]
    width = sum(sizes, F.lit(16 * len(df.columns))).cast("bigint")
    part = df.limit(max_rows + 1).persist()
    try:
        seen = part.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
        if seen["rows"] > max_rows or seen["bytes"] > max_bytes:
            return None
        spark: SparkSession = df.sparkSession
        return spark.createDataFrame(part.toArrow(), df.schema)
    finally:
        part.unpersist()


def _json_bytes(c: Column) -> Column:
    return F.octet_length(c.cast("string"))


def lookup_join(df: DataFrame, table: DataFrame, on: str | Sequence[str], how: str = "left",
                max_rows: int = MAX_LOOKUP_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join to a lookup table: broadcast when its size, checked here, allows it, else `split_join`.

    The checked rows are reused for the broadcast, so the table is computed once.
    """
    small = bounded_rows(table, max_rows)
    return split_join(df, table, on, how, hot_rows, max_rows) if small is None else df.join(
        F.broadcast(small), on, how)


def split_join(df: DataFrame, table: DataFrame, on: str | Sequence[str], how: str = "left",
               hot_rows: int = HOT_ROWS, max_rows: int = MAX_LOOKUP_ROWS) -> DataFrame:
    """Left or inner join to a table too large to broadcast, without gathering a heavy key in one task.

    Rows of keys above `hot_rows` meet the lookup rows of those keys by broadcast where they are; the others
    are shuffled; one union. Rows with a null key match nothing and stay where they are as well. Heavy keys
    are a broadcast table, at most one for each `hot_rows` rows. Where they or their lookup rows exceed
    `max_rows`, the shuffle takes all and adaptive execution splits what is skewed.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"a split join is left or inner, not {how}")
    keys = [on] if isinstance(on, str) else list(on)
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    heavy = bounded_rows(df.filter(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
                         .filter(F.col("_rows") > hot_rows).select(*keys), max_rows)
    few = None if heavy is None else bounded_rows(
        table.join(F.broadcast(heavy), keys, "left_semi").select(*table.columns), max_rows)
    if few is None:
        return df.join(table, keys, how)
    marked = df.join(F.broadcast(heavy.withColumn("_heavy", F.lit(True))), keys, "left").select(
        *df.columns, (F.coalesce(F.col("_heavy"), F.lit(False)) | ~known).alias("_heavy"))
    here = marked.filter("_heavy").drop("_heavy").join(F.broadcast(few), keys, how)
    return marked.filter("not _heavy").drop("_heavy").join(table, keys, how).unionByName(here)


def with_totals(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Attach a one-row table (global totals, thresholds) to every row, as a scalar subquery."""
    row = totals.select(F.struct(*totals.columns).alias("_totals")).scalar()
    return df.withColumn("_totals", row).select("*", "_totals.*").drop("_totals")
