"""Splits, samples and folds, fixed by a hash of the id and a seed instead of row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline.operators.scale import (HOT_ROWS, MAX_LOOKUP_ROWS, bounded_rows, cut_lineage, lookup_join,
                                     row_numbers, with_totals)

SEED = 42


def seeded_hash(ids: Sequence[str], seed: int = SEED) -> Column:
    """Text that sorts the ids in a random but repeatable order."""
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in ids], F.lit(str(seed))))


def group_split(df: DataFrame, device: str, test_share: float = 0.2, seed: int = SEED,
                stratum: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(device, is_test): the first ceil(share·n) devices in hash order, in each stratum if given.

    Null strata form a stratum of their own. A device takes the stratum of its smallest label.
    """
    label = F.min(stratum).alias("_stratum") if stratum else F.first(F.lit(0)).alias("_stratum")
    devices = df.groupBy(device).agg(label).withColumn("_hash", seeded_hash([device], seed))
    ranked = row_numbers(devices, ["_hash", device], "_stratum", "_no", hot_rows)
    sizes = devices.groupBy(F.col("_stratum").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    small = bounded_rows(sizes, MAX_LOOKUP_ROWS)
    sizes = F.broadcast(small) if small is not None else sizes
    joined = ranked.join(sizes, F.col("_stratum").eqNullSafe(F.col("_of")))
    return joined.select(device, (F.col("_no") <= F.ceil(F.col("_n") * test_share)).alias("is_test"))


def take_side(df: DataFrame, split: DataFrame, device: str, test: bool) -> DataFrame:
    """Rows of the test (or training) devices."""
    side = split.filter(F.col("is_test") == test).select(device)
    return df.join(side, device, "left_semi")


def with_side(df: DataFrame, device: str, test_share: float = 0.2, seed: int = SEED,
              hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows with `is_test`, as `group_split` without strata has it; null where the device is null.

    Test devices come first in hash order, so the last of them tells the sides apart: one row instead of a join
    that moves the table.
    """
    place = F.struct(seeded_hash([device], seed).alias("hash"), F.col(device).alias("device"))
    split = group_split(df.select(device), device, test_share, seed, hot_rows=hot_rows)
    last = cut_lineage(split.filter("is_test").agg(F.max(place).alias("_last")))
    return with_totals(df, last).withColumn(
        "is_test", F.when(F.col(device).isNotNull(), F.coalesce(place <= F.col("_last"), F.lit(False)))).drop("_last")


def shared_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on both sides; empty for a sound split."""
    return left.select(key).intersect(right.select(key))


def sample_rows(df: DataFrame, n: int, ids: Sequence[str], seed: int = SEED) -> DataFrame:
    """n rows at random, the same ones every time. Each task keeps its own best n only."""
    return (df.withColumn("_hash", seeded_hash(ids, seed)).orderBy("_hash", *ids).limit(n)
            .drop("_hash"))


def bootstrap(df: DataFrame, ids: Sequence[str], seed: int = SEED,
              hot_rows: int = HOT_ROWS) -> DataFrame:
    """Resample with replacement, exactly as many rows as before.

    Draw k takes the row whose place in the order of `ids` its hash names.
    """
    rows = row_numbers(df, ids, name="_no", hot_rows=hot_rows)
    n = df.count()
    draws = df.sparkSession.range(1, n + 1).withColumnRenamed("id", "_draw")
    digits = F.conv(F.substring(seeded_hash(["_draw"], seed), 1, 15), 16, 10).cast("bigint")
    wanted = draws.select((F.pmod(digits, F.lit(max(n, 1))) + 1).alias("_no"))
    return rows.join(wanted, "_no").drop("_no")


def with_fold(df: DataFrame, ids: Sequence[str], folds: int = 5, seed: int = SEED,
              name: str = "fold") -> DataFrame:
    """Fold 0..folds-1 of each row from the leading hash digits."""
    digits = F.conv(F.substring(seeded_hash(ids, seed), 1, 8), 16, 10).cast("bigint")
    return df.withColumn(name, F.pmod(digits, F.lit(folds)).cast("int"))


def thin(df: DataFrame, order: Sequence[str], step: int = 5, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every step-th row in the given order, starting with the first."""
    ranked = row_numbers(df, order, name="_no", hot_rows=hot_rows)
    return ranked.filter((F.col("_no") - 1) % step == 0).drop("_no")


def members(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_semi")


def non_members(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def first_labels(df: DataFrame, key: str, label: str, order: Sequence[str]) -> DataFrame:
    """(key, label of its first row in the given order)."""
    held = F.min_by(F.struct(F.col(label).alias("label")), F.struct(*order))
    return df.groupBy(key).agg(held.alias("_held")).select(key, F.col("_held.label").alias(label))


def labels_of(keys: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Labels aligned to a list of keys."""
    return lookup_join(keys, labels, key, "inner")
