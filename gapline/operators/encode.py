"""Category encodings, all fitted from one pass over the table.

`fit_categories` counts every wanted column at once and gives each category its code, share
and smoothed target mean. `encode` joins them back. Fit on the training rows and apply to
any rows; categories unseen in the fit come out null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.operators.scale import (HOT_ROWS, MAX_LOOKUP_ROWS, cut_lineage,
                                     lookup_join, row_numbers, split_join, with_totals)

# Strength of the prior, and the text that stands for a missing category.
PRIOR_ROWS = 10
MISSING = "nan"

MAX_LOOKUP_BYTES = 16 << 20    # text of a column's categories that may be broadcast
ROW_BYTES = 60                 # of a category row besides its text, about


def fit_categories(df: DataFrame, columns: Sequence[str], target: str | None = None,
                   prior: float = PRIOR_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(column, value, label, code, share, target_mean, rows) for every category of the columns.

    code         0, 1, ... by ascending text; null counts as the text 'nan'
    share        rows of the category over the non-null rows of the column
    target_mean  (mean·rows + global mean·prior) / (rows + prior)

    Categories are counted before the shuffle, so what moves is one row per category and task.
    """
    goal = F.col(target).cast("double") if target else F.lit(None).cast("double")
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                      for c in columns])
    counts = df.select(goal.alias("_goal"), F.inline(pairs)).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("_rows"), F.coalesce(F.sum("_goal"), F.lit(0.0)).alias("_sum"),
        F.count("_goal").alias("_n"))
    counts = counts.withColumn("label", F.coalesce("value", F.lit(MISSING)))
    labels = row_numbers(counts.select("column", "label").distinct(), ["label"], "column", "_no",
                         hot_rows)
    known = F.col("value").isNotNull()
    totals = counts.groupBy("column").agg(
        F.sum(F.when(known, F.col("_rows"))).alias("_known"),
        (F.try_divide(F.sum("_sum"), F.sum("_n"))).alias("_mean"))
    mean = F.try_divide(F.col("_sum") + F.col("_mean") * prior, F.col("_n") + F.lit(prior))
    return counts.join(labels, ["column", "label"]).join(F.broadcast(totals), "column").select(
        "column", "value", "label", (F.col("_no") - 1).cast("int").alias("code"),
        F.when(known, F.col("_rows") / F.col("_known")).alias("share"),
        F.when(known, mean).alias("target_mean"), F.col("_rows").alias("rows"))


class Categories:
    """A fitted category table. Each column's part is broadcast if its own rows and bytes allow it, or if all its
    categories have so many rows that they would be broadcast as heavy ones."""

    def __init__(self, table: DataFrame, max_rows: int = MAX_LOOKUP_ROWS,
                 max_bytes: int = MAX_LOOKUP_BYTES, hot_rows: int = HOT_ROWS):
        self.table = cut_lineage(table)
        self.hot_rows = hot_rows
        text = F.coalesce(F.octet_length("value"), F.lit(0)) + F.octet_length("label") + ROW_BYTES
        sizes = self.table.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.sum(text).alias("b"),
                                                 F.count_if(F.col("rows") <= hot_rows).alias("light"))
        self.small = {r["column"] for r in sizes.collect() if r["b"] <= max_bytes and (
            r["n"] <= max_rows or not r["light"] and r["n"] <= MAX_LOOKUP_ROWS)}

    def join(self, df: DataFrame, column: str, what: str, name: str) -> DataFrame:
        """Add the fitted `what` (code, share or target_mean) of the column as `name`."""
        rows = self.table.filter(F.col("column") == column)
        text = F.col(column).cast("string")
        if what == "code":
            side = rows.groupBy(F.col("label").alias("_text")).agg(F.first("code").alias(name))
            text = F.coalesce(text, F.lit(MISSING))
        else:
            side = rows.filter(F.col("value").isNotNull()).select(
                F.col("value").alias("_text"), F.col(what).alias(name))
        # Broadcast only a table counted to be small; beyond it, heavy categories alone.
        keyed = df.withColumn("_text", text)
        joined = (keyed.join(F.broadcast(side), "_text", "left") if column in self.small else
                  split_join(keyed, side, "_text", "left", self.hot_rows))
        return joined.drop("_text")


def encode(df: DataFrame, fitted: Categories, *, codes: Mapping[str, str] | None = None,
           shares: Mapping[str, str] | None = None,
           target_means: Mapping[str, str] | None = None) -> DataFrame:
    """Add encoded columns; each mapping goes from category column to new name."""
    for what, names in (("code", codes), ("share", shares), ("target_mean", target_means)):
        for column, name in (names or {}).items():
            df = fitted.join(df, column, what, name)
    return df


def fit(df: DataFrame, columns: Sequence[str], target: str | None = None,
        prior: float = PRIOR_ROWS, max_rows: int = MAX_LOOKUP_ROWS,
        hot_rows: int = HOT_ROWS) -> Categories:
    return Categories(fit_categories(df, columns, target, prior, hot_rows), max_rows, hot_rows=hot_rows)


def out_of_fold_target_means(df: DataFrame, column: str, target: str, fold: str,
                             name: str = "target_code", prior: float = PRIOR_ROWS,
                             max_rows: int = MAX_LOOKUP_ROWS) -> DataFrame:
    """Target code of each row from the rows of the other folds only.

    Totals minus the fold's own part, so the table is aggregated once, not once per fold.
    """
    parts = df.groupBy(column, fold).agg(
        F.coalesce(F.sum(target), F.lit(0.0)).alias("_s"), F.count(target).alias("_n"))
    totals = parts.groupBy(column).agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
    folds = parts.groupBy(fold).agg(F.sum("_s").alias("_fs"), F.sum("_n").alias("_fn"))
    overall = parts.agg(F.sum("_s").alias("_as"), F.sum("_n").alias("_an"))
    others = with_totals(parts.join(totals, column).join(F.broadcast(folds), fold), overall)
    mean = F.try_divide(F.col("_as") - F.col("_fs"), F.col("_an") - F.col("_fn"))
    n = F.col("_tn") - F.col("_n")
    code = (F.col("_ts") - F.col("_s") + mean * prior) / (n + F.lit(prior))
    return lookup_join(df, others.select(column, fold, code.alias(name)), [column, fold], "left",
                       max_rows)


def apply_lookup(df: DataFrame, table: DataFrame, column: str,
                 max_rows: int = MAX_LOOKUP_ROWS) -> DataFrame:
    """Map a column through any (column, value) table; unmatched rows get null."""
    return lookup_join(df, table, column, "left", max_rows)
