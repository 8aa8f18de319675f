"""Profiles, distributions, correlations and collinearity, each from a few small aggregates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from contextlib import contextmanager

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapline.operators.quantiles import column_quantiles, quantiles
from gapline.operators.scale import HOT_ROWS, lookup_join, with_totals

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMBERS)]


def type_profile(df: DataFrame) -> DataFrame:
    """(column, type, is_numeric, rows with a value)."""
    return df.agg(F.array(*[
        F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                 F.lit(isinstance(f.dataType, NUMBERS)).alias("is_numeric"),
                 F.count(f.name).alias("rows")) for f in df.schema]).alias("_columns")).select(
        F.inline("_columns"))


def _unpivot(wide: DataFrame, columns: Sequence[str], **fields) -> DataFrame:
    """One row per column out of a one-row aggregate; `fields` name the parts."""
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), *[make(c).alias(n) for n, make in fields.items()])
        for c in columns])))


def describe(df: DataFrame, value: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """min, max, mean and median of one column."""
    basic = df.agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))
    return with_totals(basic, quantiles(df, value, {"median": 0.5}, hot_rows=hot_rows))


def records_per_device(df: DataFrame, device: str) -> DataFrame:
    return df.groupBy(device).agg(F.count(F.lit(1)).alias("records"))


def record_count_classes(df: DataFrame, device: str) -> DataFrame:
    """Devices with one record, and with two or more."""
    return records_per_device(df, device).agg(
        F.count_if(F.col("records") == 1).alias("single_record_devices"),
        F.count_if(F.col("records") >= 2).alias("repeat_devices"))


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    wide = df.agg(*[count(F.col(c)).alias(c) for c in columns])
    return _unpivot(wide, columns, distinct_values=lambda c: F.col(c))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, null among them."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def value_shares(df: DataFrame, column: str, name: str = "share") -> DataFrame:
    """Share of each value among the non-null rows."""
    counts = value_counts(df.filter(F.col(column).isNotNull()), column)
    total = counts.agg(F.sum("rows").alias("_total"))
    return with_totals(counts, total).select(column, (F.col("rows") / F.col("_total")).alias(name))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or df.columns)
    wide = df.agg(F.count(F.lit(1)).alias("_rows"),
                  *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return _unpivot(
        wide, columns, nulls=lambda c: F.col(c),
        percent=lambda c: F.coalesce(F.try_divide(F.col(c) * 100.0, F.col("_rows")), F.lit(0.0)))


def null_total(df: DataFrame) -> DataFrame:
    """One row: how many values of the whole table are null."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).select(
        sum((F.col(c) for c in df.columns), F.lit(0)).cast("bigint").alias("nulls"))


def gaps_not_positive(df: DataFrame, gap: str = "gap_h") -> DataFrame:
    return df.agg(F.count_if(F.col(gap) <= 0).alias("violations"))


def group_mean_count(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(value).alias("mean"), F.count(value).alias("rows"))


def group_medians(df: DataFrame, key: str, value: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Categories by rising median."""
    return quantiles(df, value, {"median": 0.5}, key, hot_rows).orderBy("median", key)


def pearson(x: Column, y: Column) -> Column:
    """Correlation aggregate over rows where both are known; null for a constant column."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


@contextmanager
def _kept(df: DataFrame, columns: Sequence[str]) -> Iterator[DataFrame]:
    """The columns as doubles, cached for the passes made over them inside the block."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).persist()
    try:
        yield rows
    finally:
        rows.unpersist()


def _matrix(rows: DataFrame, columns: Sequence[str]) -> np.ndarray:
    vectors = VectorAssembler(inputCols=list(columns), outputCol="_v").transform(rows)
    matrix = np.nan_to_num(Correlation.corr(vectors, "_v").first()[0].toArray(), nan=0.0)
    np.fill_diagonal(matrix, 1.0)
    return matrix


def _pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> list[float | None]:
    """Correlation of each pair over the rows where both are known; None beside a constant."""
    names = list(dict.fromkeys(c for pair in pairs for c in pair))
    with _kept(df, names) as rows:
        ends = rows.agg(F.count(F.lit(1)).alias("_rows"), *[
            F.struct(F.count(c).alias("known"), (F.min(c) == F.max(c)).alias("flat")).alias(c)
            for c in names]).first()
        if ends["_rows"] > 0 and all(ends[c]["known"] == ends["_rows"] for c in names):
            matrix = _matrix(rows, names)
            at = {c: i for i, c in enumerate(names)}
            return [None if ends[a]["flat"] or ends[b]["flat"] else float(matrix[at[a], at[b]])
                    for a, b in pairs]
        return list(rows.agg(*[pearson(F.col(a), F.col(b)).alias(f"_{i}")
                               for i, (a, b) in enumerate(pairs)]).first())


def target_correlations(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(column, correlation) by falling absolute correlation with the target; constants come last."""
    values = _pairs(df, [(c, target) for c in features])
    rows = [(c, None if v is None else abs(v)) for c, v in zip(features, values)]
    rows.sort(key=lambda r: (r[1] is None, -(r[1] or 0.0), r[0]))
    return df.sparkSession.createDataFrame(rows, "column string, correlation double")


def correlation_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Lower triangle with diagonal of the correlation matrix: (row, column, correlation)."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[:i + 1]]
    rows = [(a, b, v) for (a, b), v in zip(pairs, _pairs(df, pairs))]
    return df.sparkSession.createDataFrame(rows, "row string, column string, correlation double")


def constant_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with at most one distinct non-null value. Min and max tell, no distinct needed."""
    row = df.agg(*[F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def zero_deviation_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    row = df.agg(*[(F.stddev_samp(c) == 0).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def profile(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, bool]]:
    """Nulls of each column, and whether it has at most one value, from one aggregate."""
    row = df.agg(*[F.struct(F.count_if(F.col(c).isNull()).alias("nulls"),
                            F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias("flat")).alias(f"c{i}")
                   for i, c in enumerate(columns)]).first()
    return {c: (row[i]["nulls"], row[i]["flat"]) for i, c in enumerate(columns)}


@dataclass
class Moments:
    """Rows, means, population deviations and correlations of columns without nulls."""

    columns: list[str]
    rows: int
    mean: np.ndarray
    deviation: np.ndarray
    correlation: np.ndarray

    def without_flat(self) -> Moments:
        """The columns that vary; a deviation of 0 says that a column does not."""
        at = np.flatnonzero(self.deviation > 0)
        return Moments([self.columns[i] for i in at], self.rows, self.mean[at], self.deviation[at],
                       self.correlation[np.ix_(at, at)])

    def gram(self, centered: bool = False) -> np.ndarray:
        """X'X of the columns scaled to unit length, accurate for columns of large mean and small spread."""
        second = self.correlation * np.outer(self.deviation, self.deviation)
        if not centered:
            second = second + np.outer(self.mean, self.mean)
        length = np.sqrt(np.diag(second))
        length[length == 0] = 1.0
        return second / np.outer(length, length)


def moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    """Moments of the rows where all columns are known. k x k numbers come to the driver."""
    columns = list(columns)
    with _kept(df.dropna("any", subset=columns), columns) as rows:
        ends = rows.agg(F.count(F.lit(1)), *[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).first()
        if ends[0] == 0:
            return Moments(columns, 0, np.zeros(len(columns)), np.zeros(len(columns)), np.eye(len(columns)))
        mean, deviation = np.array(ends[1:]).reshape(2, -1)
        return Moments(columns, ends[0], mean, deviation, _matrix(rows, columns))


def gram_matrix(df: DataFrame, features: Sequence[str], centered: bool = False) -> np.ndarray:
    """X'X over rows without nulls, of the columns scaled to unit length.

    Built from the correlation matrix and the means, which keeps it accurate for columns of
    large mean and small spread. k x k numbers come to the driver.
    """
    found = moments(df, features)
    return found.gram(centered) if found.rows else np.eye(len(features))


def variance_inflation(df: DataFrame, features: Sequence[str],
                       centered: bool = False) -> dict[str, float]:
    """VIF per feature: the diagonal of the inverse of the scaled Gram matrix.

    Without `centered` the regressions have no intercept. Features tied in an exact linear
    relation get infinity.
    """
    return inflation(gram_matrix(df, features, centered), features)


def inflation(gram: np.ndarray, features: Sequence[str]) -> dict[str, float]:
    """VIF of features from their scaled Gram matrix."""
    values, vectors = np.linalg.eigh(gram)
    tiny = values < 1e-12 * max(values.max(), 1.0)
    tied = (np.abs(vectors[:, tiny]) > 1e-6).any(axis=1)
    inverse_diagonal = (vectors[:, ~tiny] ** 2 / values[~tiny]).sum(axis=1)
    return {c: float("inf") if tied[i] else float(max(inverse_diagonal[i], 1.0))
            for i, c in enumerate(features)}


def vif_table(spark: SparkSession, vif: dict[str, float]) -> DataFrame:
    """(column, vif) by falling VIF."""
    rows = sorted(vif.items(), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "column string, vif double")


def histogram(df: DataFrame, value: Column, bins: int, low: float | None = None,
              high: float | None = None) -> DataFrame:
    """Equal-width bins over [low, high] (data range by default), the last one closed.

    (bin, left, right, rows), empty bins included; values outside the range are left out.
    """
    rows = df.select(value.cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    if low is None or high is None:
        bounds = rows.agg(
            F.coalesce(F.lit(low), F.min("_v")).cast("double").alias("_low"),
            F.coalesce(F.lit(high), F.max("_v")).cast("double").alias("_high"))
    else:
        bounds = df.sparkSession.createDataFrame([(float(low), float(high))],
                                                 "_low double, _high double")
    # A range of no width is widened by half a unit each way.
    flat = F.col("_low") == F.col("_high")
    bounds = bounds.select(
        F.when(flat, F.col("_low") - 0.5).otherwise(F.col("_low")).alias("_low"),
        F.when(flat, F.col("_high") + 0.5).otherwise(F.col("_high")).alias("_high"))
    width = (F.col("_high") - F.col("_low")) / bins
    number = F.least(F.floor((F.col("_v") - F.col("_low")) / width), F.lit(bins - 1)).cast("int")
    counts = (
        with_totals(rows, bounds)
        .filter((F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high")))
        .groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("rows")))
    frame = bounds.select("_low", width.alias("_width"),
                          F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    # At most `bins` rows on each side.
    return frame.join(F.broadcast(counts), "bin", "left").select(
        "bin", (F.col("_low") + F.col("bin") * F.col("_width")).alias("left"),
        (F.col("_low") + (F.col("bin") + 1) * F.col("_width")).alias("right"),
        F.coalesce("rows", F.lit(0)).alias("rows"))


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def box_stats(df: DataFrame, value: str, by: str | None = None,
              hot_rows: int = HOT_ROWS) -> DataFrame:
    """Quartiles, whiskers (furthest values within 1.5 interquartile ranges) and outlier count."""
    rows = df.filter(F.col(value).isNotNull())
    quarts = quantiles(rows, value, QUARTILES, by, hot_rows)
    fences = quarts.withColumns({
        "_lo": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")),
        "_hi": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))})
    tagged = with_totals(rows, fences) if by is None else lookup_join(rows, fences, by, "inner")
    inside = F.when((F.col(value) >= F.col("_lo")) & (F.col(value) <= F.col("_hi")), F.col(value))
    keys = ([by] if by is not None else []) + list(QUARTILES)
    return tagged.groupBy(*keys).agg(
        F.min(inside).alias("whisker_low"), F.max(inside).alias("whisker_high"),
        (F.count(F.lit(1)) - F.count(inside)).alias("outliers"), F.count(F.lit(1)).alias("rows"))


def fill_medians(df: DataFrame, columns: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Nulls of numeric columns become the column's median, of others 0."""
    numeric = set(numeric_columns(df))
    wanted = [c for c in columns if c in numeric]
    medians = {}
    if wanted:
        rows = column_quantiles(df, wanted, {"median": 0.5}, hot_rows).collect()
        medians = {r["column"]: r["median"] for r in rows if r["median"] is not None}
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.lit(medians.get(c, 0.0))) if c in numeric
        else F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in columns})
