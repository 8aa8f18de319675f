"""Device-level tables: statistics over events, and the mean-time-between-failures table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapline.functions.times import days_between, whole_days_between
from gapline.operators.history import Timeline, _gaps, _gaps_in_segments
from gapline.operators.quantiles import quantiles
from gapline.operators.scale import HOT_ROWS, if_few, split_hot, summaries, union_parts


def device_stats(events: DataFrame, tl: Timeline = Timeline(), gap: str = "gap_h") -> DataFrame:
    """Per device over its gap rows: counts, means, sample deviations (one row: 0), running days
    and failures per day. All parts combine before the shuffle, so a hot device is one small row."""
    days = days_between(F.min(tl.time), F.max(tl.time))
    n = F.count(tl.time)
    return events.groupBy(tl.device).agg(
        n.alias("device_failures"),
        F.avg(tl.repair).alias("device_mean_repair"),
        F.coalesce(F.stddev_samp(tl.repair), F.lit(0.0)).alias("device_std_repair"),
        F.avg(gap).alias("device_mean_gap"),
        F.coalesce(F.stddev_samp(gap), F.lit(0.0)).alias("device_std_gap"),
        days.alias("device_days"),
        (n / F.greatest(days, F.lit(1.0))).alias("device_daily_rate"))


def with_device_stats(events: DataFrame, tl: Timeline = Timeline(), gap: str = "gap_h") -> DataFrame:
    """Statistics joined back to the events. There is a row per device, too many to assume a
    broadcast; adaptive execution picks one when it fits and splits a hot device when not."""
    return events.join(device_stats(events, tl, gap), tl.device, "left")


def with_band(df: DataFrame, tl: Timeline = Timeline(), *, low: float = 10.0, prob: float = 0.95,
              hot_rows: int = HOT_ROWS) -> DataFrame:
    """All records with gap_h, and band_high: the device's own quantile of its positive gaps."""
    positive = F.when(F.col("gap_h") > 0, F.col("gap_h"))
    cold, hot = split_hot(df, tl.device, tl.order, hot_rows)
    whole = Window.partitionBy(tl.device)
    cold = _gaps(cold, tl).withColumns({
        "band_high": F.percentile(positive, F.lit(prob)).over(whole)})
    if hot is not None:
        hot = _gaps_in_segments(hot, tl)
        bands = quantiles(hot.select(tl.device, positive.alias("gap_h")), "gap_h",
                          {"band_high": prob}, tl.device, hot_rows)
        # One row per hot device.
        bands = if_few(bands.withColumnRenamed(tl.device, "_device"), summaries(hot))
        hot = hot.join(bands, F.col(tl.device).eqNullSafe(F.col("_device")), "left")
    return union_parts(cold, hot).withColumn("in_band", F.coalesce(
        (positive >= low) & (positive <= F.col("band_high")), F.lit(False)))


def band_filter(df: DataFrame, tl: Timeline = Timeline(), *, low: float = 10.0, prob: float = 0.95,
                min_gaps: int = 3, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Gaps of a device inside [low, its own quantile], for devices with enough gaps before
    and after the cut."""
    rows = with_band(df, tl, low=low, prob=prob, hot_rows=hot_rows)
    counts = rows.groupBy(tl.device).agg(
        F.count_if(F.col("gap_h") > 0).alias("_positive"), F.count_if("in_band").alias("_kept"))
    enough = counts.filter((F.col("_positive") >= min_gaps) & (F.col("_kept") >= min_gaps))
    return rows.filter("in_band").join(enough.select(tl.device), tl.device, "left_semi")


def device_mtbf(df: DataFrame, tl: Timeline = Timeline(), labels: dict[str, str] | None = None, *,
                min_records: int = 5, min_gaps: int = 3, low: float = 10.0, prob: float = 0.95,
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per device: its mean time between failures and the features to predict it.

    `labels` maps output names to category columns, taken from the device's first record.
    """
    labels = {"station": "station_name", "brand": "cust_brand", "line": "cust_linenum"} \
        if labels is None else labels
    rows = with_band(df, tl, low=low, prob=prob, hot_rows=hot_rows)
    gap = F.when(F.col("in_band"), F.col("gap_h"))
    n = F.count(F.lit(1))
    age = F.greatest(whole_days_between(F.min(tl.time), F.max(tl.time)), F.lit(1))
    stamp = F.struct(*tl.order)
    table = rows.groupBy(tl.device).agg(
        n.alias("n_failures"),
        F.count_if(F.col("gap_h") > 0).alias("_positive"),
        F.count(gap).alias("_kept"),
        F.stddev_pop(gap).alias("std_mtbf_h"), F.min(gap).alias("min_mtbf_h"),
        F.max(gap).alias("max_mtbf_h"),
        F.avg(tl.repair).alias("avg_repair_h"), F.max(tl.repair).alias("max_repair_h"),
        age.alias("aging_days"), (n / age * 30).alias("fail_rate_monthly"),
        *[_first_label(c, stamp).alias(name) for name, c in labels.items()],
        F.avg(gap).alias("avg_mtbf_h"))
    enough = ((F.col("n_failures") >= min_records) & (F.col("_positive") >= min_gaps)
              & (F.col("_kept") >= min_gaps))
    return table.filter(enough).drop("_positive", "_kept")


def _first_label(column: str, stamp: Column) -> Column:
    """Category of the earliest record, null included."""
    return F.min_by(F.struct(F.col(column).cast("string").alias("label")), stamp)["label"]
