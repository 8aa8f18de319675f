"""Gaps between failures and leak-free history features per device.

Everything here shares one partitioning (device) and one order (time, tie-breakers), so
Spark plans a single exchange and sort for all of it. Hot devices go through segments,
see `gapline.operators.scale`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapline.functions.times import days_between, hours_between
from gapline.operators.quantiles import quantiles
from gapline.operators.scale import (HOT_ROWS, SEGMENT, carry, cut_lineage, split_hot, union_parts,
                                     with_totals)

FAR = 3  # how many earlier gaps the short rolling means look at


@dataclass(frozen=True)
class Timeline:
    """Which columns play which part. The tie-breakers make the order of equal times fixed."""

    device: str = "assetnum"
    time: str = "current_faildate"
    ties: tuple[str, ...] = ("wonum",)
    repair: str = "repair_duration_hours"

    @property
    def order(self) -> tuple[str, ...]:
        return (self.time, *self.ties)


def with_gaps(df: DataFrame, tl: Timeline = Timeline(), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add gap_h (hours since the device's previous record), record_no, first_time, first_repair."""
    cold, hot = split_hot(df, tl.device, tl.order, hot_rows)
    cold = _gaps(cold, tl)
    return union_parts(cold, None if hot is None else _gaps_in_segments(hot, tl))


def _gaps(df: DataFrame, tl: Timeline) -> DataFrame:
    w = Window.partitionBy(tl.device).orderBy(*tl.order)
    return df.withColumns({
        "record_no": F.row_number().over(w).cast("bigint"),
        "first_time": F.first(tl.time).over(w),
        "first_repair": F.first(tl.repair).over(w),
        "gap_h": hours_between(F.lag(tl.time).over(w), F.col(tl.time)),
    })


def _gaps_in_segments(rows: DataFrame, tl: Timeline) -> DataFrame:
    head = F.struct(*tl.order, F.col(tl.repair).alias("_repair"))
    rows = carry(
        rows, tl.device,
        {"_n": F.count(F.lit(1)), "_last": F.max(tl.time), "_head": F.min(head)},
        lambda before, until: {
            "_n_before": F.coalesce(F.sum("_n").over(before), F.lit(0)),
            "_time_before": F.max("_last").over(before),
            "_device_head": F.min("_head").over(until),
        })
    w = Window.partitionBy(tl.device, SEGMENT).orderBy(*tl.order)
    previous = F.coalesce(F.lag(tl.time).over(w), F.col("_time_before"))
    return rows.withColumns({
        "record_no": F.col("_n_before") + F.row_number().over(w),
        "first_time": F.col("_device_head")[tl.time],
        "first_repair": F.col("_device_head")["_repair"],
        "gap_h": hours_between(previous, F.col(tl.time)),
    }).drop("_n_before", "_time_before", "_device_head")


def with_history(df: DataFrame, tl: Timeline = Timeline(), *, zero_gaps: str = "drop",
                 no_history: str = "null", since: str = "first_record",
                 first_repair: str = "retained", records: int = 1,
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per failure after the device's first, with features of the earlier rows only.

    zero_gaps     "drop" removes rows with gap 0 before the history is taken, "keep" leaves them
    no_history    last and mean gaps where nothing came before: "null", "zero" or "target"
                  (the row's own gap, which leaks the target and is offered for parity)
    since         days_running counts from the "first_record" or the "first_retained" one
    first_repair  repair history where nothing came before: the "retained" row's own repair
                  or that of the device's first "record"
    records       devices with fewer records in all are left out
    Added: hist_count, hist_mean_gap, hist_std_gap, last_gap, recent3_gap, rolling3_gap,
    prev_gap, prev_repair, hist_mean_repair, last_repair, days_running, hist_rate.
    """
    _check("zero_gaps", zero_gaps, ("drop", "keep"))
    _check("no_history", no_history, ("null", "zero", "target"))
    _check("since", since, ("first_record", "first_retained"))
    _check("first_repair", first_repair, ("retained", "record"))
    keep = F.col("gap_h") > 0 if zero_gaps == "drop" else F.col("gap_h").isNotNull()
    cold, hot = split_hot(df, tl.device, tl.order, hot_rows)
    cold = _gaps(cold, tl)
    if records > 2:
        # A window on the same partitioning: no exchange of its own.
        whole = Window.partitionBy(tl.device)
        cold = cold.withColumn("_records", F.count(F.lit(1)).over(whole))
        cold = cold.filter(F.col("_records") >= records).drop("_records")
    cold = _state(cold.filter(keep), tl)
    if hot is not None:
        hot = min_records(hot, records, tl.device) if records > hot_rows else hot
        hot = _state_in_segments(_gaps_in_segments(hot, tl).filter(keep), tl)
    return _features(union_parts(cold, hot), tl, no_history, since, first_repair)


def _check(name: str, value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {allowed}, not {value!r}")


def _state(rows: DataFrame, tl: Timeline) -> DataFrame:
    w = Window.partitionBy(tl.device).orderBy(*tl.order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({
        "hist_count": F.count("gap_h").over(before),
        "_mean": F.avg("gap_h").over(before),
        "_std": F.stddev_pop("gap_h").over(before),
        "_recent": F.array_compact(F.array(*[F.lag("gap_h", i).over(w)
                                             for i in range(1, FAR + 1)])),
        "prev_repair": F.lag(tl.repair).over(w),
        "_mean_repair": F.avg(tl.repair).over(before),
        "_start": F.first(tl.time).over(w),
        "_start_repair": F.first(tl.repair).over(w),
    })


def _state_in_segments(rows: DataFrame, tl: Timeline) -> DataFrame:
    local = Window.partitionBy(tl.device, SEGMENT).orderBy(*tl.order)
    stamp = F.struct(*tl.order)
    tail = F.struct(stamp.alias("at"), F.col("gap_h").alias("gap"), F.col(tl.repair).alias("repair"))
    # Only the last three rows of a segment enter its tail, so the list stays that short.
    rows = rows.withColumn("_tail", F.when(F.lead("gap_h", FAR).over(local).isNull(), tail))
    # Squares are summed around the mean of the key's first segment, so gaps that vary little lose no digits.
    away = F.coalesce(F.col("_avg") - F.col("_base"), F.lit(0.0))
    rows = carry(
        rows, tl.device,
        {"_n": F.count("gap_h"), "_sum": F.sum("gap_h"), "_avg": _exact_mean(lambda f: f("gap_h")),
         "_m2": F.var_pop("gap_h") * F.count("gap_h"),
         "_rn": F.count(tl.repair), "_rsum": F.sum(tl.repair),
         "_last3": F.collect_list("_tail"),
         "_head": F.min(F.struct(stamp.alias("at"), F.col(tl.repair).alias("repair")))},
        lambda before, until: {
            "_n_b": F.coalesce(F.sum("_n").over(before), F.lit(0)),
            "_sum_b": F.coalesce(F.sum("_sum").over(before), F.lit(0.0)),
            "_sq_b": F.coalesce(F.sum(F.coalesce("_m2", F.lit(0.0)) + F.col("_n") * away * away).over(before), F.lit(0.0)),
            "_away_b": F.coalesce(F.sum(F.col("_n") * away).over(before), F.lit(0.0)),
            "_base_b": F.first("_base").over(until),
            "_rn_b": F.coalesce(F.sum("_rn").over(before), F.lit(0)),
            "_rsum_b": F.coalesce(F.sum("_rsum").over(before), F.lit(0.0)),
            # Each of the three segments before holds a row, so together they hold the last three.
            "_tail_b": F.slice(F.sort_array(F.flatten(F.collect_list("_last3").over(
                before.rowsBetween(-FAR, -1))), asc=False), 1, FAR),
            "_device_head": F.min("_head").over(until),
        },
        lambda whole: {"_base": F.first("_avg", ignorenulls=True).over(whole)})
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    n_here = F.count("gap_h").over(before)
    sum_here = F.coalesce(F.sum("gap_h").over(before), F.lit(0.0))
    mean_here = F.coalesce(_exact_mean(lambda f: f("gap_h").over(before)), F.lit(0.0))
    m2_here = F.coalesce(F.var_pop("gap_h").over(before), F.lit(0.0)) * n_here
    rows = rows.withColumns({
        "hist_count": F.col("_n_b") + n_here, "_sum_h": sum_here,
        "_mean_h": mean_here, "_m2_h": m2_here, "_n_h": n_here,
        "_rn_h": F.count(tl.repair).over(before),
        "_rsum_h": F.coalesce(F.sum(tl.repair).over(before), F.lit(0.0)),
        "_lags": F.array_compact(F.array(*[F.lag("gap_h", i).over(local)
                                           for i in range(1, FAR + 1)])),
        "_first_here": F.row_number().over(local) == 1,
        "_repair_lag": F.lag(tl.repair).over(local),
    })
    n = F.col("hist_count")
    mean = F.try_divide(F.col("_sum_b") + F.col("_sum_h"), n)
    # Pool the variances of the two parts around their own means.
    away_b = F.coalesce(F.try_divide(F.col("_away_b"), F.col("_n_b")), F.lit(0.0))
    mean_b = F.coalesce(F.col("_base_b") + away_b, F.lit(0.0))
    m2_b = F.greatest(F.col("_sq_b") - F.col("_n_b") * away_b * away_b, F.lit(0.0))
    shift = mean_b - F.col("_mean_h")
    m2 = m2_b + F.col("_m2_h") + F.coalesce(
        F.try_divide(shift * shift * F.col("_n_b") * F.col("_n_h"), n), F.lit(0.0))
    return rows.withColumns({
        "_mean": mean,
        "_std": F.sqrt(F.try_divide(m2, n)),
        "_recent": F.slice(F.concat("_lags", F.transform("_tail_b", lambda t: t["gap"])), 1, FAR),
        "prev_repair": F.when(F.col("_first_here"), F.get(F.col("_tail_b"), F.lit(0))["repair"])
                        .otherwise(F.col("_repair_lag")),
        "_mean_repair": F.try_divide(F.col("_rsum_b") + F.col("_rsum_h"),
                                     F.col("_rn_b") + F.col("_rn_h")),
        "_start": F.col("_device_head")["at"][tl.time],
        "_start_repair": F.col("_device_head")["repair"],
    })


def _exact_mean(of: Callable[[Callable[[str], Column]], Column]) -> Column:
    """A mean that is the value itself where all values are equal; a sum divided by a count may differ from it."""
    low, high = of(F.min), of(F.max)
    return F.when(low == high, low).otherwise(of(F.avg))


def _mean_of(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return F.try_divide(total, F.size(values))


def _features(rows: DataFrame, tl: Timeline, no_history: str, since: str,
              first_repair: str) -> DataFrame:
    fallback = {"null": F.lit(None).cast("double"), "zero": F.lit(0.0),
                "target": F.col("gap_h")}[no_history]
    start = F.col("first_time") if since == "first_record" else F.col("_start")
    repair = F.col("first_repair") if first_repair == "record" else F.col("_start_repair")
    opening = F.col("hist_count") == 0
    days = F.greatest(days_between(start, F.col(tl.time)), F.lit(1.0))
    prev_gap = F.get("_recent", F.lit(0))
    rows = rows.withColumns({
        "hist_mean_gap": F.coalesce("_mean", fallback),
        "hist_std_gap": F.when(F.col("hist_count") >= 2, F.col("_std")).otherwise(F.lit(0.0)),
        "prev_gap": prev_gap,
        "last_gap": F.coalesce(prev_gap, fallback),
        "recent3_gap": F.coalesce(_mean_of(F.col("_recent")), fallback),
        "rolling3_gap": _mean_of(F.slice(F.concat(F.array("gap_h"), F.col("_recent")), 1, FAR)),
        "hist_mean_repair": F.when(opening, repair).otherwise(F.col("_mean_repair")),
        "last_repair": F.when(opening, repair).otherwise(F.col("prev_repair")),
        "days_running": days,
        "hist_rate": F.col("hist_count") / days,
    })
    return rows.drop("_mean", "_std", "_recent", "_mean_repair", "_start", "_start_repair",
                     SEGMENT, "_tail")


def min_records(df: DataFrame, n: int, device: str = "assetnum") -> DataFrame:
    """Rows of devices with at least n records. The counts are pre-aggregated before the shuffle
    and the semi join is left to adaptive skew splitting."""
    return df.join(qualifying_devices(df, n, device), device, "left_semi")


def qualifying_devices(df: DataFrame, n: int, device: str = "assetnum") -> DataFrame:
    counts = df.groupBy(device).agg(F.count(F.lit(1)).alias("_records"))
    return counts.filter(F.col("_records") >= n).select(device)


def min_gap(df: DataFrame, hours: float = 10.0, gap: str = "gap_h") -> DataFrame:
    return df.filter(F.col(gap) >= hours)


def positive_gaps(df: DataFrame, gap: str = "gap_h") -> DataFrame:
    return df.filter(F.col(gap) > 0)


def drop_first_records(df: DataFrame, gap: str = "gap_h") -> DataFrame:
    return df.filter(F.col(gap).isNotNull())


def cut_above_quantile(df: DataFrame, prob: float, value: str = "gap_h", strict: bool = False,
                       hot_rows: int = HOT_ROWS, copied: bool = True) -> DataFrame:
    """Keep values up to (strict: below) an exact quantile of the whole table. See `quantiles` for `copied`."""
    # One row, kept, so that later readers of the result do not look for it again.
    bound = cut_lineage(quantiles(df, value, {"_bound": prob}, hot_rows=hot_rows, copied=copied))
    inside = F.col(value) < F.col("_bound") if strict else F.col(value) <= F.col("_bound")
    return with_totals(df, bound).filter(inside).drop("_bound")


def target_range(df: DataFrame, low: float = 10.0, prob: float = 0.92, value: str = "gap_h",
                 quantile_first: bool = False, hot_rows: int = HOT_ROWS, copied: bool = True) -> DataFrame:
    """Minimum cut and upper-quantile cut; the quantile sees the rows before or after the cut."""
    if not quantile_first:
        return cut_above_quantile(min_gap(df, low, value), prob, value, hot_rows=hot_rows, copied=copied)
    return min_gap(cut_above_quantile(df, prob, value, hot_rows=hot_rows, copied=copied), low, value)
