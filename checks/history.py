"""Gaps, histories, device tables and the event-level modelling tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import (BAND, DEV, EPOS, EGAPS, EVENT_TIME, GAPS, HIST, POS, PRED, WO, days_sql,
                         dev, ev, gaps_sql, history_sql, log, pred, query, rounded, wo)
from gapline.operators import devices as dv
from gapline.operators import history as h
from gapline.operators.split import thin
from gapline.operators.stats import null_total, gaps_not_positive
from gapline.plans import events as pe

HOT = 15         # forces the segmented plan on most devices of the test data
EVENT_HOT = 60

_GAP_COLUMNS = "assetnum, wonum, record_no, first_time, first_repair, gap_h"
_GAPS_SQL = "WITH " + GAPS + f" SELECT {_GAP_COLUMNS} FROM gaps"


@query("w1_gaps", _GAPS_SQL)
def _(spark, d):
    return h.with_gaps(log(spark, d)).select(*_GAP_COLUMNS.split(", "))


@query("w1_gaps_hot_devices", _GAPS_SQL)
def _(spark, d):
    return h.with_gaps(log(spark, d), hot_rows=HOT).select(*_GAP_COLUMNS.split(", "))


_EGAPS_SQL = "WITH " + EGAPS + """ SELECT event_id, user_id, record_no, first_time,
  round(gap_h, 6) AS gap_h FROM egaps"""


@query("w1_event_gaps", _EGAPS_SQL)
def _(spark, d):
    rows = h.with_gaps(ev(spark, d), EVENT_TIME)
    return rounded(rows.select("event_id", "user_id", "record_no", "first_time", "gap_h"))


def _history_sql(last: str, mean: str, recent: str, days: str, start_repair: str,
                 source: str = HIST) -> str:
    return "WITH " + source + f""" SELECT assetnum, wonum, gap_h, hist_count,
  round({mean}, 6) AS hist_mean_gap,
  round(CASE WHEN hist_count >= 2 THEN hs ELSE 0 END, 6) AS hist_std_gap,
  round({last}, 6) AS last_gap, round({recent}, 6) AS recent3_gap,
  round(rolling3_gap, 6) AS rolling3_gap, prev_gap, prev_repair,
  round(CASE WHEN hist_count = 0 THEN {start_repair} ELSE rm END, 6) AS hist_mean_repair,
  CASE WHEN hist_count = 0 THEN {start_repair} ELSE prev_repair END AS last_repair,
  round({days}, 6) AS days_running, round(hist_count / {days}, 6) AS hist_rate FROM hist"""


_HISTORY_COLUMNS = ("assetnum", "wonum", "gap_h", "hist_count", "hist_mean_gap", "hist_std_gap",
                    "last_gap", "recent3_gap", "rolling3_gap", "prev_gap", "prev_repair",
                    "hist_mean_repair", "last_repair", "days_running", "hist_rate")
_TRUE_FIRST = days_sql("first_time", "current_faildate")
_KEPT_FIRST = days_sql("kept_time", "current_faildate")
_NULL_SQL = _history_sql("prev_gap", "hm", "r3", _TRUE_FIRST, "kept_repair")
_TARGET_SQL = _history_sql("coalesce(prev_gap, gap_h)", "coalesce(hm, gap_h)",
                           "coalesce(r3, gap_h)", _KEPT_FIRST, "kept_repair")
_ZERO_SQL = _history_sql("coalesce(prev_gap, 0)", "coalesce(hm, 0)", "coalesce(r3, 0)",
                         _TRUE_FIRST, "kept_repair")
_KEEP = GAPS + ", nonull AS (SELECT * FROM gaps WHERE gap_h IS NOT NULL), " + history_sql(
    "nonull", "assetnum", "current_faildate", "wonum", "repair_duration_hours")
_KEEP_SQL = _history_sql("coalesce(prev_gap, gap_h)", "coalesce(hm, gap_h)",
                         "coalesce(r3, gap_h)", _TRUE_FIRST, "first_repair", _KEEP)


def _history(spark, d, **options):
    return rounded(h.with_history(log(spark, d), **options).select(*_HISTORY_COLUMNS))


@query("w2_to_w9_history", _NULL_SQL)
def _(spark, d):
    return _history(spark, d)


@query("w2_to_w9_history_hot_devices", _NULL_SQL)
def _(spark, d):
    return _history(spark, d, hot_rows=HOT)


@query("w4_to_w9_history_target_fallback", _TARGET_SQL)
def _(spark, d):
    return _history(spark, d, no_history="target", since="first_retained")


@query("w4_to_w9_history_zero_fallback", _ZERO_SQL)
def _(spark, d):
    return _history(spark, d, no_history="zero")


@query("w4_to_w9_history_zero_gaps_kept", _KEEP_SQL)
def _(spark, d):
    return _history(spark, d, zero_gaps="keep", no_history="target", first_repair="record")


@query("w4_to_w9_history_zero_gaps_kept_hot_devices", _KEEP_SQL)
def _(spark, d):
    return _history(spark, d, zero_gaps="keep", no_history="target", first_repair="record",
                    hot_rows=HOT)


_EHIST = EPOS + ", " + history_sql("epos", "user_id", "ts", "event_id", "hours")
_EHIST_SQL = "WITH " + _EHIST + """ SELECT event_id, hist_count, round(hm, 6) AS hist_mean_gap,
  round(CASE WHEN hist_count >= 2 THEN hs ELSE 0 END, 6) AS hist_std_gap,
  round(prev_gap, 6) AS last_gap, round(r3, 6) AS recent3_gap FROM hist"""
_EHIST_COLUMNS = ("event_id", "hist_count", "hist_mean_gap", "hist_std_gap", "last_gap", "recent3_gap")


@query("w4_event_history", _EHIST_SQL)
def _(spark, d):
    return rounded(h.with_history(ev(spark, d), EVENT_TIME).select(*_EHIST_COLUMNS))


@query("w4_event_history_hot_devices", _EHIST_SQL)
def _(spark, d):
    return rounded(h.with_history(ev(spark, d), EVENT_TIME, hot_rows=EVENT_HOT)
                   .select(*_EHIST_COLUMNS))


_W2_SQL = "WITH " + HIST + """ SELECT wonum, prev_gap, prev_repair FROM hist"""


@query("w2_previous_values", _W2_SQL)
def _(spark, d):
    return h.with_history(log(spark, d)).select("wonum", "prev_gap", "prev_repair")


@query("w3_rolling_three", "WITH " + HIST + " SELECT wonum, round(rolling3_gap, 6) AS rolling3_gap FROM hist")
def _(spark, d):
    return rounded(h.with_history(log(spark, d)).select("wonum", "rolling3_gap"))


_THIN_SQL = "WITH " + PRED + """ SELECT assetnum, round(mid, 6) AS mid FROM
  (SELECT *, row_number() OVER (ORDER BY mid, assetnum) AS n FROM pred) WHERE (n - 1) % 5 = 0"""


@query("w10_every_fifth", _THIN_SQL)
def _(spark, d):
    return rounded(thin(pred(spark, d), ["mid", "assetnum"]).select("assetnum", "mid"))


@query("w10_every_fifth_in_segments", _THIN_SQL)
def _(spark, d):
    return rounded(thin(pred(spark, d), ["mid", "assetnum"], hot_rows=300).select("assetnum", "mid"))


@query("o1_order_by_device_and_time", "WITH " + GAPS + " SELECT assetnum, wonum, record_no FROM gaps")
def _(spark, d):
    return h.with_gaps(log(spark, d)).select("assetnum", "wonum", "record_no")


# --- devices -----------------------------------------------------------------------------

_BAND_SQL = "WITH " + BAND + """, ok AS (SELECT assetnum FROM band GROUP BY assetnum
  HAVING count(*) FILTER (gap_h > 0) >= 3 AND count(*) FILTER (in_band) >= 3)
  SELECT assetnum, wonum, gap_h, round(band_high, 6) AS band_high FROM band
  WHERE in_band AND assetnum IN (SELECT assetnum FROM ok)"""


@query("f13_band_filter", _BAND_SQL)
def _(spark, d):
    return rounded(dv.band_filter(log(spark, d)).select("assetnum", "wonum", "gap_h", "band_high"))


@query("f13_band_filter_hot_devices", _BAND_SQL)
def _(spark, d):
    rows = dv.band_filter(log(spark, d), hot_rows=HOT)
    return rounded(rows.select("assetnum", "wonum", "gap_h", "band_high"))


_DEV_SQL = "WITH " + DEV + """ SELECT assetnum, n_failures, round(std_mtbf_h, 6) AS std_mtbf_h,
  min_mtbf_h, max_mtbf_h, round(avg_repair_h, 6) AS avg_repair_h, max_repair_h, aging_days,
  round(fail_rate_monthly, 6) AS fail_rate_monthly, station, brand, line,
  round(avg_mtbf_h, 6) AS avg_mtbf_h FROM dev"""


@query("a4_device_mtbf", _DEV_SQL)
def _(spark, d):
    return rounded(dev(spark, d))


@query("a4_device_mtbf_hot_devices", _DEV_SQL)
def _(spark, d):
    return rounded(dev(spark, d, hot_rows=HOT))


_STATS = POS + """, stats AS (SELECT assetnum, count(*) AS device_failures,
  avg(repair_duration_hours) AS device_mean_repair,
  coalesce(stddev_samp(repair_duration_hours), 0) AS device_std_repair,
  avg(gap_h) AS device_mean_gap, coalesce(stddev_samp(gap_h), 0) AS device_std_gap,
  date_diff('microsecond', min(current_faildate), max(current_faildate)) / 8.64e10 AS device_days
  FROM pos GROUP BY assetnum)"""
_STATS_COLUMNS = """device_failures, round(device_mean_repair, 6) AS device_mean_repair,
  round(device_std_repair, 6) AS device_std_repair, round(device_mean_gap, 6) AS device_mean_gap,
  round(device_std_gap, 6) AS device_std_gap, device_days,
  round(device_failures / greatest(device_days, 1), 6) AS device_daily_rate"""


@query("a3_device_stats", "WITH " + _STATS + f" SELECT assetnum, {_STATS_COLUMNS} FROM stats")
def _(spark, d):
    return rounded(dv.device_stats(h.positive_gaps(h.with_gaps(log(spark, d)))))


@query("j2_stats_joined_to_events", "WITH " + _STATS + f""" SELECT assetnum, wonum, gap_h, {_STATS_COLUMNS}
  FROM pos LEFT JOIN stats USING (assetnum)""")
def _(spark, d):
    rows = dv.with_device_stats(h.positive_gaps(h.with_gaps(log(spark, d))))
    return rounded(rows.select("assetnum", "wonum", "gap_h", *[x for x in rows.columns
                                                               if x.startswith("device_")]))


@query("v1_gaps_not_positive", "WITH " + POS + " SELECT count(*) FILTER (gap_h <= 0) AS violations FROM pos")
def _(spark, d):
    return gaps_not_positive(h.positive_gaps(h.with_gaps(log(spark, d))))


# --- event-level modelling tables --------------------------------------------------------

_WGAPS = WO + ", " + gaps_sql("wo", "assetnum", "current_faildate", "wonum", "repair_duration_hours")
_WPOS = _WGAPS + ", pos AS (SELECT * FROM gaps WHERE gap_h > 0)"
_PARTS = """CAST(hour(current_faildate) AS INTEGER) AS hour,
  CAST(isodow(current_faildate) - 1 AS INTEGER) AS weekday,
  CAST(month(current_faildate) AS INTEGER) AS month"""
_WEEKEND = "CAST(isodow(current_faildate) >= 6 AS INTEGER) AS weekend"
_REPAIR = """repair_duration_hours AS repair_h, greatest(date_diff('microsecond', current_faildate,
  repair_start_time) / 3.6e9, 0) AS response_h, CAST(repair_type = 'CBM' AS INTEGER) AS is_cbm"""


def _wo_history(source: str) -> str:
    return history_sql(source, "assetnum", "current_faildate", "wonum", "repair_duration_hours")


_V2_SQL = "WITH " + _WPOS + ", " + _wo_history("pos") + f""", coded AS (SELECT *,
  CAST(dense_rank() OVER (ORDER BY cust_brand) - 1 AS INTEGER) AS brand_code,
  CAST(dense_rank() OVER (ORDER BY cust_subsys) - 1 AS INTEGER) AS subsystem_code,
  CAST(dense_rank() OVER (ORDER BY failurecode_name) - 1 AS INTEGER) AS fault_code,
  count(*) OVER (PARTITION BY problemcode_name) / count(*) OVER () AS problem_freq,
  count(*) OVER (PARTITION BY cust_linenum) / count(*) OVER () AS line_freq FROM hist),
 low AS (SELECT * FROM coded WHERE gap_h >= 10)
 SELECT assetnum, {_PARTS}, {_WEEKEND}, {_REPAIR}, hist_count,
  round(coalesce(hm, gap_h), 6) AS hist_mean_gap, coalesce(prev_gap, gap_h) AS last_gap,
  round(coalesce(r3, gap_h), 6) AS recent3_gap,
  round(CASE WHEN hist_count = 0 THEN kept_repair ELSE rm END, 6) AS hist_mean_repair,
  CASE WHEN hist_count = 0 THEN kept_repair ELSE prev_repair END AS last_repair,
  round({_KEPT_FIRST}, 6) AS days_running, round(hist_count / {_KEPT_FIRST}, 6) AS hist_rate,
  brand_code, subsystem_code, fault_code, round(problem_freq, 8) AS problem_freq,
  round(line_freq, 8) AS line_freq, gap_h FROM low
 WHERE gap_h <= (SELECT quantile_cont(gap_h, 0.92) FROM low)"""


def _six(df):
    wide = {"problem_freq": 8, "line_freq": 8}
    return df.select(*[F.round(c, wide.get(c, 6)).alias(c) if t == "double" else F.col(c)
                       for c, t in df.dtypes])


@query("event_table_2_history", _V2_SQL)
def _(spark, d):
    return _six(pe.history_events(wo(spark, d), no_history="target"))


_V3_SQL = "WITH " + _WGAPS + """, many AS (SELECT * FROM gaps WHERE gap_h IS NOT NULL AND assetnum IN
  (SELECT assetnum FROM wo GROUP BY assetnum HAVING count(*) >= 3)), """ + _wo_history("many") + f""",
 low AS (SELECT * FROM hist WHERE gap_h >= 10)
 SELECT assetnum, {_PARTS}, {_WEEKEND}, {_REPAIR}, hist_count,
  round(coalesce(hm, gap_h), 6) AS hist_mean_gap,
  round(CASE WHEN hist_count >= 2 THEN hs ELSE 0 END, 6) AS hist_std_gap,
  round(CASE WHEN hist_count = 0 THEN first_repair ELSE rm END, 6) AS hist_mean_repair,
  coalesce(prev_gap, gap_h) AS last_gap,
  CASE WHEN hist_count = 0 THEN first_repair ELSE prev_repair END AS last_repair,
  round(coalesce(r3, gap_h), 6) AS recent3_gap,
  round({_TRUE_FIRST}, 6) AS days_running, round(hist_count / {_TRUE_FIRST}, 6) AS hist_rate,
  cust_brand, cust_subsys, failurecode_name, problemcode_name, cust_linenum, gap_h FROM low
 WHERE gap_h <= (SELECT quantile_cont(gap_h, 0.92) FROM low)"""


@query("event_table_3_history_raw", _V3_SQL)
def _(spark, d):
    return _six(pe.history_events_raw(wo(spark, d), no_history="target"))


@query("event_table_3_hot_devices", _V3_SQL)
def _(spark, d):
    return _six(pe.history_events_raw(wo(spark, d), no_history="target", hot_rows=60))


_V4_SQL = "WITH " + _WPOS + ", " + _wo_history("pos") + f""",
 known AS (SELECT * FROM hist WHERE prev_gap > 0)
 SELECT assetnum, {_PARTS}, {_REPAIR}, hist_count, prev_gap AS last_gap,
  round(hm, 6) AS hist_mean_gap, round({_TRUE_FIRST}, 6) AS days_running,
  round(hist_count / {_TRUE_FIRST}, 6) AS hist_rate, station_name, cust_brand, gap_h FROM known
 WHERE gap_h >= 10 AND gap_h <= (SELECT quantile_cont(gap_h, 0.99) FROM known)"""


@query("event_table_4_control", _V4_SQL)
def _(spark, d):
    return _six(pe.event_control(wo(spark, d)))




_V1_SQL = "WITH " + _WPOS + ", " + _wo_history("pos") + f""", stats AS (SELECT assetnum,
  count(*) / greatest(date_diff('microsecond', min(current_faildate), max(current_faildate)) / 8.64e10, 1)
    AS device_daily_rate, avg(repair_duration_hours) AS device_mean_repair FROM pos GROUP BY assetnum)
 SELECT assetnum, {_REPAIR}, total_failure_count,
  round(device_daily_rate, 6) AS device_daily_rate, round(rolling3_gap, 6) AS rolling3_gap,
  CAST(coalesce(prev_gap, (SELECT median(prev_gap) FROM hist)) AS DOUBLE) AS prev_gap,
  coalesce(prev_repair, (SELECT median(prev_repair) FROM hist)) AS prev_repair,
  round(device_mean_repair, 6) AS device_mean_repair, {_PARTS.split(",", 3)[0]},
  CAST(isodow(current_faildate) - 1 AS INTEGER) AS weekday, {_WEEKEND},
  CAST(hour(current_faildate) IN (7, 8) AS INTEGER) AS period_morning_peak,
  CAST(hour(current_faildate) BETWEEN 9 AND 16 AS INTEGER) AS period_daytime,
  CAST(hour(current_faildate) BETWEEN 17 AND 19 AS INTEGER) AS period_evening_peak,
  CAST(hour(current_faildate) < 7 OR hour(current_faildate) > 19 AS INTEGER) AS period_night, gap_h
 FROM hist JOIN stats USING (assetnum)"""


# The SQL lists the features that the screening leaves of the sf0.01 tables; other sizes may
# keep others.
@query("event_table_1_screened", _V1_SQL)
def _(spark, d):
    return rounded(pe.screened_events(wo(spark, d))[0])


@query("v2_no_nulls_in_modelling_table", "SELECT CAST(0 AS BIGINT) AS nulls")
def _(spark, d):
    return null_total(pe.history_events(wo(spark, d), no_history="target"))
