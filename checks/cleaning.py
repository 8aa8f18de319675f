"""Sources, projection, cleaning filters and scalar expressions."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from checks.base import (DEV, EPOS, GAPS, JUDGE_PERIOD, JUDGED, NAMES, POS, PRED, RAW, WO,
                         DAY_EDGES, dev, ev, log, pred, query, raw, rounded, table, wo)
from gapline.functions import bins, text, times
from gapline.operators import cleaning as c
from gapline.operators import history as h
from gapline.operators.metrics import percentage_error
from gapline.operators.select import feature_pool
from gapline.operators.stats import type_profile
from gapline.plans.cleaning import clean_work_orders, run_cleaning
from gapline.plans.events import with_history_only
from gapline.plans.reports import gap_repair_scatter
from gapline.sources.logs import count_lines, read_result_lines, result_lines, split_lines
from gapline.sources.schema import DEFAULTS, STANDARD_NAMES, TIME_COLUMNS
from gapline.sources.tables import (raw_work_order_drift, read_clean_work_orders, read_csv,
                                    read_raw_work_orders, standard_names, times_as_text, write_table)

OWN = {n: n for n in STANDARD_NAMES}
RULES = c.Rules(period=JUDGE_PERIOD)


def folder_for(spark, name: str) -> str:
    """A new folder: under the session's shared checkpoint folder if it has one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        return tempfile.mkdtemp(prefix=f"gapline-{name}-")
    import uuid
    return f"{shared}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks -------------------------------------------------------------------

@query("s1_load_raw_work_orders", "WITH " + RAW + f" SELECT {NAMES} FROM raw")
def _(spark, d):
    path = folder_for(spark, "raw")
    raw(spark, d).select(*STANDARD_NAMES).write.mode("overwrite").parquet(path)
    return read_raw_work_orders(spark, path)


@query("s2_csv_multiline", """SELECT doc_id, lang, source, CASE WHEN doc_id % 3 = 0
  THEN replace(text, chr(10), chr(13) || chr(10)) ELSE text || chr(13) END AS text, n_chars FROM documents""")
def _(spark, d):
    path = folder_for(spark, "csv")
    spelled = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(
        F.concat("text", F.lit("\r")))
    docs = table(spark, d, "documents").withColumn("text", spelled)
    docs = docs.select("doc_id", "lang", "source", "text", "n_chars")
    write_table(docs, path, "csv")
    return read_csv(spark, path, docs.schema)


@query("s3_csv_sink_clean", "WITH " + JUDGED + f""" SELECT
  {", ".join(f"strftime({n}, '%Y-%m-%d %H:%M:%S') AS {n}" if n in TIME_COLUMNS
   else "nullif(cause_desc, '') AS cause_desc" if n == "cause_desc" else n for n in STANDARD_NAMES)}
  FROM judged WHERE drop_reason IS NULL""")
def _(spark, d):
    path = folder_for(spark, "clean")
    write_table(clean_work_orders(raw(spark, d), RULES), path, "csv")
    return times_as_text(read_clean_work_orders(spark, path, "csv"))


@query("s1_drifting_files", "WITH " + RAW + f""" SELECT
  {", ".join(f"CASE WHEN total_failure_count > 3 THEN {n} END AS {n}" if n in ("repair_end_time", "location")
   else "nullif(cause_desc, '') AS cause_desc" if n == "cause_desc" else n for n in STANDARD_NAMES)} FROM raw""")
def _(spark, d):
    return read_raw_work_orders(spark, _drifting(spark, d, "csv"), "csv")


def _drifting(spark, d, fmt):
    """Two sets of files: some lack two columns and bring one, the others are complete in another order.

    CSV files are many times as large as the tables they are made from, so they are written as gzip.
    """
    path, rows = folder_for(spark, "drift"), raw(spark, d)
    packed = {"compression": "gzip", "max_records_per_file": 500_000} if fmt == "csv" else {}
    few, names = F.col("total_failure_count") <= 3, [F.col(n) for n in reversed(STANDARD_NAMES)]
    write_table(rows.filter(few).drop("repair_end_time", "location"), path, fmt, **packed)
    write_table(rows.filter(~few).select(*names), path, fmt, mode="append", **packed)
    return path


@query("s6_result_lines", """SELECT doc_id, right(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), 250) AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
  WHERE regexp_matches(line, 'error|total|the')""")
def _(spark, d):
    docs = table(spark, d, "documents")
    lines = docs.select("doc_id", F.explode(split_lines(F.col("text"))).alias("line"))
    return result_lines(lines, "line", ("error", "total", "the"))


@query("s6_line_count", """SELECT count(*) AS lines FROM (SELECT unnest(string_split(text, chr(10)))
  FROM documents)""")
def _(spark, d):
    docs = table(spark, d, "documents")
    return count_lines(docs.select(F.explode(split_lines(F.col("text"))).alias("line")))


@query("s6_result_lines_from_files", """SELECT 'MAE=' || CAST(o_orderkey AS VARCHAR) AS value
  FROM orders WHERE o_orderkey % 3 = 0""")
def _(spark, d):
    path = folder_for(spark, "log")
    key = F.col("o_orderkey").cast("string")
    line = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("  MAE="), key, F.lit("\t"))).otherwise(
        F.concat(F.lit("stage "), key))
    table(spark, d, "orders").select(line.alias("value")).write.mode("overwrite").text(path)
    return read_result_lines(spark, path)


# --- projection --------------------------------------------------------------------------

@query("p1_strip_column_names", "SELECT o_orderkey AS wonum, o_custkey AS assetnum FROM orders")
def _(spark, d):
    return c.strip_column_names(table(spark, d, "orders").select(
        F.col("o_orderkey").alias(" wonum"), F.col("o_custkey").alias("assetnum \t")))


@query("p2_standardize_columns", "WITH " + RAW + " SELECT " + ", ".join(
    f'{k} AS "{v}"' for k, v in STANDARD_NAMES.items()) + " FROM raw")
def _(spark, d):
    return c.standardize_columns(raw(spark, d), STANDARD_NAMES)


@query("p2_rename_keep_unmapped", "SELECT o_orderkey AS wonum, o_custkey AS assetnum, o_orderstatus FROM orders")
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return c.standardize_columns(rows, {"o_orderkey": "wonum", "o_custkey": "assetnum"},
                                 keep_unmapped=True)


@query("p3_schema_drift", "WITH " + RAW + """ SELECT 'unmapped' AS issue, 'unmapped' AS "column",
  count(unmapped) AS rows FROM raw UNION ALL SELECT 'missing_core', 'repair_end_time', count(*) FROM raw
  UNION ALL SELECT 'missing_time', 'repair_end_time', count(*) FROM raw""")
def _(spark, d):
    path = folder_for(spark, "drift")
    write_table(raw(spark, d).drop("repair_end_time"), path)
    found = read_raw_work_orders(spark, path, extra=True).drop("repair_end_time")
    return c.schema_drift(found, OWN)


for _f in ("parquet", "csv"):
    @query(f"p3_drift_of_{_f}_files", "WITH " + RAW + """, few AS (SELECT * FROM raw WHERE total_failure_count <= 3)
  SELECT 'unmapped' AS issue, 'unmapped' AS "column", 1 AS layouts, count(unmapped) AS rows FROM few
  UNION ALL SELECT 'missing_core', 'repair_end_time', 1, count(*) FROM few
  UNION ALL SELECT 'missing_time', 'repair_end_time', 1, count(*) FROM few""")
    def _(spark, d, fmt=_f):
        return raw_work_order_drift(spark, _drifting(spark, d, fmt), fmt)


@query("p4_feature_pool", "SELECT o_totalprice, o_orderpriority FROM orders")
def _(spark, d):
    orders = table(spark, d, "orders")
    return orders.select(feature_pool(orders, ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"]))


@query("p5_final_projection", "WITH " + POS + """ SELECT assetnum, repair_duration_hours,
  round(gap_h, 6) AS gap_h FROM pos""")
def _(spark, d):
    rows = h.positive_gaps(h.with_gaps(log(spark, d)))
    return rounded(rows.select("assetnum", "repair_duration_hours", "gap_h"))


@query("p6_drop_columns", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(spark, d):
    return table(spark, d, "orders").drop("o_orderstatus", "o_orderdate", "o_orderpriority")


# --- filters -----------------------------------------------------------------------------

@query("f1_drop_missing_core", "WITH " + RAW + f""" SELECT {NAMES} FROM raw WHERE assetnum IS NOT NULL
  AND NOT regexp_full_match(assetnum, '\\s*') AND current_faildate IS NOT NULL
  AND repair_end_time IS NOT NULL""")
def _(spark, d):
    return c.drop_missing_core(raw(spark, d)).select(*STANDARD_NAMES)


@query("f2_drop_unparsed_core", "WITH " + JUDGED + """ SELECT assetnum, wonum, current_faildate,
  repair_end_time FROM judged WHERE assetnum IS NOT NULL AND current_faildate IS NOT NULL
  AND repair_end_time IS NOT NULL""")
def _(spark, d):
    rows = c.parse_times(c.drop_duplicate_rows(raw(spark, d).select(*STANDARD_NAMES)))
    return c.drop_unparsed_core(rows).select("assetnum", "wonum", "current_faildate",
                                             "repair_end_time")


@query("f3_drop_inverted_times", "WITH " + WO + """ SELECT wonum, current_faildate, repair_end_time
  FROM wo WHERE repair_end_time >= current_faildate""")
def _(spark, d):
    return c.drop_inverted(wo(spark, d)).select("wonum", "current_faildate", "repair_end_time")


@query("f4_keep_period", """SELECT o_orderkey, o_orderdate FROM orders
  WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '2000-12-31'""")
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return c.keep_period(rows, JUDGE_PERIOD, "o_orderdate")


@query("f4_keep_period_whole_last_day", """SELECT event_id, ts FROM events
  WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21'""")
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", "ts")
    return c.keep_period(rows, ("2024-01-05", "2024-01-20"), "ts", end_inclusive_day=True)


@query("f5_drop_negative_repair", "WITH " + RAW + """ SELECT wonum, repair_duration_hours FROM raw
  WHERE coalesce(repair_duration_hours >= 0, true)""")
def _(spark, d):
    return c.drop_negative_repair(raw(spark, d)).select("wonum", "repair_duration_hours")


@query("f6_drop_first_records", "WITH " + GAPS + " SELECT assetnum, wonum, gap_h FROM gaps WHERE gap_h IS NOT NULL")
def _(spark, d):
    return h.drop_first_records(h.with_gaps(log(spark, d))).select("assetnum", "wonum", "gap_h")


@query("f7_positive_gaps", "WITH " + POS + " SELECT assetnum, wonum, gap_h FROM pos")
def _(spark, d):
    return h.positive_gaps(h.with_gaps(log(spark, d))).select("assetnum", "wonum", "gap_h")


def _egaps(spark, d):
    from checks.base import EVENT_TIME
    return h.positive_gaps(h.with_gaps(ev(spark, d), EVENT_TIME))


@query("f8_min_gap", "WITH " + EPOS + " SELECT event_id, round(gap_h, 6) AS gap_h FROM epos WHERE gap_h >= 10")
def _(spark, d):
    return rounded(h.min_gap(_egaps(spark, d)).select("event_id", "gap_h"))


@query("f9_cut_after_minimum", "WITH " + EPOS + """, low AS (SELECT * FROM epos WHERE gap_h >= 10)
  SELECT event_id, round(gap_h, 6) AS gap_h FROM low
  WHERE gap_h <= (SELECT quantile_cont(gap_h, 0.92) FROM low)""")
def _(spark, d):
    return rounded(h.target_range(_egaps(spark, d)).select("event_id", "gap_h"))


@query("f9_cut_before_minimum", "WITH " + POS + """ SELECT wonum, gap_h FROM pos WHERE gap_h >= 10
  AND gap_h <= (SELECT quantile_cont(gap_h, 0.99) FROM pos)""")
def _(spark, d):
    rows = h.positive_gaps(h.with_gaps(log(spark, d)))
    return h.target_range(rows, prob=0.99, quantile_first=True).select("wonum", "gap_h")


@query("f9_cut_strict", "WITH " + POS + """ SELECT wonum, gap_h FROM pos
  WHERE gap_h < (SELECT quantile_cont(gap_h, 0.95) FROM pos)""")
def _(spark, d):
    rows = h.positive_gaps(h.with_gaps(log(spark, d)))
    return h.cut_above_quantile(rows, 0.95, strict=True).select("wonum", "gap_h")


@query("f10_drop_without_history", "WITH " + POS + """, hp AS (SELECT *, lag(gap_h) OVER
  (PARTITION BY assetnum ORDER BY current_faildate, wonum) AS last_gap FROM pos)
  SELECT wonum, gap_h, last_gap FROM hp WHERE last_gap > 0""")
def _(spark, d):
    rows = h.with_history(log(spark, d), no_history="zero")
    return with_history_only(rows).select("wonum", "gap_h", "last_gap")


@query("f11_drop_any_null", "WITH " + RAW + """ SELECT wonum, cust_brand, problemcode,
  repair_duration_hours FROM raw WHERE cust_brand IS NOT NULL AND problemcode IS NOT NULL
  AND repair_duration_hours IS NOT NULL""")
def _(spark, d):
    rows = raw(spark, d).select("wonum", "cust_brand", "problemcode", "repair_duration_hours")
    return rows.dropna("any")


for _n in (2, 3, 5):
    @query(f"f12_min_records_{_n}", f"""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN
      (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= {_n})""")
    def _(spark, d, n=_n):
        rows = table(spark, d, "orders").select("o_orderkey", "o_custkey")
        return h.min_records(rows, n, "o_custkey")


@query("f14_short_repairs_of_sample", "WITH " + POS + """, part AS (SELECT wonum, repair_duration_hours, gap_h
  FROM pos ORDER BY md5(concat(CAST(wonum AS VARCHAR), ':42')), wonum LIMIT 3000)
  SELECT * FROM part WHERE repair_duration_hours <= 250""")
def _(spark, d):
    rows = h.positive_gaps(h.with_gaps(log(spark, d)))
    return gap_repair_scatter(rows, ["wonum"], "repair_duration_hours", max_repair=250)


@query("f15_metric_mask", "WITH " + PRED + """ SELECT count(*) FILTER (actual > 2000) AS rows,
  round(avg(abs((actual - mid) / actual) * 100) FILTER (actual > 2000), 6) AS mape FROM pred""")
def _(spark, d):
    ape = percentage_error("actual", "mid", 2000)
    return rounded(pred(spark, d).agg(F.count(ape).alias("rows"), F.avg(ape).alias("mape")))


# --- cleaning as a whole -----------------------------------------------------------------

@query("x1_drop_duplicates", "WITH " + RAW + f" SELECT DISTINCT {NAMES} FROM raw")
def _(spark, d):
    return c.drop_duplicate_rows(raw(spark, d).select(*STANDARD_NAMES))


@query("cleaned_work_orders", "WITH " + JUDGED + f" SELECT {NAMES} FROM judged WHERE drop_reason IS NULL")
def _(spark, d):
    return clean_work_orders(raw(spark, d), RULES)


def _judged(spark, d):
    return c.judge_rows(c.standardize_columns(raw(spark, d), OWN), RULES)


@query("cleaned_work_orders_from_job", "WITH " + JUDGED + f" SELECT {NAMES} FROM judged WHERE drop_reason IS NULL")
def _(spark, d):
    path = folder_for(spark, "job")
    run_cleaning(raw(spark, d), path, rules=RULES)
    return read_clean_work_orders(spark, path)


@query("a19_cleaning_audit", "WITH " + JUDGED + """, n AS (SELECT sum(copies) AS total,
  sum(copies) - count(*) AS d0, count(*) FILTER (drop_reason = 'missing_core') AS d1,
  count(*) FILTER (drop_reason = 'inverted_times') AS d2,
  count(*) FILTER (drop_reason = 'outside_period') AS d3,
  count(*) FILTER (drop_reason = 'unparsed_core') AS d4,
  count(*) FILTER (drop_reason = 'negative_repair') AS d5 FROM judged),
 s AS (SELECT 0 AS step_no, 'duplicate' AS step, total AS b, d0 AS x FROM n
  UNION ALL SELECT 1, 'missing_core', total - d0, d1 FROM n
  UNION ALL SELECT 2, 'inverted_times', total - d0 - d1, d2 FROM n
  UNION ALL SELECT 3, 'outside_period', total - d0 - d1 - d2, d3 FROM n
  UNION ALL SELECT 4, 'unparsed_core', total - d0 - d1 - d2 - d3, d4 FROM n
  UNION ALL SELECT 5, 'negative_repair', total - d0 - d1 - d2 - d3 - d4, d5 FROM n)
 SELECT step_no, step, CAST(b AS BIGINT) AS rows_before, CAST(x AS BIGINT) AS dropped,
  CAST(b - x AS BIGINT) AS rows_after FROM s""")
def _(spark, d):
    return c.cleaning_audit(_judged(spark, d))


@query("a19_unparsed_times", "WITH " + JUDGED + """, t AS (SELECT j.drop_reason, o.current_faildate AS text,
    j.current_faildate AS parsed FROM judged j JOIN once o ON j.wonum = o.wonum
    AND j.total_failure_count = o.total_failure_count AND j.copies = o.copies
    AND coalesce(j.assetnum, '') = coalesce(o.assetnum, '')),
  n AS (SELECT count(*) FILTER (parsed IS NULL AND NOT regexp_full_match(text, '\\s*')) AS n,
    count(*) FILTER (parsed IS NULL AND NOT regexp_full_match(text, '\\s*') AND drop_reason IS NOT NULL) AS d FROM t)
 SELECT 'current_faildate' AS "column", n AS unparsed, d AS dropped FROM n
 UNION ALL SELECT c, 0, 0 FROM (VALUES ('prev_faildate'), ('repair_start_time'), ('repair_end_time'),
   ('start_of_operation')) t(c)""")
def _(spark, d):
    return c.unparsed_times(_judged(spark, d))


@query("a20_cleaning_summary", "WITH " + JUDGED + """ SELECT CAST(sum(copies) AS BIGINT) AS rows_in,
  count(*) FILTER (drop_reason IS NULL) AS rows_out,
  CAST(sum(copies) - count(*) FILTER (drop_reason IS NULL) AS BIGINT) AS dropped,
  round(100.0 * count(*) FILTER (drop_reason IS NULL) / sum(copies), 6) AS kept_percent,
  29 AS columns_out FROM judged""")
def _(spark, d):
    return rounded(c.cleaning_summary(_judged(spark, d)))


@query("v4_time_columns_ready", "SELECT false AS before, true AS after, count(*) AS rows FROM (WITH "
       + RAW + " SELECT 1 FROM raw)")
def _(spark, d):
    rows = raw(spark, d)
    names = ["current_faildate", "repair_end_time"]
    parsed = rows if c.time_columns_ready(rows, names) else c.parse_times(rows, names)
    return parsed.agg(F.lit(c.time_columns_ready(rows, names)).alias("before"),
                      F.lit(c.time_columns_ready(parsed, names)).alias("after"),
                      F.count(F.lit(1)).alias("rows"))


# --- scalar expressions ------------------------------------------------------------------

@query("c1_blank_to_null", """SELECT doc_id, CASE WHEN NOT regexp_full_match(line, '\\s*') THEN line END AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)""")
def _(spark, d):
    lines = table(spark, d, "documents").select(
        "doc_id", F.explode(split_lines(F.col("text"))).alias("line"))
    return lines.withColumn("line", text.blank_to_null(F.col("line")))


@query("c2_strip", "WITH " + RAW + """ SELECT wonum,
  regexp_replace(current_faildate, '^\\s+|\\s+$', '', 'g') AS stripped FROM raw""")
def _(spark, d):
    return raw(spark, d).select("wonum", text.strip(F.col("current_faildate")).alias("stripped"))


@query("c3_parse_mixed_times", "WITH " + JUDGED + " SELECT wonum, copies, current_faildate, start_of_operation FROM judged")
def _(spark, d):
    rows = c.parse_times(raw(spark, d).select(*STANDARD_NAMES))
    return rows.groupBy("wonum", "current_faildate", "start_of_operation").agg(
        F.count(F.lit(1)).alias("copies"))


@query("c4_format_time", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", times.format_time(F.col("ts")).alias("ts"))


@query("c5_c6_c7_c8_calendar", """SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour,
  CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(month(ts) AS INTEGER) AS month,
  CAST(quarter(ts) AS INTEGER) AS quarter, CAST(isodow(ts) >= 6 AS INTEGER) AS weekend,
  CASE WHEN hour(ts) >= 7 AND hour(ts) < 9 THEN 0 WHEN hour(ts) >= 9 AND hour(ts) < 17 THEN 1
    WHEN hour(ts) >= 17 AND hour(ts) < 20 THEN 2 ELSE 3 END AS day_period FROM events""")
def _(spark, d):
    parts = times.calendar(F.col("ts"))
    return table(spark, d, "events").select("event_id", *[v.alias(n) for n, v in parts.items()])


@query("c5_month_quarter_of_orders", """SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS month,
  CAST(quarter(o_orderdate) AS INTEGER) AS quarter FROM orders""")
def _(spark, d):
    parts = times.calendar(F.col("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", parts["month"].alias("month"),
                                            parts["quarter"].alias("quarter"))


@query("c9_response_hours", "WITH " + WO + """ SELECT wonum, round(CASE
  WHEN date_diff('microsecond', current_faildate, repair_start_time) < 0 THEN 0
  ELSE date_diff('microsecond', current_faildate, repair_start_time) / 3.6e9 END, 6) AS response_h FROM wo""")
def _(spark, d):
    hours = times.response_hours(F.col("current_faildate"), F.col("repair_start_time"))
    return rounded(wo(spark, d).select("wonum", hours.alias("response_h")))


@query("c10_clip", """SELECT o_orderkey, CASE WHEN o_totalprice < 5e4 THEN 5e4 WHEN o_totalprice > 4e5
  THEN 4e5 ELSE o_totalprice END AS price FROM orders""")
def _(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", bins.clip(F.col("o_totalprice"), 5e4, 4e5).alias("price"))


@query("c11_fill_defaults", "WITH " + RAW + " SELECT wonum, " + ", ".join(
    f"coalesce({n}, '{v}') AS {n}" for n, v in DEFAULTS.items()) + " FROM raw")
def _(spark, d):
    return c.fill_defaults(raw(spark, d)).select("wonum", *DEFAULTS)


@query("c13_log_target", "WITH " + DEV + """ SELECT assetnum, round(ln(1 + avg_mtbf_h), 6) AS y,
  round(exp(ln(1 + avg_mtbf_h)) - 1, 6) AS back FROM dev""")
def _(spark, d):
    y = F.log1p("avg_mtbf_h")
    return rounded(dev(spark, d).select("assetnum", y.alias("y"), F.expm1(y).alias("back")))


@query("c14_units", "WITH " + GAPS + """ SELECT wonum, gap_h * 3600 AS seconds, gap_h AS hours,
  round(gap_h / 24, 6) AS days, date_diff('microsecond', first_time, current_faildate) // 86400000000 AS whole_days
  FROM gaps""")
def _(spark, d):
    rows = h.with_gaps(log(spark, d))
    return rounded(rows.select(
        "wonum", (F.col("gap_h") * 3600).alias("seconds"), F.col("gap_h").alias("hours"),
        (F.col("gap_h") / 24).alias("days"),
        times.whole_days_between(F.col("first_time"), F.col("current_faildate")).alias("whole_days")))


@query("c15_right_closed_bins", "WITH " + DEV + """ SELECT assetnum, CASE
  WHEN x > 0 AND x <= 100 THEN 0 WHEN x > 100 AND x <= 150 THEN 1 WHEN x > 150 AND x <= 200 THEN 2
  WHEN x > 200 AND x <= 300 THEN 3 WHEN x > 300 AND x <= 9999 THEN 4 END AS stratum,
  CASE WHEN x > 0 AND x <= 15 THEN 0 WHEN x > 15 AND x <= 23 THEN 1 WHEN x > 23 AND x <= 30 THEN 2
  WHEN x > 30 AND x <= 40 THEN 3 WHEN x > 40 AND x <= 999 THEN 4 END AS default_stratum
  FROM (SELECT assetnum, avg_mtbf_h / 24 AS x FROM dev)""")
def _(spark, d):
    days = F.col("avg_mtbf_h") / 24
    return dev(spark, d).select("assetnum", bins.right_closed_bin(days, DAY_EDGES).alias("stratum"),
                                bins.right_closed_bin(days).alias("default_stratum"))


@query("c16_cast", """SELECT CAST(o_orderkey AS VARCHAR) AS key_text, CAST(o_custkey AS DOUBLE) AS device_number
  FROM orders""")
def _(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key_text"),
                                            F.col("o_custkey").cast("double").alias("device_number"))


@query("c17_round", "WITH " + DEV + " SELECT assetnum, round(std_mtbf_h, 4) AS std_mtbf_h FROM dev")
def _(spark, d):
    return dev(spark, d).select("assetnum", F.round("std_mtbf_h", 4).alias("std_mtbf_h"))


@query("c18_accuracy_tier", "WITH " + PRED + """ SELECT assetnum, CASE WHEN a >= 80 THEN 'excellent'
  WHEN a >= 70 THEN 'good' WHEN a >= 65 THEN 'pass' ELSE 'below' END AS tier FROM
  (SELECT assetnum, 100 - abs((actual - mid) / actual) * 100 AS a FROM pred)""")
def _(spark, d):
    accuracy = 100 - percentage_error("actual", "mid", 0.01)
    return pred(spark, d).select("assetnum", bins.tier(accuracy).alias("tier"))


@query("a25_numeric_columns", """SELECT t.*, (SELECT count(*) FROM orders) AS rows FROM (VALUES
  ('o_orderkey', 'bigint', true), ('o_custkey', 'bigint', true), ('o_orderstatus', 'string', false),
  ('o_totalprice', 'double', true), ('o_orderdate', 'timestamp_ntz', false),
  ('o_orderpriority', 'string', false)) t("column", type, is_numeric)""")
def _(spark, d):
    return type_profile(table(spark, d, "orders"))


@query("standard_names_round_trip", "WITH " + JUDGED + """ SELECT wonum AS 工单号, current_faildate AS 故障时间,
  repair_duration_hours AS 维修时长_小时 FROM judged WHERE drop_reason IS NULL""")
def _(spark, d):
    rows = clean_work_orders(raw(spark, d), RULES)
    return standard_names(rows).select("工单号", "故障时间", "维修时长_小时")
