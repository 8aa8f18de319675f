"""Work-order views of the test tables, written once for Spark and once in SQL.

log   one row per order: the customer is the device, the order its failure
wo    one row per order line with the line's part, customer and nation: a full work order
raw   wo as it would arrive: text times in several spellings, nulls, blanks, copies
ev    one row per event: the user is the device
dev   the device table built from log
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.operators.devices import device_mtbf
from gapline.operators.history import Timeline
from gapline.sources.schema import DEFAULTS, STANDARD_NAMES, TIME_COLUMNS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LOG_TIME = Timeline()
EVENT_TIME = Timeline("user_id", "ts", ("event_id",), "hours")
DAY_EDGES = (0, 100, 150, 200, 300, 9999)   # device mean gaps in the test data run 45 to 464 days


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say it, its oracle."""
    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c)
                       for c, t in df.dtypes])


def log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("assetnum"), F.col("o_orderkey").alias("wonum"),
        F.col("o_orderdate").alias("current_faildate"),
        F.floor(F.col("o_totalprice") / 1000).cast("double").alias("repair_duration_hours"),
        F.col("o_orderpriority").alias("cust_brand"),
        F.when(F.col("o_orderstatus") == "F", "CBM").otherwise("CM").alias("repair_type"),
        F.col("o_orderstatus").alias("cust_linenum"),
        F.substring("o_orderpriority", 1, 1).alias("station_name"))


LOG = """log AS (SELECT o_custkey AS assetnum, o_orderkey AS wonum, o_orderdate AS current_faildate,
  floor(o_totalprice / 1000) AS repair_duration_hours, o_orderpriority AS cust_brand,
  CASE WHEN o_orderstatus = 'F' THEN 'CBM' ELSE 'CM' END AS repair_type,
  o_orderstatus AS cust_linenum, substr(o_orderpriority, 1, 1) AS station_name FROM orders)"""


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with their order, customer, nation and part. Orders meet their customers before the lines do, and the
    lines, narrow at first, take the wide columns of parts last: they move twice before they go to their device."""
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    orders = (
        table(spark, folder, "orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey")))
    return (
        table(spark, folder, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey")))


def wo(spark: SparkSession, folder: str, with_order: bool = False) -> DataFrame:
    shift = F.col("l_linenumber") * 37 + F.col("l_partkey") % 24
    number = F.concat_ws("-", *[F.col(c).cast("string") for c in (
        "o_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
        F.date_format("l_shipdate", "yyyyMMdd"))
    return _lines(spark, folder).select(
        F.col("o_custkey").alias("assetnum"), number.alias("wonum"),
        F.col("n_name").alias("station_name"),
        F.col("c_nationkey").cast("string").alias("cust_linenum"),
        F.timestamp_add("HOUR", shift, "o_orderdate").alias("current_faildate"),
        F.col("l_shipdate").alias("repair_start_time"),
        F.timestamp_add("HOUR", F.col("l_quantity").cast("int"), "l_shipdate")
        .alias("repair_end_time"),
        F.col("l_linenumber").alias("total_failure_count"), F.col("l_linestatus").alias("worktype"),
        F.col("p_brand").alias("cust_brand"), F.col("p_type").alias("cust_subsys"),
        F.col("o_orderpriority").alias("failurecode_name"),
        F.col("p_name").alias("problemcode_name"),
        F.when(F.col("l_returnflag") == "R", "CBM").otherwise("CM").alias("repair_type"),
        F.col("l_quantity").alias("repair_duration_hours"),
        *([F.col("o_orderkey").alias("k"), F.col("l_suppkey").alias("s")] if with_order else []))


WO = """wo AS (SELECT o_custkey AS assetnum,
  concat_ws('-', o_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS wonum,
  n_name AS station_name, CAST(c_nationkey AS VARCHAR) AS cust_linenum,
  o_orderdate + to_hours(l_linenumber * 37 + l_partkey % 24) AS current_faildate,
  l_shipdate AS repair_start_time,
  l_shipdate + to_hours(CAST(l_quantity AS BIGINT)) AS repair_end_time,
  l_linenumber AS total_failure_count, l_linestatus AS worktype, p_brand AS cust_brand,
  p_type AS cust_subsys, o_orderpriority AS failurecode_name, p_name AS problemcode_name,
  CASE WHEN l_returnflag = 'R' THEN 'CBM' ELSE 'CM' END AS repair_type,
  l_quantity AS repair_duration_hours, o_orderkey AS k, l_suppkey AS s
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""


def raw(spark: SparkSession, folder: str) -> DataFrame:
    k, fault = F.col("k"), F.col("current_faildate")
    spelled = (
        F.when(k % 23 == 0, "bad")
        .when(k % 29 == 1, F.date_format(fault, "yyyyMMdd"))
        .when(k % 29 == 2, F.concat(F.date_format(fault, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .when(k % 29 == 3, F.concat(F.date_format(F.timestamp_add("HOUR", F.lit(8), fault), "yyyy-MM-dd'T'HH:mm:ss"),
                                    F.lit("+08:00")))
        .when(k % 29 == 4, F.concat(F.date_format(fault, "yyyy-MM-dd HH:mm:ss"), F.lit(".2500009")))
        .when(k % 29 == 5, F.date_format(fault, "MM/dd/yyyy hh:mm a"))
        .when(k % 29 == 6, F.date_format(fault, "MM/dd/yyyy HH:mm"))
        .when(k % 3 == 0, F.date_format(fault, "yyyy-MM-dd HH:mm:ss"))
        .when(k % 3 == 1, F.concat(F.lit("\t "), F.date_format(fault, "yyyy/MM/dd HH:mm"), F.lit(" ")))
        .otherwise(F.date_format(fault, "yyyy-MM-dd")))
    device = F.when(k % 17 == 0, F.lit(None).cast("string")).when(k % 19 == 0, " \t ").otherwise(
        F.col("assetnum").cast("string"))
    hours = F.when(F.col("total_failure_count") == 7, -F.col("repair_duration_hours")).when(
        F.col("total_failure_count") == 6, F.lit(None).cast("double")).otherwise(
        F.col("repair_duration_hours"))
    made = {
        "assetnum": device, "location": F.col("s").cast("string"), "current_faildate": spelled,
        "prev_faildate": F.lit(None).cast("string"), "is_first_failure": F.lit(0),
        "description": F.concat(F.lit("line "), F.col("wonum")),
        "cust_brand": F.when(k % 13 != 0, F.col("cust_brand")),
        "failurecode": F.substring("failurecode_name", 1, 1),
        "problemcode": F.when(k % 11 != 0, F.col("problemcode_name")),
        "repair_start_time": F.date_format("repair_start_time", "yyyy-MM-dd"),
        "repair_end_time": F.date_format("repair_end_time", "yyyy-MM-dd HH:mm:ss"),
        "repair_location": F.lit(" "), "repair_duration_hours": hours,
        "start_of_operation": F.lit("1990-01-01"),
        "cust_fixby": F.lit(None).cast("string"), "responsible_person": F.lit(None).cast("string"),
        "problem_desc": F.lit(None).cast("string"), "cause_desc": F.lit(""),
        "remedy_desc": F.when(k % 2 == 0, "reset"), "manual_remark": F.lit(None).cast("string"),
    }
    rows = wo(spark, folder, with_order=True).select(
        *[made.get(c, F.col(c)).alias(c) for c in STANDARD_NAMES], F.lit("x").alias("unmapped"), k)
    # Every tenth order comes twice; one pass over the joined tables makes both copies.
    copies = F.explode(F.when(k % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("_copy", copies).drop("k", "_copy")


_NULL_TEXT = "CAST(NULL AS VARCHAR)"
RAW = WO + f""", one AS (SELECT
  CASE WHEN k % 17 = 0 THEN NULL WHEN k % 19 = 0 THEN ' ' || chr(9) || ' '
    ELSE CAST(assetnum AS VARCHAR) END AS assetnum,
  wonum, CAST(s AS VARCHAR) AS location, station_name, cust_linenum,
  CASE WHEN k % 23 = 0 THEN 'bad'
    WHEN k % 29 = 1 THEN strftime(current_faildate, '%Y%m%d')
    WHEN k % 29 = 2 THEN strftime(current_faildate, '%Y-%m-%dT%H:%M:%SZ')
    WHEN k % 29 = 3 THEN strftime(current_faildate + to_hours(8), '%Y-%m-%dT%H:%M:%S+08:00')
    WHEN k % 29 = 4 THEN strftime(current_faildate, '%Y-%m-%d %H:%M:%S') || '.2500009'
    WHEN k % 29 = 5 THEN strftime(current_faildate, '%m/%d/%Y %I:%M %p')
    WHEN k % 29 = 6 THEN strftime(current_faildate, '%m/%d/%Y %H:%M')
    WHEN k % 3 = 0 THEN strftime(current_faildate, '%Y-%m-%d %H:%M:%S')
    WHEN k % 3 = 1 THEN chr(9) || ' ' || strftime(current_faildate, '%Y/%m/%d %H:%M') || ' '
    ELSE strftime(current_faildate, '%Y-%m-%d') END AS current_faildate,
  {_NULL_TEXT} AS prev_faildate, total_failure_count, 0 AS is_first_failure, worktype,
  'line ' || wonum AS description, CASE WHEN k % 13 <> 0 THEN cust_brand END AS cust_brand,
  cust_subsys, substr(failurecode_name, 1, 1) AS failurecode,
  CASE WHEN k % 11 <> 0 THEN problemcode_name END AS problemcode, failurecode_name,
  problemcode_name, strftime(repair_start_time, '%Y-%m-%d') AS repair_start_time,
  strftime(repair_end_time, '%Y-%m-%d %H:%M:%S') AS repair_end_time, repair_type,
  ' ' AS repair_location,
  CASE WHEN total_failure_count = 7 THEN -repair_duration_hours
    WHEN total_failure_count = 6 THEN NULL ELSE repair_duration_hours END AS repair_duration_hours,
  '1990-01-01' AS start_of_operation, {_NULL_TEXT} AS cust_fixby,
  {_NULL_TEXT} AS responsible_person, {_NULL_TEXT} AS problem_desc, '' AS cause_desc,
  CASE WHEN k % 2 = 0 THEN 'reset' END AS remedy_desc, {_NULL_TEXT} AS manual_remark,
  'x' AS unmapped, k FROM wo),
raw AS (SELECT * EXCLUDE (k) FROM one UNION ALL SELECT * EXCLUDE (k) FROM one WHERE k % 10 = 0)"""

# Judged rows in SQL: distinct, filled, parsed, with the first broken rule.
JUDGE_PERIOD = ("1996-01-01", "2000-12-31")


def _sql_time(c: str) -> str:
    stripped = f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
    zoned = f"CASE WHEN {stripped} LIKE '%+08:00' THEN left({stripped}, 19) END"
    return (f"coalesce(try_strptime({stripped}, '%Y-%m-%d %H:%M:%S'), "
            f"try_strptime({stripped}, '%Y-%m-%d'), try_strptime({stripped}, '%Y/%m/%d %H:%M'), "
            f"try_strptime({stripped}, '%Y%m%d'), try_strptime({stripped}, '%Y-%m-%dT%H:%M:%SZ'), "
            f"try_strptime({zoned}, '%Y-%m-%dT%H:%M:%S') - to_hours(8), "
            f"try_strptime(regexp_extract({stripped}, '^(.*[.][0-9]{{6}})[0-9]$', 1), '%Y-%m-%d %H:%M:%S.%f'), "
            f"try_strptime({stripped}, '%m/%d/%Y %I:%M %p'), try_strptime({stripped}, '%m/%d/%Y %H:%M'))")


def _sql_column(c: str) -> str:
    if c in DEFAULTS:
        return f"coalesce({c}, '{DEFAULTS[c]}') AS {c}"
    return f"{_sql_time(c)} AS {c}" if c in TIME_COLUMNS else c


NAMES = ", ".join(STANDARD_NAMES)
JUDGED = RAW + f""", once AS (SELECT {NAMES}, count(*) AS copies FROM raw GROUP BY ALL),
parsed AS (SELECT {", ".join(_sql_column(c) for c in STANDARD_NAMES)}, copies,
  (assetnum IS NULL OR regexp_full_match(assetnum, '\\s*')
   OR current_faildate IS NULL OR regexp_full_match(current_faildate, '\\s*')
   OR repair_end_time IS NULL OR regexp_full_match(repair_end_time, '\\s*')) AS blank FROM once),
judged AS (SELECT * EXCLUDE (blank), CASE WHEN blank THEN 'missing_core'
  WHEN repair_end_time < current_faildate THEN 'inverted_times'
  WHEN current_faildate < TIMESTAMP '{JUDGE_PERIOD[0]}'
    OR current_faildate > TIMESTAMP '{JUDGE_PERIOD[1]}' THEN 'outside_period'
  WHEN current_faildate IS NULL OR repair_end_time IS NULL THEN 'unparsed_core'
  WHEN repair_duration_hours < 0 THEN 'negative_repair' END AS drop_reason FROM parsed)"""


def ev(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "user_id", "event_id", "ts", "event_type",
        F.floor("value").cast("double").alias("hours"))


EV = "ev AS (SELECT user_id, event_id, ts, event_type, floor(value) AS hours FROM events)"


def gaps_sql(source: str, device: str, time: str, tie: str, repair: str, name: str = "gaps") -> str:
    return f"""{name} AS (SELECT *, row_number() OVER w AS record_no,
  first_value({time}) OVER w AS first_time, first_value({repair}) OVER w AS first_repair,
  date_diff('microsecond', lag({time}) OVER w, {time}) / 3.6e9 AS gap_h FROM {source}
  WINDOW w AS (PARTITION BY {device} ORDER BY {time}, {tie}))"""


def history_sql(source: str, device: str, time: str, tie: str, repair: str,
                name: str = "hist") -> str:
    """History of the rows of `source`, which already hold gap_h."""
    w = f"PARTITION BY {device} ORDER BY {time}, {tie}"
    return f"""{name} AS (SELECT *, count(gap_h) OVER b AS hist_count, avg(gap_h) OVER b AS hm,
  stddev_pop(gap_h) OVER b AS hs, lag(gap_h) OVER w AS prev_gap,
  avg(gap_h) OVER ({w} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS r3,
  avg(gap_h) OVER ({w} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolling3_gap,
  lag({repair}) OVER w AS prev_repair, avg({repair}) OVER b AS rm,
  first_value({time}) OVER w AS kept_time, first_value({repair}) OVER w AS kept_repair
  FROM {source} WINDOW w AS ({w}),
  b AS ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


GAPS = LOG + ", " + gaps_sql("log", "assetnum", "current_faildate", "wonum", "repair_duration_hours")
POS = GAPS + ", pos AS (SELECT * FROM gaps WHERE gap_h > 0)"
HIST = POS + ", " + history_sql("pos", "assetnum", "current_faildate", "wonum",
                                "repair_duration_hours")
EGAPS = EV + ", " + gaps_sql("ev", "user_id", "ts", "event_id", "hours", "egaps")
EPOS = EGAPS + ", epos AS (SELECT * FROM egaps WHERE gap_h > 0)"


def days_sql(start: str, end: str) -> str:
    return f"greatest(date_diff('microsecond', {start}, {end}) / 8.64e10, 1.0)"


def dev(spark: SparkSession, folder: str, hot_rows: int | None = None) -> DataFrame:
    extra = {} if hot_rows is None else {"hot_rows": hot_rows}
    return device_mtbf(log(spark, folder), LOG_TIME, **extra)


BAND = GAPS + """, limits AS (SELECT assetnum, quantile_cont(gap_h, 0.95) AS band_high FROM gaps
  WHERE gap_h > 0 GROUP BY assetnum),
band AS (SELECT g.*, band_high, coalesce(gap_h > 0 AND gap_h >= 10 AND gap_h <= band_high, false)
  AS in_band FROM gaps g LEFT JOIN limits USING (assetnum))"""
DEV = BAND + """, dev AS (SELECT * EXCLUDE (positive, kept) FROM (SELECT assetnum,
  count(*) AS n_failures, count(*) FILTER (gap_h > 0) AS positive,
  count(*) FILTER (in_band) AS kept, stddev_pop(gap_h) FILTER (in_band) AS std_mtbf_h,
  min(gap_h) FILTER (in_band) AS min_mtbf_h, max(gap_h) FILTER (in_band) AS max_mtbf_h,
  avg(repair_duration_hours) AS avg_repair_h, max(repair_duration_hours) AS max_repair_h,
  greatest(CAST(floor(date_diff('microsecond', min(current_faildate), max(current_faildate))
    / 8.64e10) AS BIGINT), 1) AS aging_days,
  count(*) / greatest(floor(date_diff('microsecond', min(current_faildate), max(current_faildate))
    / 8.64e10), 1) * 30 AS fail_rate_monthly,
  arg_min(station_name, (current_faildate, wonum)) AS station,
  arg_min(cust_brand, (current_faildate, wonum)) AS brand,
  arg_min(cust_linenum, (current_faildate, wonum)) AS line,
  avg(gap_h) FILTER (in_band) AS avg_mtbf_h FROM band GROUP BY assetnum)
  WHERE n_failures >= 5 AND positive >= 3 AND kept >= 3)"""

# Stand-in predictions made from the device table, so that metrics have a SQL twin.
PRED = DEV + """, pred AS (SELECT assetnum, avg_mtbf_h AS actual,
  (min_mtbf_h + max_mtbf_h) / 2 AS mid, aging_days * 24.0 / n_failures AS pace,
  max_mtbf_h - std_mtbf_h AS upper FROM dev)"""
MODELS = ["mid", "pace", "upper"]


def pred(spark: SparkSession, folder: str) -> DataFrame:
    return dev(spark, folder).select(
        "assetnum", F.col("avg_mtbf_h").alias("actual"),
        ((F.col("min_mtbf_h") + F.col("max_mtbf_h")) / 2).alias("mid"),
        (F.col("aging_days") * 24.0 / F.col("n_failures")).alias("pace"),
        (F.col("max_mtbf_h") - F.col("std_mtbf_h")).alias("upper"))
