"""Category encodings, splits, samples and oversampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import DAY_EDGES, DEV, RAW, WO, dev, query, raw, rounded, table, wo
from gapline.functions.bins import flag, hash_bucket, one_hot
from gapline.functions.times import day_period
from gapline.operators import encode as en
from gapline.operators import split as sp
from gapline.operators.nearest import append_rows, oversample
from gapline.operators.models import scaler, z_scores
from gapline.operators.scale import with_totals
from gapline.plans.events import PERIOD_FLAGS
from gapline.plans.training import DEVICE_FEATURES, device_sides, with_stratum

_LABEL_SQL = "WITH " + RAW + """ SELECT wonum, cust_brand, cust_subsys,
  CAST(dense_rank() OVER (ORDER BY coalesce(cust_brand, 'nan')) - 1 AS INTEGER) AS brand_code,
  CAST(dense_rank() OVER (ORDER BY cust_subsys) - 1 AS INTEGER) AS subsystem_code FROM raw"""


def _labels(spark, d, **limits):
    rows = raw(spark, d).select("wonum", "cust_brand", "cust_subsys")
    fitted = en.fit(rows, ["cust_brand", "cust_subsys"], **limits)
    return en.encode(rows, fitted, codes={"cust_brand": "brand_code", "cust_subsys": "subsystem_code"})


@query("n1_label_codes", _LABEL_SQL)
def _(spark, d):
    return _labels(spark, d)


@query("n1_label_codes_too_many_to_broadcast", _LABEL_SQL)
def _(spark, d):
    return _labels(spark, d, max_rows=3, hot_rows=10)


@query("n2_frequency_codes", "WITH " + RAW + """ SELECT wonum, problemcode, round(CASE WHEN problemcode IS NOT NULL THEN
  count(*) OVER (PARTITION BY problemcode) / count(problemcode) OVER () END, 8) AS problem_freq FROM raw""")
def _(spark, d):
    rows = raw(spark, d).select("wonum", "problemcode")
    fitted = en.fit(rows, ["problemcode"])
    return rounded(en.encode(rows, fitted, shares={"problemcode": "problem_freq"}), 8)


@query("n3_j3_smoothed_target_codes", "WITH " + WO + """, s AS (SELECT station_name,
  (sum(repair_duration_hours) + 10 * (SELECT avg(repair_duration_hours) FROM wo)) / (count(*) + 10) AS code
  FROM wo GROUP BY station_name)
  SELECT wonum, station_name, round(code, 6) AS station_target FROM wo LEFT JOIN s USING (station_name)""")
def _(spark, d):
    rows = wo(spark, d).select("wonum", "station_name", "repair_duration_hours")
    fitted = en.fit(rows, ["station_name"], "repair_duration_hours")
    coded = en.encode(rows, fitted, target_means={"station_name": "station_target"})
    return rounded(coded.drop("repair_duration_hours"))


@query("n3_target_codes_fit_on_train_only", "WITH " + WO + """, side AS (SELECT *,
  CAST('0x' || substr(md5(concat(CAST(assetnum AS VARCHAR), ':42')), 1, 8) AS BIGINT) % 5 AS fold FROM wo),
  s AS (SELECT station_name, (sum(repair_duration_hours) + 10 * (SELECT avg(repair_duration_hours)
    FROM side WHERE fold <> 0)) / (count(*) + 10) AS code FROM side WHERE fold <> 0 GROUP BY station_name)
  SELECT wonum, round(code, 6) AS station_target FROM side LEFT JOIN s USING (station_name) WHERE fold = 0""")
def _(spark, d):
    rows = sp.with_fold(wo(spark, d), ["assetnum"])
    fitted = en.fit(rows.filter("fold <> 0"), ["station_name"], "repair_duration_hours")
    coded = en.encode(rows.filter("fold = 0"), fitted, target_means={"station_name": "station_target"})
    return rounded(coded.select("wonum", "station_target"))


@query("n3_out_of_fold_target_codes", "WITH " + WO + """, side AS (SELECT *,
  CAST('0x' || substr(md5(concat(wonum, ':42')), 1, 8) AS BIGINT) % 5 AS fold FROM wo),
  p AS (SELECT station_name, fold, sum(repair_duration_hours) AS part, count(*) AS n FROM side GROUP BY ALL),
  f AS (SELECT fold, sum(part) AS fs, sum(n) AS fn FROM p GROUP BY fold),
  t AS (SELECT station_name, sum(part) AS ts, sum(n) AS tn FROM p GROUP BY station_name)
  SELECT wonum, CAST(fold AS INTEGER) AS fold, round((ts - part + 10 * ((SELECT sum(fs) FROM f) - fs) / ((SELECT sum(fn) FROM f) - fn))
    / (tn - n + 10), 6) AS target_code FROM side JOIN p USING (station_name, fold) JOIN f USING (fold)
  JOIN t USING (station_name)""")
def _(spark, d):
    rows = sp.with_fold(wo(spark, d).select("wonum", "station_name", "repair_duration_hours"), ["wonum"])
    coded = en.out_of_fold_target_means(rows, "station_name", "repair_duration_hours", "fold")
    return rounded(coded.select("wonum", "fold", "target_code"))


@query("n4_period_flags", """SELECT event_id, CAST(hour(ts) IN (7, 8) AS INTEGER) AS period_morning_peak,
  CAST(hour(ts) BETWEEN 9 AND 16 AS INTEGER) AS period_daytime,
  CAST(hour(ts) BETWEEN 17 AND 19 AS INTEGER) AS period_evening_peak,
  CAST(hour(ts) < 7 OR hour(ts) > 19 AS INTEGER) AS period_night FROM events""")
def _(spark, d):
    flags = one_hot(day_period(F.hour("ts")), PERIOD_FLAGS)
    return table(spark, d, "events").select("event_id", *[v.alias(n) for n, v in flags.items()])


@query("n5_repair_type_flag", "WITH " + WO + """, half AS (SELECT wonum, CASE WHEN k % 2 = 0 THEN repair_type END AS rt FROM wo)
  SELECT wonum, CAST(coalesce(rt = 'CBM', false) AS INTEGER) AS is_cbm FROM half""")
def _(spark, d):
    rows = wo(spark, d, with_order=True)
    kind = F.when(F.col("k") % 2 == 0, F.col("repair_type"))
    return rows.select("wonum", flag(kind, "CBM").alias("is_cbm"))


_BUCKET = "CAST(CAST('0x' || substr(md5({}), 1, 8) AS BIGINT) % {} AS INTEGER)"


@query("n6_hash_buckets", "WITH " + WO + f""" SELECT wonum, {_BUCKET.format("coalesce(station_name, '')", 500)} AS station_enc,
  {_BUCKET.format("coalesce(cust_brand, '')", 100)} AS brand_enc FROM wo""")
def _(spark, d):
    return wo(spark, d).select("wonum", hash_bucket(F.col("station_name"), 500).alias("station_enc"),
                               hash_bucket(F.col("cust_brand"), 100).alias("brand_enc"))


# --- splits and samples ------------------------------------------------------------------

_ORDER = "md5(concat(CAST({} AS VARCHAR), ':42')), {}"
_SPLIT_SQL = f"""SELECT o_custkey, n <= ceil(0.2 * total) AS is_test FROM (SELECT o_custkey,
  row_number() OVER (ORDER BY {_ORDER.format('o_custkey', 'o_custkey')}) AS n, count(*) OVER () AS total
  FROM (SELECT DISTINCT o_custkey FROM orders))"""


@query("l1_group_split", _SPLIT_SQL)
def _(spark, d):
    return sp.group_split(table(spark, d, "orders"), "o_custkey")


@query("l1_group_split_in_segments", _SPLIT_SQL)
def _(spark, d):
    return sp.group_split(table(spark, d, "orders"), "o_custkey", hot_rows=200)


@query("l1_test_rows", f"""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN
  (SELECT o_custkey FROM ({_SPLIT_SQL}) WHERE is_test)""")
def _(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return sp.take_side(orders, sp.group_split(orders, "o_custkey"), "o_custkey", test=True)


_STRATA = DEV + """, strata AS (SELECT assetnum, CASE WHEN x > 0 AND x <= 100 THEN 0 WHEN x > 100 AND x <= 150 THEN 1
  WHEN x > 150 AND x <= 200 THEN 2 WHEN x > 200 AND x <= 300 THEN 3 WHEN x > 300 AND x <= 9999 THEN 4 END AS stratum
  FROM (SELECT assetnum, avg_mtbf_h / 24 AS x FROM dev))"""
_STRATIFIED = "WITH " + _STRATA + f""" SELECT assetnum, n <= ceil(0.2 * total) AS is_test FROM (SELECT assetnum,
  row_number() OVER (PARTITION BY stratum ORDER BY {_ORDER.format('assetnum', 'assetnum')}) AS n,
  count(*) OVER (PARTITION BY stratum) AS total FROM strata)"""


def strata(spark, d):
    return with_stratum(dev(spark, d), DAY_EDGES)


@query("l2_stratified_split", _STRATIFIED)
def _(spark, d):
    return sp.group_split(strata(spark, d), "assetnum", stratum="stratum")


@query("l2_stratified_split_of_customers", f"""SELECT c_custkey, n <= ceil(0.2 * total) AS is_test FROM (SELECT c_custkey,
  row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_ORDER.format('c_custkey', 'c_custkey')}) AS n,
  count(*) OVER (PARTITION BY c_mktsegment) AS total FROM customer)""")
def _(spark, d):
    return sp.group_split(table(spark, d, "customer"), "c_custkey", stratum="c_mktsegment", hot_rows=200)


@query("v3_x2_shared_devices", f"""WITH s AS ({_STRATIFIED}) SELECT count(*) FILTER (NOT is_test) AS train_devices,
  count(*) FILTER (is_test) AS test_devices, count(*) - count(DISTINCT assetnum) AS shared_devices FROM s""")
def _(spark, d):
    rows = strata(spark, d)
    split = sp.group_split(rows, "assetnum", stratum="stratum")
    train, test = (sp.take_side(rows, split, "assetnum", side) for side in (False, True))
    one = F.count_distinct("assetnum")
    return with_totals(with_totals(train.agg(one.alias("train_devices")), test.agg(one.alias("test_devices"))),
                       sp.shared_keys(train, test, "assetnum").agg(F.count(F.lit(1)).alias("shared_devices")))


@query("l3_sample_rows", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {_ORDER.format('o_orderkey', 'o_orderkey')} LIMIT 2000")
def _(spark, d):
    return sp.sample_rows(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 2000, ["o_orderkey"])


@query("l4_bootstrap", """WITH n AS (SELECT count(*) AS n FROM orders), r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS no
  FROM orders) SELECT o_orderkey, o_totalprice FROM n, range(1, CAST(n.n + 1 AS BIGINT)) AS k(k) JOIN r
  ON no = 1 + CAST('0x' || substr(md5(concat(CAST(k AS VARCHAR), ':42')), 1, 15) AS BIGINT) % n.n""")
def _(spark, d):
    return sp.bootstrap(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])


@query("l5_folds", """SELECT o_orderkey, CAST(CAST('0x' || substr(md5(concat(CAST(o_orderkey AS VARCHAR), ':42')), 1, 8)
  AS BIGINT) % 5 AS INTEGER) AS fold FROM orders""")
def _(spark, d):
    return sp.with_fold(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])


# Training and test devices with all eleven features: codes by the training devices (-1 for others), and z-scores
# by their means and deviations.
ELEVEN = [*DEVICE_FEATURES, "station_enc", "brand_enc", "line_enc"]
CODE = """CASE WHEN {0} IN (SELECT {0} FROM tr) THEN CAST((SELECT count(DISTINCT {0}) FROM tr WHERE tr.{0} < t.{0})
  AS INTEGER) ELSE -1 END AS {1}"""
SIDES = _STRATA + f""", sd AS ({_STRATIFIED}), t AS (SELECT dev.*, is_test FROM dev JOIN sd USING (assetnum))"""
SCALED = SIDES + ", tr AS (SELECT * FROM t WHERE NOT is_test), c AS (SELECT t.*, " + ", ".join(
    CODE.format(x, f"{x}_enc") for x in ("station", "brand", "line")) + " FROM t), ms AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in ELEVEN) + """ FROM c WHERE NOT is_test),
  z AS (SELECT assetnum, is_test, avg_mtbf_h, """ + ", ".join(
    f"CASE WHEN s_{c} > 0 THEN ({c} - m_{c}) / s_{c} ELSE 0.0 END AS {c}" for c in ELEVEN) + " FROM c, ms)"


def sides(spark, d):
    return device_sides(dev(spark, d), "assetnum", edges=DAY_EDGES)


def scaled(spark, d, both=False):
    """z-scores of the training devices, or of all of them."""
    s = sides(spark, d)
    fitted = scaler(s.features, s.train)
    return z_scores(s.train.unionByName(s.test) if both else s.train, s.features, fitted)


# Brute-force twin: all pairs of a stratum, five nearest by distance and id, the same draws.
_HEX = "CAST('0x' || substr(h, {}, 8) AS BIGINT)"
_GAP2 = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in ELEVEN)
_L6_SQL = "WITH " + SCALED + f""", p AS (SELECT stratum, z.* FROM z JOIN strata USING (assetnum) WHERE NOT is_test),
 n AS (SELECT stratum, count(*) AS size, (SELECT max(c) FROM (SELECT count(*) AS c FROM p GROUP BY stratum))
   - count(*) AS missing FROM p GROUP BY stratum),
 near AS (SELECT * FROM (SELECT a.assetnum AS id, b.assetnum AS nid, row_number() OVER
   (PARTITION BY a.assetnum ORDER BY {_GAP2}, b.assetnum) AS place
   FROM p a JOIN p b ON a.stratum = b.stratum AND a.assetnum <> b.assetnum) WHERE place <= 5),
 no AS (SELECT assetnum, stratum, row_number() OVER (PARTITION BY stratum ORDER BY
   {_ORDER.format('assetnum', 'assetnum')}) AS pos FROM p),
 want AS (SELECT assetnum AS id, size, unnest(range(1, CAST(missing // size
   + CAST(pos <= missing % size AS INTEGER) + 1 AS BIGINT))) AS copy
   FROM no JOIN n USING (stratum) WHERE missing > 0 AND size > 1),
 draw AS (SELECT id, copy, size, md5(concat(CAST(id AS VARCHAR), ':', CAST(copy AS VARCHAR), ':42')) AS h FROM want),
 pick AS (SELECT id, 1 + {_HEX.format(1)} % least(5, size - 1) AS place,
   {_HEX.format(9)} / 4294967296.0 AS share FROM draw)
 SELECT a.stratum, {", ".join(f"round(a.{c} + share * (b.{c} - a.{c}), 5) AS {c}" for c in ELEVEN)},
   id AS source_id FROM pick JOIN near USING (id, place) JOIN p a ON a.assetnum = id JOIN p b ON b.assetnum = nid"""


@query("l6_oversampled_strata", _L6_SQL)
def _(spark, d):
    return rounded(oversample(scaled(spark, d), "stratum", ELEVEN, "assetnum"), 5)


@query("x4_l6_balanced_strata", "WITH " + _STRATA + """, n AS (SELECT stratum, count(*) AS c FROM strata GROUP BY stratum)
  SELECT stratum, (SELECT max(c) FROM n) AS rows, (SELECT max(c) FROM n) - c AS synthetic_rows FROM n""")
def _(spark, d):
    rows = strata(spark, d)
    both = append_rows(rows, oversample(rows, "stratum", DEVICE_FEATURES, "assetnum"))
    return both.groupBy("stratum").agg(F.count(F.lit(1)).alias("rows"),
                                       F.count_if("synthetic").alias("synthetic_rows"))
