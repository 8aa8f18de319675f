"""The tables behind the report charts."""

from __future__ import annotations

from checks.base import MODELS, POS, PRED, log, pred, query, rounded
from checks.models import IMPORTANCE, PLAIN, SIDES, TARGET, importance_facts, sides
from checks.stats import (_CELLS_SQL, _FEATURES, _FEATURE_SQL, _TRIO, _vif_sql, all_metrics,
                          box_sql, features, gaps, histogram_sql, _round_metrics)
from pyspark.sql import functions as F

from gapline.operators import metrics as m
from gapline.operators import models as md
from gapline.plans import reports as rp


@query("r1_gap_histogram", "WITH " + POS + ", " + histogram_sql("pos", "ln(1 + gap_h)", 50, "min(x)", "max(x)")
       + " SELECT * FROM hist_out")
def _(spark, d):
    return rounded(rp.gap_histogram(gaps(spark, d)))


@query("r1_gap_box", "WITH " + POS + ", " + box_sql("pos", "gap_h", None) + " SELECT * FROM box")
def _(spark, d):
    return rp.gap_box(gaps(spark, d))


@query("r2_correlation_heatmap", _CELLS_SQL)
def _(spark, d):
    return rounded(rp.correlation_heatmap(features(spark, d), _FEATURES, "gap_h"))


@query("r3_vif_bars", "SELECT *, CASE WHEN vif < 5 THEN 'low' WHEN vif < 10 THEN 'medium' ELSE 'high' END AS level FROM ("
       + _vif_sql(False) + ")")
def _(spark, d):
    return rounded(rp.vif_bars(features(spark, d), _TRIO), 5)


@query("r4_feature_ranking", "WITH " + _FEATURE_SQL + " SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{n}' AS "column", round(abs(corr({n}, gap_h)), 6) AS correlation FROM f""" for n in _FEATURES)
    + ") ORDER BY correlation DESC LIMIT 4")
def _(spark, d):
    return rounded(rp.feature_ranking(features(spark, d), _FEATURES, "gap_h", 4))


_R5_SQL = "WITH " + POS + """, shown AS (SELECT * FROM pos WHERE gap_h < (SELECT quantile_cont(gap_h, 0.95) FROM pos)),
  ord AS (SELECT cust_brand, median(gap_h) AS all_median FROM pos GROUP BY cust_brand), """ + box_sql(
    "shown", "gap_h", "cust_brand") + " SELECT * FROM box JOIN ord USING (cust_brand)"


@query("r5_brand_boxes", _R5_SQL)
def _(spark, d):
    return rp.category_boxes(gaps(spark, d), "cust_brand")


@query("r5_brand_boxes_narrowed", _R5_SQL)
def _(spark, d):
    return rp.category_boxes(gaps(spark, d), "cust_brand", hot_rows=500)


@query("r6_hour_and_weekday_counts", """SELECT 'hour' AS part, CAST(hour(ts) AS INTEGER) AS value, count(*) AS rows
  FROM events GROUP BY 2 UNION ALL SELECT 'weekday', CAST(isodow(ts) - 1 AS INTEGER), count(*) FROM events GROUP BY 2""")
def _(spark, d):
    from checks.base import table
    return rp.hour_and_weekday_counts(table(spark, d, "events"), "ts")


@query("r7_gap_repair_scatter", "WITH " + POS + """, few AS (SELECT wonum, repair_duration_hours, gap_h, cust_brand FROM pos
  ORDER BY md5(concat(CAST(wonum AS VARCHAR), ':42')), wonum LIMIT 3000)
  SELECT * FROM few WHERE repair_duration_hours <= 100""")
def _(spark, d):
    return rp.gap_repair_scatter(gaps(spark, d), ["wonum"], "repair_duration_hours", max_repair=100,
                                 extra=["cust_brand"])


@query("r8_model_metrics_of_given_predictions", "WITH " + PRED + f""", c AS (SELECT model, {_round_metrics(4)}
  FROM ({all_metrics(1)})) SELECT *, CASE WHEN accuracy >= 80 THEN 'excellent' WHEN accuracy >= 70 THEN 'good'
  WHEN accuracy >= 65 THEN 'pass' ELSE 'below' END AS tier FROM c""")
def _(spark, d):
    return m.compare(pred(spark, d), "actual", MODELS, 1)


@query("r9_predicted_actual_sample", "WITH " + PRED + """ SELECT assetnum, round(actual, 6) AS actual, round(mid, 6) AS mid,
  round((SELECT quantile_cont(actual, 0.99) FROM pred), 6) AS axis_limit FROM pred
  ORDER BY md5(concat(CAST(assetnum AS VARCHAR), ':42')), assetnum LIMIT 1000""")
def _(spark, d):
    return rounded(rp.predicted_actual_sample(pred(spark, d), ["assetnum"], "actual", "mid", 1000))


@query("r10_residual_histogram", "WITH " + PRED + ", " + histogram_sql("pred", "actual - mid", 60, "min(x)", "max(x)")
       + " SELECT * FROM hist_out")
def _(spark, d):
    return rounded(rp.residual_histogram(pred(spark, d), "actual", "mid"))


@query("r10_residual_scatter", "WITH " + PRED + """ SELECT assetnum, round(mid, 6) AS mid, round(residual, 6) AS residual
  FROM (SELECT assetnum, mid, actual - mid AS residual, row_number() OVER (ORDER BY mid, assetnum) AS n FROM pred)
  WHERE (n - 1) % 5 = 0""")
def _(spark, d):
    return rounded(rp.residual_scatter(pred(spark, d), ["assetnum"], "actual", "mid"))


@query("r11_feature_importance_top", IMPORTANCE)
def _(spark, d):
    s = sides(spark, d)
    model = md.fit(PLAIN, s.train, s.features, TARGET)
    return importance_facts(rp.top_importances(md.importances(spark, model, s.features)), s.features)


_APE = "abs((actual - mid) / actual) * 100"


@query("r12_error_histogram", "WITH " + PRED + ", " + histogram_sql("pred", f"least({_APE}, 200)", 80, "any_value(0.0)",
       "any_value(200.0)").replace("least(floor", "least(floor") + f""" SELECT h.*,
  round((SELECT avg({_APE}) FROM pred), 6) AS mape, round((SELECT median({_APE}) FROM pred), 6) AS mdape FROM hist_out h""")
def _(spark, d):
    return rounded(rp.error_histogram(pred(spark, d), "actual", "mid"))


@query("r13_feature_summary", "WITH " + POS + """ SELECT (SELECT count(*) FROM gaps) AS clean_rows,
  (SELECT count(*) FROM gaps WHERE gap_h IS NULL) AS first_records,
  (SELECT count(*) FROM gaps WHERE gap_h <= 0) AS zero_gaps,
  (SELECT count(*) FROM (SELECT assetnum FROM gaps GROUP BY assetnum HAVING count(*) = 1)) AS single_record_devices,
  count(*) AS modelled_rows, 5 AS features FROM pos""")
def _(spark, d):
    return rp.feature_summary(log(spark, d), gaps(spark, d), "assetnum", "current_faildate", ["wonum"], 5)


@query("r13_training_summary", "WITH " + SIDES + """ SELECT count(*) FILTER (NOT is_test) AS train_rows,
  count(DISTINCT assetnum) FILTER (NOT is_test) AS train_devices, count(*) FILTER (is_test) AS test_rows,
  count(DISTINCT assetnum) FILTER (is_test) AS test_devices, true AS known FROM t""")
def _(spark, d):
    s = sides(spark, d)
    done = md.train_and_compare({"ridge": md.ridge(10.0), "forest": PLAIN}, s.train, s.test, s.features, TARGET)
    out = rp.training_summary(done.table(1.0), s.train, s.test, "assetnum")
    return out.select("train_rows", "train_devices", "test_rows", "test_devices",
                      (F.col("model").isin("ridge", "forest") & (F.col("accuracy") > 0)).alias("known"))
