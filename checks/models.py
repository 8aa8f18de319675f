"""Scaling, regressors, ensembles and their comparison."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import functions as F

from checks.base import DAY_EDGES, MODELS, PRED, dev, pred, query, rounded, wo
from checks.cleaning import folder_for
from checks.encoding import CODE, ELEVEN, SCALED, SIDES, _ORDER, scaled, sides
from checks.history import _V3_SQL, _V4_SQL, _six
from checks.stats import metrics_sql, _round_metrics
from gapline.operators import metrics as m
from gapline.operators import models as md
from gapline.operators import split as sp
from gapline.operators.scale import with_totals
from gapline.plans import events as pe
from gapline.plans import training as tr
from gapline.sources.models import load_metadata, load_model, load_stack, save_model, save_stack

# The published device forest and boosters; the rounds are a limit, a tenth of the training devices held back
# ends them.
FOREST = md.forest(**md.FOREST_DEVICES)
PLAIN = md.forest(**md.FOREST_PLAIN)
BOOST = md.boosting(**md.BOOSTING_DEVICES, ids=["assetnum"])
BOOST_ABS = md.boosting("absolute", **md.BOOSTING_DEVICES, ids=["assetnum"])
TARGET = tr.TARGET

_FOLD = "CAST('0x' || substr(md5(concat(CAST(assetnum AS VARCHAR), ':42')), 1, 8) AS BIGINT) % 5"

def facts(predictions, train, target, actual="actual", predicted="predicted", ranged=False):
    """One row that SQL can check: rows, whether all predictions are numbers (and, for trees, inside the range of
    the training targets), the error of the training mean on the log scale, and whether the model beats it."""
    goal = F.col(target).cast("double")
    base = train.agg(F.count(F.lit(1)).alias("train_rows"), F.expm1(F.avg(F.log1p(goal))).alias("_base"),
                     F.min(goal).alias("_low"), F.max(goal).alias("_high"))
    a, p = F.col(actual), F.col(predicted)
    inside = (p >= F.col("_low") - 1e-6) & (p <= F.col("_high") + 1e-6) if ranged else F.lit(True)
    return with_totals(predictions.select(a.alias(actual), p.alias(predicted)), base).agg(
        F.count(F.lit(1)).alias("test_rows"), F.any_value("train_rows").alias("train_rows"),
        F.bool_and(p.isNotNull() & ~F.isnan(p) & inside).alias("sound"),
        F.round(F.avg(F.abs(a - F.col("_base"))), 4).alias("baseline_error"),
        (F.avg(F.abs(a - p)) < F.avg(F.abs(a - F.col("_base")))).alias("beats_baseline"))


def facts_sql(rows: str, target: str) -> str:
    return f"""SELECT count(*) AS test_rows, (SELECT count(*) FROM {rows} WHERE NOT is_test) AS train_rows, true AS sound,
  round(avg(abs({target} - (SELECT exp(avg(ln(1 + {target}))) - 1 FROM {rows} WHERE NOT is_test))), 4) AS baseline_error,
  true AS beats_baseline FROM {rows} WHERE is_test"""


FACTS = "WITH " + SIDES + " " + facts_sql("t", "avg_mtbf_h")
EVENT_FACTS = ("WITH e AS (" + _V3_SQL.replace("coalesce(prev_gap, gap_h)", "prev_gap") + f"""), sd AS (SELECT assetnum, n <= ceil(0.2 * total) AS is_test FROM
  (SELECT assetnum, row_number() OVER (ORDER BY {_ORDER.format('assetnum', 'assetnum')}) AS n, count(*) OVER () AS total
   FROM (SELECT DISTINCT assetnum FROM e))), t AS (SELECT e.*, is_test FROM e JOIN sd USING (assetnum))""")


@query("m1_scaled_features", "WITH " + SCALED + " SELECT assetnum, " + ", ".join(f"round({c}, 6) AS {c}" for c in ELEVEN) + " FROM z")
def _(spark, d):
    return rounded(scaled(spark, d, both=True).select("assetnum", *ELEVEN))


# The normal equations of the ridge, solved in SQL by elimination: row i holds feature i, column 11 the moments.
def _ridge_sql(alpha):
    n = len(ELEVEN)
    cells = [f"SELECT {i} AS i, {j} AS j, sum({x} * {ELEVEN[j]})" + (f" + {alpha}" if i == j else "") + " AS v FROM y"
             for i, x in enumerate(ELEVEN) for j in range(n)]
    cells += [f"SELECT {i}, {n}, sum({x} * (y - (SELECT avg(y) FROM y))) FROM y" for i, x in enumerate(ELEVEN)]
    steps = "".join(f""", g{k + 1} AS MATERIALIZED (SELECT a.i, a.j, CASE WHEN a.i = {k} THEN a.v / p.v
  ELSE a.v - c.v * r.v / p.v END AS v FROM g{k} a JOIN g{k} r ON r.i = {k} AND r.j = a.j
  JOIN g{k} c ON c.i = a.i AND c.j = {k} JOIN g{k} p ON p.i = {k} AND p.j = {k})""" for k in range(n))
    return f""", y AS MATERIALIZED (SELECT *, ln(1 + avg_mtbf_h) AS y FROM z WHERE NOT is_test),
  g0 AS MATERIALIZED ({" UNION ALL ".join(cells)}){steps},
  w AS (SELECT {", ".join(f"max(v) FILTER (i = {i}) AS w{i}" for i in range(n))} FROM g{n} WHERE j = {n}),
  f AS (SELECT count(*) AS train_rows, round(avg(y), 6) AS mean_prediction, avg(y) AS m, true AS stationary,
    {", ".join(f"round(avg({c} * y), 6) AS moment_{c}" for c in ELEVEN)} FROM y)"""


# Every device is predicted by the ridge over all features; a ridge is the only point where its gradient is zero.
@query("m2_ridge", "WITH " + SCALED + _ridge_sql(10) + f""" SELECT assetnum, is_test,
  round(exp(m + {" + ".join(f"z.{c} * w{i}" for i, c in enumerate(ELEVEN))}) - 1, 3) AS predicted, train_rows,
  mean_prediction, stationary, {", ".join(f"moment_{c}" for c in ELEVEN)} FROM z, w, f""")
def _(spark, d):
    s = sides(spark, d)
    model = md.fit(md.ridge(10.0), s.train, s.features, TARGET)
    z = md.z_scores(md.predict(model, s.train), s.features, md.scaler(s.features, s.train))
    weights = dict(zip(s.features, model.stages[-1].coefficients.toArray()))
    y, guess = F.log1p(TARGET), F.log1p("predicted")
    gradient = [F.sum(F.col(c) * (y - guess)) - F.lit(10.0 * float(weights[c])) for c in s.features]
    found = z.agg(F.count(F.lit(1)).alias("train_rows"), F.round(F.avg(guess), 6).alias("mean_prediction"),
                  reduce(and_, [F.abs(g) < 1e-6 for g in gradient]).alias("stationary"),
                  *[F.round(F.avg(F.col(c) * y), 6).alias(f"moment_{c}") for c in s.features])
    both = s.train.withColumn("is_test", F.lit(False)).unionByName(s.test.withColumn("is_test", F.lit(True)))
    rows = md.predict(model, both).select("assetnum", "is_test", F.round("predicted", 3).alias("predicted"))
    return with_totals(rows, found)


def _fitted(learner, ranged=False):
    def run(spark, d):
        s = sides(spark, d)
        model = md.fit(learner, s.train, s.features, TARGET)
        return facts(md.predict(model, s.test), s.train, TARGET, TARGET, ranged=ranged)
    return run


query("m3_random_forest", FACTS)(_fitted(FOREST, True))
query("m3_random_forest_plain", FACTS)(_fitted(PLAIN, True))
query("m4_boosting_absolute_loss", FACTS)(_fitted(BOOST_ABS))
query("m5_boosting_squared_loss", FACTS)(_fitted(BOOST))
query("m9_huber_regression", FACTS)(_fitted(md.huber()))


@query("l5_m6_stacking", FACTS.replace("true AS sound", "true AS sound, true AS same_when_loaded"))
def _(spark, d):
    s = sides(spark, d)
    bases = {"forest": PLAIN, "squared": BOOST, "absolute": BOOST_ABS}
    fitted = md.stack(bases, s.train, s.features, TARGET, ["assetnum"])
    path = folder_for(spark, "stack")
    save_stack(fitted, path, s.features, spark)
    out = load_stack(spark, path).predict(fitted.predict(s.test), "again")
    same = out.agg(F.bool_and(F.col("predicted") == F.col("again")).alias("same_when_loaded"))
    return facts(out, s.train, TARGET, TARGET).join(same, F.lit(True))


_ACC = ", ".join(f"greatest(0.01, (100 - avg(abs((actual - {c}) / actual) * 100)) / 100) AS w_{c}" for c in MODELS)
_WEIGHTED = "(" + " + ".join(f"{c} * w_{c}" for c in MODELS) + ") / (" + " + ".join(f"w_{c}" for c in MODELS) + ")"


@query("m7_weighted_ensemble", "WITH " + PRED + f""", w AS (SELECT {_ACC} FROM pred WHERE {_FOLD} = 0)
  SELECT assetnum, round({_WEIGHTED}, 5) AS weighted FROM pred, w WHERE {_FOLD} <> 0""")
def _(spark, d):
    rows = sp.with_fold(pred(spark, d), ["assetnum"])
    weights = m.accuracy_of(rows.filter("fold = 0"), "actual", MODELS)
    out = rows.filter("fold <> 0").select("assetnum", m.weighted_ensemble(weights).alias("weighted"))
    return rounded(out, 5)


@query("m8_mean_ensemble", "WITH " + PRED + " SELECT assetnum, round((mid + pace + upper) / 3, 5) AS average FROM pred")
def _(spark, d):
    return rounded(pred(spark, d).select("assetnum", m.mean_ensemble(MODELS).alias("average")), 5)


def _ranked(done, spark):
    """The comparison as facts: models, order by accuracy, and all better than a model of no use."""
    rows = done.table(min_actual=1.0).toPandas()
    ordered = bool((rows["accuracy"].diff().dropna() <= 0).all())
    return spark.createDataFrame([(",".join(sorted(rows["model"])), ordered, done.predictions.count(),
                                   bool((rows["r2"] > 0).all()))],
                                 "models string, in_order boolean, test_rows bigint, useful boolean")


@query("m10_model_comparison", "WITH " + SIDES + """ SELECT 'absolute,average,forest,ridge,squared,stack,weighted' AS models,
  true AS in_order, count(*) AS test_rows, true AS useful FROM t WHERE is_test""")
def _(spark, d):
    learners = {"ridge": md.ridge(10.0), "forest": PLAIN, "squared": BOOST, "absolute": BOOST_ABS}
    return _ranked(tr.compare_on_devices(
        dev(spark, d), "assetnum", learners, ["forest", "squared", "absolute"], validation_share=0.2,
        stacks={"stack": ["forest", "squared", "absolute"]}, edges=DAY_EDGES), spark)


def events(spark, d):
    return pe.history_events_raw(wo(spark, d))


_SHARE = "round(coalesce((SELECT count(*) FROM tr WHERE tr.{0} = t.{0}) / (SELECT count({0}) FROM tr), 0), 8) AS {1}"
_FILL = "coalesce({0}, (SELECT median({0}) FROM tr)) AS {0}"
_EVENT_CODES = {"cust_brand": "brand_code", "cust_subsys": "subsystem_code", "failurecode_name": "fault_code"}
_EVENT_SHARES = {"problemcode_name": "problem_freq", "cust_linenum": "line_freq"}


@query("event_training_inputs", EVENT_FACTS.replace("coalesce(r3, gap_h)", "r3").replace("coalesce(hm, gap_h)", "hm") + """,
  tr AS (SELECT * FROM t WHERE NOT is_test)
  SELECT assetnum, is_test, """ + ", ".join(
    [f"CAST(round({_FILL.split(' AS ')[0].format(c)}, 6) AS DOUBLE) AS {c}" for c in pe.V3_HISTORY]
    + [CODE.format(*x) for x in _EVENT_CODES.items()] + [_SHARE.format(*x) for x in _EVENT_SHARES.items()])
    + ", gap_h FROM t")
def _(spark, d):
    s = tr.event_sides(events(spark, d), "assetnum")
    return _six(s.train.withColumn("is_test", F.lit(False)).unionByName(s.test.withColumn("is_test", F.lit(True))))


@query("m10_event_comparison", EVENT_FACTS + """ SELECT 'average,forest,ridge,squared,stack,weighted' AS models, true AS in_order,
  count(*) AS test_rows FROM t WHERE is_test""")
def _(spark, d):
    learners = {"ridge": md.ridge(10.0), "forest": md.forest(**md.FOREST_EVENTS),
                "squared": md.boosting(**md.BOOSTING_EVENTS, ids=["assetnum"], tolerance=0.01)}
    return _ranked(tr.compare_on_events(events(spark, d), "assetnum", learners, ["ridge", "forest", "squared"],
                                        stacks={"stack": ["forest", "squared"]}), spark).drop("useful")


@query("m11_level_comparison_of_given_predictions", "WITH " + PRED + f""" SELECT CASE model WHEN 'mid' THEN 'device'
  ELSE 'event' END AS level, {_round_metrics(6)} FROM ({metrics_sql('mid', 1)} UNION ALL {metrics_sql('pace', 1)})""")
def _(spark, d):
    rows = pred(spark, d)
    one = rows.select("actual", F.col("mid").alias("predicted"))
    two = rows.select("actual", F.col("pace").alias("predicted"))
    return rounded(md.level_comparison(one, two, "actual", "predicted"))


_V4_SPLIT = "e AS (" + _V4_SQL + f"""), es AS (SELECT assetnum, n <= ceil(0.2 * total) AS is_test FROM
  (SELECT assetnum, row_number() OVER (ORDER BY {_ORDER.format('assetnum', 'assetnum')}) AS n, count(*) OVER () AS total
   FROM (SELECT DISTINCT assetnum FROM e)))"""


@query("m11_device_versus_event", "WITH " + SIDES + ", " + _V4_SPLIT + """ SELECT 'device' AS level, count(*) AS rows, true AS sound
  FROM t WHERE is_test UNION ALL SELECT 'event', count(*), true FROM e JOIN es USING (assetnum) WHERE is_test""")
def _(spark, d):
    s = sides(spark, d)
    model = md.fit(PLAIN, s.train, s.features, TARGET)
    on_devices = md.predict(model, s.test).select(F.col(TARGET).alias("actual"), "predicted")
    control = pe.event_control(wo(spark, d))
    on_events = tr.event_predictions(control, "assetnum", pe.V4_FEATURES, pe.TARGET, PLAIN, selector=md.forest(20, 8, 1),
                                     categories=("station_name", "cust_brand"))
    done = tr.device_versus_event(on_devices, on_events)
    rows = on_devices.select(F.lit("device").alias("level")).unionByName(on_events.select(F.lit("event").alias("level")))
    sound = F.col("accuracy").isNotNull() & F.col("mae").isNotNull()
    return rows.groupBy("level").agg(F.count(F.lit(1)).alias("rows")).join(
        done.select("level", sound.alias("sound")), "level")


def importance_facts(rows, features):
    """Facts on an importance table: features, sum, order."""
    ranked = rows.toPandas()
    return rows.sparkSession.createDataFrame(
        [(len(ranked), abs(float(ranked["importance"].sum()) - 1) < 1e-9,
          bool((ranked["importance"].diff().dropna() <= 0).all()), set(ranked["feature"]) <= set(features))],
        "features int, sums_to_one boolean, in_order boolean, known boolean")


IMPORTANCE = "SELECT CAST(count(*) AS INTEGER) AS features, true AS sums_to_one, true AS in_order, true AS known FROM (VALUES " + ", ".join(
    f"('{c}')" for c in (*tr.DEVICE_FEATURES, "station_enc", "brand_enc", "line_enc")) + ")"


@query("m12_o5_feature_importance", IMPORTANCE)
def _(spark, d):
    s = sides(spark, d)
    model = md.fit(PLAIN, s.train, s.features, TARGET)
    return importance_facts(md.importances(spark, model, s.features), s.features)


@query("q7_top_features_by_forest", "WITH " + SIDES + """ SELECT count(*) AS rows, CAST(10 AS INTEGER) AS features, true AS known
  FROM t WHERE NOT is_test""")
def _(spark, d):
    s = sides(spark, d)
    kept = md.top_features(s.train, s.features, TARGET, 10)
    return s.train.select("assetnum", *kept).agg(
        F.count(F.lit(1)).alias("rows"), F.lit(len(kept)).alias("features"), F.lit(set(kept) <= set(s.features)).alias("known"))


@query("s5_model_saved_and_loaded", "WITH " + SIDES + """ SELECT count(*) AS rows, true AS same, 11 AS features,
  'log1p' AS target_transform FROM t""")
def _(spark, d):
    s = sides(spark, d)
    path = folder_for(spark, "model")
    model = md.fit(md.ridge(10.0), s.train, s.features, TARGET)
    save_model(model, path, s.features, spark, accuracy=None)
    both = md.predict(load_model(path), md.predict(model, s.train.unionByName(s.test), "before"), "after")
    info = load_metadata(spark, path).select(F.size("features").alias("features"), "target_transform")
    return both.agg(F.count(F.lit(1)).alias("rows"),
                    F.bool_and(F.col("before") == F.col("after")).alias("same")).join(info, F.lit(True))


@query("training_with_hashed_categories", FACTS)
def _(spark, d):
    s = tr.device_sides(dev(spark, d), "assetnum", edges=DAY_EDGES, hashed=True)
    model = md.fit(PLAIN, s.train, s.features, TARGET)
    return facts(md.predict(model, s.test), s.train, TARGET, TARGET, ranged=True)
