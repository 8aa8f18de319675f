"""Time the headline jobs and print one JSON line.

BENCH_SF_DIR picks the tables (default sf0.1), BENCH_CPUS the local cores (default 8).
Every query runs in full into a sink that throws the rows away; `forest_fit` is the training
of the published forest (100 trees, depth 10, 5 rows per leaf) on prepared training rows.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from checks import base  # noqa: E402
from checks.stats import features, _FEATURES  # noqa: E402
from gapline.operators import devices as dv  # noqa: E402
from gapline.operators import history as h  # noqa: E402
from gapline.operators import models as md  # noqa: E402
from gapline.operators import stats as st  # noqa: E402
from gapline.operators.cleaning import (Rules, cleaning_audit, judge_rows,  # noqa: E402
                                        standardize_columns)
from gapline.operators.metrics import regression_metrics  # noqa: E402
from gapline.plans import events as pe  # noqa: E402
from gapline.plans import training as tr  # noqa: E402
from gapline.plans.cleaning import clean_work_orders  # noqa: E402
from gapline.session import local_session  # noqa: E402
from gapline.sources.schema import STANDARD_NAMES  # noqa: E402


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("gapline-bench", cores, int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    facts: dict[str, float] = {}

    def timed(name, run):
        start = time.perf_counter()
        out = run()
        seconds[name] = round(time.perf_counter() - start, 3)
        return out

    # The inputs a user would have on disk: raw and cleaned work orders, in several files.
    scratch = tempfile.mkdtemp(prefix="gapline-bench-")
    base.raw(spark, folder).repartition(8).write.parquet(f"{scratch}/raw")
    base.wo(spark, folder).repartition(8).write.parquet(f"{scratch}/clean")
    raw, clean = (spark.read.parquet(f"{scratch}/{n}") for n in ("raw", "clean"))
    log = base.log(spark, folder)
    drain(log)
    timed("gaps", lambda: drain(h.with_gaps(log)))
    timed("history_windows", lambda: drain(h.with_history(log)))
    timed("device_table", lambda: drain(dv.device_mtbf(log)))
    timed("clean_work_orders", lambda: drain(clean_work_orders(
        raw, Rules(period=base.JUDGE_PERIOD))))
    timed("event_table", lambda: drain(pe.history_events(clean)))
    timed("event_history_table", lambda: drain(pe.history_events_raw(clean)))
    timed("event_screened_table", lambda: drain(pe.screened_events(clean)[0]))
    timed("cleaning_audit", lambda: cleaning_audit(judge_rows(
        standardize_columns(raw, {c: c for c in STANDARD_NAMES}),
        Rules(period=base.JUDGE_PERIOD))).collect())
    timed("event_control_table", lambda: drain(pe.event_control(clean)))
    timed("correlations", lambda: st.target_correlations(
        features(spark, folder), _FEATURES, "gap_h").collect())
    timed("variance_inflation", lambda: st.variance_inflation(features(spark, folder), _FEATURES))
    timed("box_per_category", lambda: drain(st.box_stats(
        h.positive_gaps(h.with_gaps(log)), "gap_h", "cust_brand")))
    sides = timed("device_split_and_encode", lambda: tr.device_sides(
        dv.device_mtbf(log), "assetnum", edges=base.DAY_EDGES))
    model = timed("forest_fit", lambda: md.fit(
        md.forest(**md.FOREST_PLAIN), sides.train, sides.features, tr.TARGET))
    row = timed("forest_score", lambda: regression_metrics(
        md.predict(model, sides.test), tr.TARGET, "predicted", 1.0).first())
    facts["devices_trained"] = sides.train.count()
    facts["log_rows"] = log.agg(F.count(F.lit(1))).first()[0]
    facts["work_order_rows"] = clean.count()
    facts["history_rows_per_second"] = round(facts["log_rows"] / seconds["history_windows"])
    facts["forest_accuracy_percent"] = round(row["accuracy"], 2)
    facts["forest_r2"] = round(row["r2"], 4)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")), "cores": int(cores),
        "facts": facts}))
    spark.stop()


if __name__ == "__main__":
    main()
