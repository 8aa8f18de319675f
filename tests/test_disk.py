"""What lies on the disks: no copies in long form, no columns that are not read, no files of finished work."""

import re
import time

import numpy as np
from pyspark.sql import functions as F

from checks.base import wo
from gapline.operators import quantiles as q
from gapline.operators import scale
from gapline.plans import events as pe


def kept(monkeypatch, module):
    """The tables that the module checkpoints from now on."""
    seen = []
    cut = scale.cut_lineage
    monkeypatch.setattr(module, "cut_lineage", lambda df: seen.append(df) or cut(df))
    return seen


def shuffle_files(spark) -> set[str]:
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    files = env.blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(files)
            if f.getName().startswith("shuffle_")}


def test_columns_are_not_copied_in_long_form(spark, monkeypatch):
    rng = np.random.default_rng(3)
    values = rng.normal(size=(2_000, 3)).round(1)
    df = spark.createDataFrame([tuple(map(float, r)) for r in values], "a double, b double, c double").repartition(4)
    for copied in (True, False):
        with monkeypatch.context() as m:
            seen = kept(m, q)
            got = {r["column"]: r["p"] for r in q.column_quantiles(df, ["a", "b", "c"], {"p": 0.3}, 50, copied).collect()}
            wide = [t for t in seen if set(t.columns) == {"a", "b", "c"}]
            assert len(wide) == copied
            assert all(t.count() < 2_000 for t in seen if t not in wide)
        assert np.allclose([got[c] for c in "abc"], np.quantile(values, 0.3, axis=0), rtol=0, atol=1e-12)


def test_event_tables_keep_only_what_they_read(spark, sf, monkeypatch):
    rows = wo(spark, sf)
    for make in (pe.history_events, pe.history_events_raw, pe.screened_events):
        with monkeypatch.context() as m:
            seen = kept(m, pe)
            make(rows)
            assert not {"wonum", "repair_end_time", "repair_start_time"} & set(seen[0].columns)
    with monkeypatch.context() as m:
        seen = kept(m, pe)
        pe.history_events_raw(rows)
        assert seen[0].filter("gap_h < 10").isEmpty()
        pe.history_events(rows)
        low = seen[1].filter("gap_h < 10")
        assert low.count() > 0 and low.filter("hist_count is not null or assetnum is not null").isEmpty()


def test_segments_hold_only_what_the_table_reads(spark, sf, monkeypatch):
    seen = kept(monkeypatch, scale)
    pe.history_events_raw(wo(spark, sf), hot_rows=60)
    segments = [t for t in seen if scale.SEGMENT in t.columns]
    assert segments and not {"station_name", "worktype", "repair_end_time"} & set(segments[0].columns)


def test_lines_move_twice_before_they_go_to_their_device(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = wo(spark, sf).groupBy("assetnum").count()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    place = next(i for i, x in enumerate(lines) if "FileScan" in x and "lineitem.parquet" in x)
    depth, moved = len(lines[place]), []
    for x in reversed(lines[:place + 1]):          # the steps above the scan of the lines
        if (at := re.search(r"[A-Za-z]|\*", x).start()) < depth:
            depth = at
            moved += [x] if "Exchange hashpartitioning" in x else []
    assert len(moved) == 3


def test_shuffle_files_of_finished_work_go(spark, monkeypatch):
    monkeypatch.setattr(scale, "FREE_AFTER", 0.0)
    scale.cut_lineage(spark.range(10))
    time.sleep(1)
    before = shuffle_files(spark)
    rows = scale.cut_lineage(spark.range(1_000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and rows.count() == 7
