"""History features against a plain loop, in the one-window and the segmented plan."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gapline.operators.devices import device_mtbf
from gapline.operators.history import Timeline, min_records, with_gaps, with_history
from gapline.operators.scale import heavy_keys, row_numbers

TL = Timeline("device", "at", ("no",), "hours")


def failures(devices: int, seed: int, hot_share: float = 0.0) -> pd.DataFrame:
    rng = random.Random(seed)
    rows, no = [], 0
    for d in range(devices):
        n = rng.randint(1, 30)
        at = dt.datetime(2021, 1, 1)
        for _ in range(n):
            at += dt.timedelta(hours=rng.choice([0, 1, 5, 12.5, 30, 77.25, 400]))
            rows.append((d, no, at, float(rng.randint(0, 9)) if rng.random() > 0.2 else None))
            no += 1
    at = dt.datetime(2021, 1, 1)
    for _ in range(int(hot_share / (1 - hot_share) * len(rows))):
        at += dt.timedelta(hours=rng.choice([0, 2, 9, 31]))
        rows.append((devices, no, at, float(rng.randint(0, 9))))
        no += 1
    rng.shuffle(rows)
    return pd.DataFrame(rows, columns=["device", "no", "at", "hours"])


def spark_rows(spark, pdf):
    rows = [(int(d), int(n), t.to_pydatetime(), None if h != h else float(h))
            for d, n, t, h in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, "device int, no int, at timestamp_ntz, hours double")


def loop(pdf: pd.DataFrame, keep_zero: bool) -> pd.DataFrame:
    out = []
    for device, g in pdf.sort_values(["device", "at", "no"]).groupby("device"):
        times, repairs, nos = list(g["at"]), list(g["hours"]), list(g["no"])
        gaps, seen = [], []
        start_repair = None
        for i in range(1, len(times)):
            gap = (times[i] - times[i - 1]).total_seconds() / 3600
            if gap == 0 and not keep_zero:
                continue
            if start_repair is None:
                start_repair = (repairs[i],)
            known = [r for r in seen if r == r]
            days = max((times[i] - times[0]).total_seconds() / 86400, 1)
            out.append((device, nos[i], gap, len(gaps), np.mean(gaps) if gaps else np.nan,
                        np.std(gaps) if len(gaps) > 1 else 0.0, gaps[-1] if gaps else np.nan,
                        np.mean(gaps[-3:]) if gaps else np.nan,
                        (np.mean(known) if known else np.nan) if gaps else start_repair[0],
                        seen[-1] if gaps else start_repair[0], days, len(gaps) / days,
                        np.mean([*gaps[-2:], gap])))
            gaps.append(gap)
            seen.append(repairs[i])
    return pd.DataFrame(out, columns=[
        "device", "no", "gap_h", "hist_count", "hist_mean_gap", "hist_std_gap", "last_gap",
        "recent3_gap", "hist_mean_repair", "last_repair", "days_running", "hist_rate",
        "rolling3_gap"])


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("zero_gaps", ["drop", "keep"])
@pytest.mark.parametrize("hot_rows", [10**6, 25, 4])
def test_history_equals_a_loop(spark, seed, zero_gaps, hot_rows):
    pdf = failures(12, seed, hot_share=0.34)
    got = with_history(spark_rows(spark, pdf), TL, zero_gaps=zero_gaps, hot_rows=hot_rows).toPandas()
    want = loop(pdf, zero_gaps == "keep")
    got = got[want.columns].sort_values("no").reset_index(drop=True)
    want = want.sort_values("no").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9, atol=1e-9)


def test_a_third_of_all_rows_on_one_device(spark):
    pdf = failures(200, 7, hot_share=0.34)
    rows = spark_rows(spark, pdf)
    assert [k for k, _ in heavy_keys(rows, "device", 100)] == [200]
    plain = device_mtbf(rows, TL, {}).toPandas().sort_values("device", ignore_index=True)
    split = device_mtbf(rows, TL, {}, hot_rows=100).toPandas().sort_values("device", ignore_index=True)
    pd.testing.assert_frame_equal(plain, split, rtol=1e-9)
    assert 200 in set(plain["device"])


def test_null_device_rows_are_kept_in_both_plans(spark):
    rows = spark_rows(spark, failures(5, 3)).withColumn(
        "device", F.when(F.col("device") != 2, F.col("device")))
    plain = with_gaps(rows, TL).toPandas().sort_values("no", ignore_index=True)
    split = with_gaps(rows, TL, hot_rows=2).toPandas().sort_values("no", ignore_index=True)
    pd.testing.assert_frame_equal(plain, split)
    assert len(plain) == rows.count()


def test_row_numbers_over_the_whole_table(spark):
    rows = spark.range(1000).withColumn("x", F.pmod(F.xxhash64("id"), F.lit(50)))
    a = row_numbers(rows, ["x", "id"]).toPandas().sort_values("id", ignore_index=True)
    b = row_numbers(rows, ["x", "id"], hot_rows=90).toPandas().sort_values("id", ignore_index=True)
    pd.testing.assert_frame_equal(a, b)
    assert sorted(b["row_no"]) == list(range(1, 1001))


def test_single_record_devices_and_minimum(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "device string, no int")
    assert {r["no"] for r in min_records(rows, 2, "device").collect()} == {2, 3}


def test_options_are_checked(spark):
    with pytest.raises(ValueError):
        with_history(spark_rows(spark, failures(2, 1)), TL, no_history="mean")


def test_constant_gaps_over_segments_have_no_deviation(spark):
    start, step = dt.datetime(2021, 1, 1), dt.timedelta(microseconds=25_333_333_333)
    pdf = pd.DataFrame([(1, i, start + i * step, 1.0) for i in range(300)], columns=["device", "no", "at", "hours"])
    rows = with_history(spark_rows(spark, pdf), TL, hot_rows=20).collect()
    assert len(rows) == 299 and {r.hist_std_gap for r in rows} == {0.0}
