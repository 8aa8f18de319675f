"""Edge rows by hand: nulls, blanks, tabs, bad dates, inverted and equal times."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapline.functions import bins, times
from gapline.functions.text import is_missing
from gapline.operators import cleaning as c
from gapline.sources.schema import STANDARD_NAMES, raw_schema
from gapline.sources.tables import (read_clean_work_orders, read_csv, source_names,
                                    standard_names, write_table)


def raw_rows(spark, *changes):
    base = {"assetnum": "A1", "wonum": "W", "current_faildate": "2021-05-01 10:00:00",
            "repair_end_time": "2021-05-01 12:00:00", "repair_duration_hours": 2.0,
            "total_failure_count": 1, "is_first_failure": 0}
    rows = [{**base, "wonum": f"W{i}", **change} for i, change in enumerate(changes)]
    return spark.createDataFrame([tuple(r.get(n) for n in STANDARD_NAMES) for r in rows], raw_schema())


def test_each_rule_counts_its_rows(spark):
    raw = raw_rows(
        spark, {}, {"wonum": "W0"}, {"assetnum": None}, {"assetnum": " \t "},
        {"current_faildate": ""}, {"current_faildate": "bad"}, {"repair_end_time": "soon"},
        {"repair_end_time": "2021-04-30"}, {"repair_end_time": "2021-05-01 10:00:00"},
        {"current_faildate": "2019-12-31", "repair_end_time": "2021-01-01"},
        {"current_faildate": "2026-12-31", "repair_end_time": "2027-01-01"},
        {"current_faildate": "2026-12-31 00:00:01", "repair_end_time": "2027-01-01"},
        {"repair_duration_hours": -1.0}, {"repair_duration_hours": None})
    judged = c.judge_rows(raw)
    audit = {r["step"]: r["dropped"] for r in c.cleaning_audit(judged).collect()}
    assert audit == {"duplicate": 1, "missing_core": 3, "inverted_times": 1, "outside_period": 2,
                     "unparsed_core": 2, "negative_repair": 1}
    kept = {r["wonum"] for r in c.kept_rows(judged).collect()}
    assert kept == {"W0", "W8", "W10", "W13"}
    assert {r["wonum"] for r in c.clean_rows(raw).collect()} == kept
    summary = c.cleaning_summary(judged).first()
    assert (summary["rows_in"], summary["rows_out"], summary["columns_out"]) == (14, 4, 29)


def test_summary_of_an_empty_table(spark):
    summary = c.cleaning_summary(c.judge_rows(raw_rows(spark, {}).limit(0))).first()
    assert (summary["rows_in"], summary["kept_percent"]) == (0, 0.0)


def test_last_day_of_the_period_can_be_included(spark):
    raw = raw_rows(spark, {"current_faildate": "2026-12-31 23:00:00", "repair_end_time": "2027-01-01"})
    assert c.clean_rows(raw).count() == 0
    assert c.clean_rows(raw, c.Rules(end_inclusive_day=True)).count() == 1


def test_times_in_several_spellings(spark):
    texts = ["2024-01-05 08:03:09", "2024/01/05 08:03", "2024-1-5", " \t2024-01-05T08:03:09 ",
             "2024-02-30", "2024-13-01", "bad", "", None, "08:03 on 05.01.2024"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in rows.select(times.parse_time(F.col("t"))).collect()]
    day = dt.datetime(2024, 1, 5)
    assert got == [dt.datetime(2024, 1, 5, 8, 3, 9), dt.datetime(2024, 1, 5, 8, 3), day,
                   dt.datetime(2024, 1, 5, 8, 3, 9), None, None, None, None, None, None]
    more = [r[0] for r in rows.select(times.parse_time(F.col("t"), ["HH:mm 'on' dd.MM.yyyy"])).collect()]
    assert more == [*got[:-1], dt.datetime(2024, 1, 5, 8, 3)]


SPELLINGS = [
    "20240105", "20240105 080309", "20240105080309", "20240105T0803", "202401050803", "20240105 08:03", "20240105 8",
    "2024-01-05T08:03:09Z", "2024-01-05 08:03:09+08:00", "2024-01-05T08:03:09.5-0530", "2024-01-05 08:03:09.1234567",
    "  2024-01-05 08:03:09.123456789\t", "01/05/2024 08:03", "13/01/2024", "01-05-2024", "05.01.2024 07:08",
    "2024-01-05 3:04 PM", "2024-01-05 15:04 PM", "2024-01-05 0:04 PM", "2024-01-05 12:30 am", "01/05/2024 12:00 pm",
    "Jan 5, 2024", "5 Jan 2024 3 PM", "05-Jan-2024", "5 Sept 2024", "January 5 2024 10:11:12.5", "2024.01.05",
    "2024-01-05 24:00", "2024-01-05 8", "2024-01-05 08:03:60", "13/13/2024", "02/30/2024", "2024-01-05|1", "99999999",
    "12345678901234567890"]


def test_mixed_spellings_are_read_one_by_one_as_pandas_does(spark):
    import pandas as pd

    def expected(text):
        value = pd.to_datetime(pd.Series([text]), format="mixed", errors="coerce")[0]
        if value is pd.NaT:
            return None
        value = value.tz_convert("UTC").tz_localize(None) if value.tzinfo else value
        return value.floor("us").to_pydatetime()

    rows = spark.createDataFrame(list(enumerate(SPELLINGS)), "i int, t string").orderBy("i")
    got = [r[0] for r in rows.select(times.parse_time(F.col("t"))).collect()]
    assert dict(zip(SPELLINGS, got)) == {t: expected(t) for t in SPELLINGS}


def test_texts_that_are_no_time_are_counted_by_column(spark):
    raw = raw_rows(spark, {"current_faildate": "bad"}, {"prev_faildate": "soon"}, {"prev_faildate": " "},
                   {"prev_faildate": "20240105"}, {"repair_end_time": "x", "start_of_operation": "y"})
    counts = {r["column"]: (r.unparsed, r.dropped) for r in c.unparsed_times(c.judge_rows(raw)).collect()}
    assert counts == {"current_faildate": (1, 1), "prev_faildate": (1, 0), "repair_start_time": (0, 0),
                      "repair_end_time": (1, 1), "start_of_operation": (1, 1)}
    assert c.clean_rows(raw).columns == list(STANDARD_NAMES)


def test_bins_are_closed_on_the_right(spark):
    days = [0.0, 0.1, 15.0, 15.1, 23.0, 40.0, 999.0, 999.1, None]
    rows = spark.createDataFrame([(x,) for x in days], "x double")
    got = [r[0] for r in rows.select(bins.right_closed_bin(F.col("x"))).collect()]
    assert got == [None, 0, 0, 1, 1, 3, 4, None, None]


def test_blank_means_whitespace_of_any_kind(spark):
    rows = spark.createDataFrame([("",), ("\t \n",), (None,), ("x",)], "t string")
    assert [r[0] for r in rows.select(is_missing(F.col("t"))).collect()] == [True, True, True, False]


def test_csv_with_mark_and_line_breaks(spark, tmp_path):
    (tmp_path / "in.csv").write_text('﻿id,note\n1,"two\nlines, and ""quotes"""\n2,\n', encoding="utf-8")
    schema = T.StructType().add("id", "integer").add("note", "string")
    rows = read_csv(spark, str(tmp_path / "in.csv"), schema).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 'two\nlines, and "quotes"'), (2, None)]


def test_cleaned_table_survives_csv(spark, tmp_path):
    cleaned = c.clean_rows(raw_rows(spark, {}, {"problem_desc": 'line one\nline "two"'}))
    write_table(cleaned, str(tmp_path / "out"), "csv")
    back = read_clean_work_orders(spark, str(tmp_path / "out"), "csv")
    assert sorted(map(str, back.collect())) == sorted(map(str, cleaned.collect()))
    assert source_names(standard_names(cleaned)).columns == cleaned.columns


def test_reports_of_the_job_are_those_of_its_rows(spark, tmp_path):
    from gapline.plans.cleaning import run_cleaning

    raw = raw_rows(spark, {}, {"wonum": "W0"}, {"assetnum": None}, {"current_faildate": "bad"}, {"repair_duration_hours": -1.0})
    for rows in (raw, raw.limit(0)):
        audit, summary = run_cleaning(rows, str(tmp_path / "out"))
        judged = c.judge_rows(rows)
        assert audit.collect() == c.cleaning_audit(judged).collect()
        assert summary.collect() == c.cleaning_summary(judged).collect()
        assert read_clean_work_orders(spark, str(tmp_path / "out")).count() == summary.first()["rows_out"]
