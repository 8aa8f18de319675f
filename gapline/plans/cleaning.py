"""The cleaning job: raw work orders in; cleaned table, audit and summary out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation

from gapline.operators.cleaning import (Rules, audit_of, clean_rows, judge_rows, judgement_counts, kept_rows,
                                        standardize_columns, summary_of)
from gapline.sources.schema import STANDARD_NAMES
from gapline.sources.tables import standard_names, write_table


def clean_work_orders(raw: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Cleaned rows under the source names, times parsed."""
    return clean_rows(_mapped(raw), rules)


def _mapped(raw: DataFrame) -> DataFrame:
    return standardize_columns(raw, {c: c for c in STANDARD_NAMES})


def run_cleaning(raw: DataFrame, path: str, fmt: str = "parquet", rules: Rules = Rules(),
                 rename: bool = False) -> tuple[DataFrame, DataFrame]:
    """Write the cleaned table and return (audit, summary).

    Both reports come from metrics observed while the table is written: one pass, nothing kept beside the result.
    """
    judged, seen = judge_rows(_mapped(raw), rules), Observation()
    cleaned = kept_rows(judged.observe(seen, *judgement_counts()))
    write_table(standard_names(cleaned) if rename else cleaned, path, fmt)
    counts = raw.sparkSession.createDataFrame([seen.get], ", ".join(f"{c} bigint" for c in seen.get))
    return audit_of(counts), summary_of(counts, len(cleaned.columns))
