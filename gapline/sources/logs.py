"""Metric lines out of job logs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.functions.text import strip

# A line with any of these words reports a result.
RESULT_WORDS = ("MAE", "MAPE", "1-MAPE", "最优", "精度", "达标", "加分")
LINE_TAIL = 250


def result_lines(lines: DataFrame, column: str = "value", words: Sequence[str] = RESULT_WORDS,
                 tail: int = LINE_TAIL) -> DataFrame:
    """Lines holding any of the words, stripped and cut to their last `tail` characters."""
    any_word = "|".join(re.escape(w) for w in words)
    kept = lines.filter(F.col(column).rlike(any_word))
    return kept.withColumn(column, F.right(strip(F.col(column)), F.lit(tail)))


def read_result_lines(spark: SparkSession, path: str) -> DataFrame:
    """Result lines of a log file or folder; the scan splits large files by line."""
    return result_lines(spark.read.text(path))


def count_lines(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count(F.lit(1)).alias("lines"))


def split_lines(text: Column) -> Column:
    return F.split(text, "\n")
