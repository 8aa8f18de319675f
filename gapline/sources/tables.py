"""Typed table reads and writes."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapline.functions.times import format_time
from gapline.operators.scale import free_shuffles
from gapline.sources.layouts import read_files, source_drift
from gapline.sources.schema import CORE_COLUMNS, STANDARD_NAMES, TIME_COLUMNS, clean_schema, raw_schema


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             extra: bool = False) -> DataFrame:
    """CSV with a header, UTF-8 with or without a byte-order mark, by column name (see `layouts`).

    Fields may hold quoted line breaks; large files are still read by several tasks. Columns that a file lacks are
    null; those that `schema` lacks are left out unless `extra`. Without a schema all columns are text.
    """
    return read_files(spark, path, schema, "csv", extra)


def read_raw_work_orders(spark: SparkSession, path: str, fmt: str = "parquet", extra: bool = False) -> DataFrame:
    """Raw work orders by column name: files may lack columns, reorder them or bring others (kept where `extra`)."""
    return read_files(spark, path, raw_schema(), fmt, extra)


def raw_work_order_drift(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """What `read_raw_work_orders` leaves out or does not find: (issue, column, layouts, rows)."""
    return source_drift(spark, path, raw_schema(), fmt, {"missing_core": CORE_COLUMNS, "missing_time": TIME_COLUMNS})


def read_clean_work_orders(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_files(spark, path, clean_schema(), fmt)


def times_as_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Time columns as `yyyy-MM-dd HH:mm:ss` text, for files people open."""
    if columns is None:
        columns = [f.name for f in df.schema
                   if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType))]
    return df.withColumns({c: format_time(F.col(c)) for c in columns if c in df.columns})


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                max_records_per_file: int = 5_000_000, compression: str | None = None) -> None:
    """Write in parallel, one or more files per task; nothing passes through the driver.

    A gzip file is read by one task, so compressed files should hold fewer records.
    """
    spark, began = df.sparkSession, time.monotonic()
    if fmt == "csv":
        df = times_as_text(df)
        # All fields are quoted, so carriage returns and blanks stay; the empty string reads back as null.
        writer = df.write.option("header", True).option("escape", '"').option("quoteAll", True)
        writer = writer.option("ignoreLeadingWhiteSpace", False)
        writer = writer.option("ignoreTrailingWhiteSpace", False)
    else:
        writer = df.write
    if compression is not None:
        writer = writer.option("compression", compression)
    writer.option("maxRecordsPerFile", max_records_per_file).mode(mode).format(fmt).save(path)
    del df, writer
    free_shuffles(spark, began)


def standard_names(df: DataFrame) -> DataFrame:
    """The same table under its standard column names."""
    return df.select(*[F.col(c).alias(STANDARD_NAMES.get(c, c)) for c in df.columns])


def source_names(df: DataFrame) -> DataFrame:
    """The inverse of `standard_names`, for tables written under the standard names."""
    back = {v: k for k, v in STANDARD_NAMES.items()}
    return df.select(*[F.col(c).alias(back.get(c, c)) for c in df.columns])
