"""CSV files as gzip: fewer bytes on the disks, the same rows."""

import pytest
from pyspark.sql import functions as F

from checks.cleaning import _drifting
from gapline.sources.tables import read_csv, write_table


@pytest.mark.parametrize("text", ["plain", "two\nlines", "a\rb"])
def test_packed_files_of_two_layouts(spark, tmp_path, text):
    rows = spark.range(300).select(F.col("id").cast("string").alias("id"), F.lit(text).alias("note"),
                                   F.concat(F.lit('"x", '), "id").alias("more"))
    path = str(tmp_path / "packed")
    write_table(rows.drop("more"), path, "csv", max_records_per_file=40, compression="gzip")
    write_table(rows.select("more", "note", "id"), path, "csv", "append", 40, "gzip")
    assert all(p.name.endswith(".csv.gz") for p in (tmp_path / "packed").glob("part*"))
    wanted = sorted([(r["id"], r["note"], None) for r in rows.collect()] + [tuple(r) for r in rows.collect()], key=str)
    got = read_csv(spark, path, rows.schema).collect()
    assert sorted([tuple(r) for r in got], key=str) == wanted


def test_drifting_csv_files_are_packed(spark, sf):
    files = spark.read.format("binaryFile").load(_drifting(spark, sf, "csv")).select("path", "length").collect()
    assert files and all(r["path"].endswith(".csv.gz") for r in files)
