"""Files whose columns drift, and CSV files of quoted line breaks read by several tasks."""

import csv
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapline.sources import layouts

SCHEMA = T.StructType().add("id", "integer").add("note", "string").add("more", "string")


def field(rng):
    return rng.choice(["", "a", "x,y", "two\nlines", 'q "quoted" z', "in\r\nside", "\r", " edge ", "é", "end\n", "\n\n", '"',
                       "long " * rng.randint(1, 60)])


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_records_across_splits_of_drifting_files(spark, tmp_path, small_splits):
    rng, want = random.Random(1), []
    files = {"a": ["id", "note", "more"], "b": ["more", "id", "note", "extra"], "c": ["id", "note"]}
    for name, columns in files.items():
        mark, end = ("utf-8-sig", "\n") if name == "b" else ("utf-8", "\r\n" if name == "c" else "\n")
        with open(tmp_path / f"{name}.csv", "w", newline="", encoding=mark) as out:
            writer = csv.writer(out, lineterminator=end, quoting=csv.QUOTE_ALL)
            writer.writerow(columns)
            for i in range(120):
                row = {"id": str(i), **{c: field(rng) for c in ("note", "more", "extra")}}
                if i == 60:
                    row["note"] = "one field over many splits\n" * 300
                writer.writerow([row[c] for c in columns])
                want.append((i, *((row[c] or None) if c in columns else None for c in ("note", "more", "extra"))))
    path = str(tmp_path)
    assert layouts._lines(spark, path).select(F.spark_partition_id()).distinct().count() > 20
    rows = layouts.read_files(spark, path, SCHEMA, "csv", extra=True)
    assert rows.columns == ["id", "note", "more", "extra"]
    assert sorted(map(repr, map(tuple, rows.collect()))) == sorted(map(repr, want))
    assert layouts.read_files(spark, path, SCHEMA, "csv").columns == SCHEMA.names
    drift = layouts.source_drift(spark, path, SCHEMA, "csv", {"missing": ["id", "more"]}).collect()
    lost = sum(1 for w in want[120:240] if w[3])
    assert sorted(map(tuple, drift)) == [("missing", "more", 1, 120), ("unmapped", "extra", 1, lost)]


def test_parquet_files_of_other_columns_and_types(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).select(F.col("id").cast("int"), F.lit("n").alias(" note ")).write.parquet(path)
    spark.range(3, 5).select(F.lit("m").alias("more"), F.col("id").cast("string"), F.lit(1.5).alias("extra")).write.mode(
        "append").parquet(path)
    rows = layouts.read_files(spark, path, SCHEMA, extra=True)
    assert dict(rows.dtypes) == {"id": "int", "note": "string", "more": "string", "extra": "double"}
    assert sorted(tuple(r) for r in rows.collect()) == [
        (0, "n", None, None), (1, "n", None, None), (2, "n", None, None), (3, None, "m", 1.5), (4, None, "m", 1.5)]
    assert layouts.source_drift(spark, path, SCHEMA).count() == 1


def test_headers_only_odd_headers_and_nothing(spark, tmp_path):
    (tmp_path / "h.csv").write_text("id,note,more\n")
    assert layouts.read_files(spark, str(tmp_path), SCHEMA, "csv").count() == 0
    (tmp_path / "i.csv").write_text('id,id,\n1,"2",3\n')
    rows = layouts.read_files(spark, str(tmp_path / "i.csv"), None, "csv")
    assert rows.columns == ["id", "id_1", "_2"] and tuple(rows.first()) == ("1", "2", "3")
    (tmp_path / "j.csv").write_text('"a\nb",c\n1,2\n')
    with pytest.raises(ValueError):
        layouts.read_files(spark, str(tmp_path / "j.csv"), None, "csv")


def test_files_of_one_line_records_are_read_by_spark(spark, tmp_path, monkeypatch):
    lines = ['1,"a ""b"" c",x', "", "2,,", '3," y ","é"', "4,z", "no,q,r"]
    (tmp_path / "plain.csv").write_text("id,note,more\n" + "\n".join(lines) + "\n")
    (tmp_path / "other.csv").write_bytes(b"\xef\xbb\xbfmore,id,extra\nm,5,e")
    path, made = str(tmp_path), layouts._records_of
    slow = made(spark, path, layouts._csv_splits(spark, path)[0]).count()
    monkeypatch.setattr(layouts, "_records_of", lambda *a: pytest.fail("records are put together in Python"))
    rows = layouts.read_files(spark, path, SCHEMA, "csv", extra=True)
    want = [(1, 'a "b" c', "x", None), (2, None, None, None), (3, " y ", "é", None), (4, "z", None, None),
            (None, "q", "r", None), (5, None, "m", "e")]
    assert sorted(map(repr, map(tuple, rows.collect()))) == sorted(map(repr, want)) and slow == len(want)
    # A line break, a carriage return or a blank line in one file leaves the others to Spark.
    monkeypatch.setattr(layouts, "_records_of", made)
    for i, text in enumerate(('6,"two\nlines",', "6,cr,\r", "   \n6,n,")):
        (tmp_path / "rough.csv").write_text("id,note,more\n" + text + "\n", newline="")
        splits, columns = layouts._csv_splits(spark, path)
        assert len(layouts._plain_files(splits, [T.StructType([T.StructField(n, T.StringType()) for n in c]) for c in columns])) == 2
        assert {r["file"].rsplit("/")[-1] for r in splits.filter("rough").collect()} == {"rough.csv"}
        assert layouts.read_files(spark, path, SCHEMA, "csv").count() == len(want) + (2 if i == 2 else 1)
