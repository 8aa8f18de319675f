"""Language ID: held-out accuracy, what may be read, unknown texts, one or no language, edge rows."""

import zlib

from pyspark.sql import functions as F

from gapline.llm import language


def test_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.learn(docs)
    extra = spark.createDataFrame([(None, None), (-1, ""), (-2, "12 + 5!\n"), (-3, "x" * 100_000)],
                                  "doc_id bigint, text string")
    rows = language.identify(docs.select("doc_id", "text").unionByName(extra), model).join(
        docs.select("doc_id", "lang"), "doc_id", "left").collect()
    assert len(rows) == docs.count() + 4
    held = [r for r in rows if r.held_out and r.lang]
    assert 300 < len(held) < 370
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert [by[i].lang_pred for i in (None, -1, -2)] == ["und"] * 3
    assert by[-3].lang_pred != "und"
    for i in (0, 1, 2, 3, 17):
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_held_out_labels_and_other_columns_are_not_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    spoiled = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("xx"))
                              .otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    a = {r.doc_id: r.lang_pred for r in language.identify(docs, language.learn(docs)).collect()}
    b = {r.doc_id: r.lang_pred for r in language.identify(spoiled, language.learn(spoiled)).collect()}
    assert a == b


def test_few_languages(spark):
    docs = spark.createDataFrame([(i, "some words", "en", 1) for i in range(9)],
                                 "doc_id bigint, text string, lang string, score int")
    assert {r.lang_pred for r in language.identify(docs, language.learn(docs)).collect()} == {"en"}
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(docs, language.learn(none)).collect()} == {"und"}
    empty = docs.filter("doc_id < 0")
    assert language.identify(empty, language.learn(empty)).count() == 0
