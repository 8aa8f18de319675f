"""The corpus pipeline: stages in order, each over all rows that its predecessor kept.

language     learn languages on the rows that are not held out, reject texts without a letter and
             texts whose language is unclear (score under MIN_SCORE)
exact        of texts equal up to blanks the longest stays
near         of texts linked by 0.8 of their five-word shingles the smallest id stays
repeats      strings of 50 bytes or more that an earlier document holds are cut out; a character cut in two
             goes whole, n_chars follows, and a document with nothing left goes
pack         the rest as token pieces in sequences of 1024

All but the last return the columns of their input. Null texts are rejected by the first stage; a null id is
an id like any other. Rows that share an id are documents of their own, in order of their texts. An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.llm import exact, language, minhash, packing, suffixes
from gapline.llm.queries import BYTE_BPE
from gapline.operators.scale import cut_lineage, row_numbers

MIN_SCORE = 0.3
NEAR_PERCENT = 80
BROADCAST_ROWS = 1_000_000        # ids that may be broadcast: 16 MB


def _free(docs: DataFrame, name: str) -> str:
    """The name, or one like it that no column has."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def _with_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents and a column that names each row: doc_id, or where ids repeat a number by id and text."""
    if docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        return docs, "doc_id"
    name = _free(docs, "_row")
    order = ["doc_id", "text", *[c for c, t in docs.dtypes if c not in ("doc_id", "text") and "map" not in t]]
    return cut_lineage(row_numbers(docs, order, name=name)), name


def _pick(docs: DataFrame, row: str, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on the row's name; ids are broadcast only while few."""
    own = _free(docs, "_id")
    ids = cut_lineage(ids.select(F.col("doc_id").alias(own)))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    return docs.join(ids, docs[row] == F.col(own), how)


def _kept(docs: DataFrame, decide) -> DataFrame:
    """The rows that `decide` keeps; decisions are per row, also where rows share an id."""
    rows, name = _with_rows(docs)
    gone = decide(rows, name).filter("not kept")
    return _pick(rows, name, gone, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs, language.learn(docs), MIN_SCORE)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, lambda rows, name: exact.exact_duplicates(rows, name))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, lambda rows, name: minhash.near_duplicates(rows, NEAR_PERCENT, id_col=name))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, name = _with_rows(docs)
    cut = suffixes.remove_repeats(rows, id_col=name, as_text=True).filter("n_removed > 0")
    own, text = _free(rows, "_id"), _free(rows, "_text")
    changed = cut_lineage(cut.select("doc_id", F.col("kept").alias("left")))
    same = _pick(rows, name, changed, "left_anti")
    left = changed.filter("left <> ''").select(F.col("doc_id").alias(own), F.col("left").alias(text))
    new = rows.drop("text").join(left, F.col(name) == F.col(own)).withColumn("text", F.col(text))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    names = [f"`{c}`" for c in docs.columns]
    return same.select(*names).unionByName(new.select(*names))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, BYTE_BPE, size=1024, end_id=2).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language", identify), ("exact", exact_copies), ("near", near_copies), ("repeats", repeats),
          ("pack", pack)]
ORACLE_SQL = None      # SQL expresses neither the learned languages nor the packing


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
