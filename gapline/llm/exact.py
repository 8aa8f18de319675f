"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. One scan gives a narrow digest table (id, length, SHA-256 and sender of each text), kept in the
   shared folder. The sender is the partition of the scan.
2. Every sender sorts its distinct fingerprints and sends each owner of a fingerprint range one
   Golomb-coded list. A group of copies is at most one entry of such a list.
3. An owner marks fingerprints that came from two senders, or twice from one, and answers each
   sender with a bitmap.
4. Only texts with a marked fingerprint are suspects. They are grouped by their whole normalised
   bytes, which verifies equality; copies meet in the map side of that aggregate, so a group that
   holds a third of all rows sends one row per task.
5. Keepers and group sizes are joined back to the digests by SHA-256. Adaptive execution splits a
   large group there.

The fingerprints travel in `BITS` bits; a false match only makes a suspect, never a duplicate.
Two different texts with one SHA-256 would stop the job.

Result, one row per input row: doc_id, keep_id, group_size, kept, digest (32 bytes), n_chars.
Null texts are empty texts and equal each other. Rows that repeat a doc_id are rows of their own
in group_size; of rows with one id all share kept. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapline.llm import golomb
from gapline.llm.common import narrow
from gapline.operators.scale import cut_lineage

BITS = 48                         # bits of a fingerprint that travel
ROWS_PER_OWNER = 250_000        # fingerprints of an owner, about
BLANKS = " \t\n\x0b\x0c\r"
BROADCAST_ROWS = 2_000_000        # ids of suspects that may be broadcast: 16 MB

_MESSAGE = "owner bigint, sender bigint, marked binary, plain binary"
_ANSWER = "sender bigint, owner bigint, twice array<bigint>"


def normalised(text) -> F.Column:
    """The text without its ASCII blanks."""
    return F.translate(text, BLANKS, "")


def _digests(docs: DataFrame) -> DataFrame:
    sha = F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256))
    part = docs.select("doc_id", F.length("text").cast("bigint").alias("n_chars"),
                       sha.alias("digest"))
    mark = F.conv(F.hex(F.substring("digest", 1, BITS // 8)), 16, 10).cast("bigint")
    return cut_lineage(part.select(
        "*", mark.alias("mark"), F.spark_partition_id().cast("bigint").alias("sender")))


def _send(owners: int):
    shift = np.uint64(BITS)

    def owner_of(marks: np.ndarray) -> np.ndarray:
        return ((marks * np.uint64(owners)) >> shift).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[np.ndarray]] = {}
        for b in batches:
            marks = b.column(1).to_numpy(zero_copy_only=False).astype(np.uint64)
            senders = b.column(0).to_numpy(zero_copy_only=False)
            for s in np.unique(senders).tolist():
                got.setdefault(s, []).append(marks[senders == s])
        for sender, lists in got.items():
            marks, counts = np.unique(np.concatenate(lists), return_counts=True)
            owner = owner_of(marks)
            cuts = np.flatnonzero(np.diff(owner)) + 1
            for m, c in zip(np.split(marks, cuts), np.split(counts, cuts)):
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(owner_of(m[:1])[0])]), pa.array([sender]),
                    pa.array([golomb.encode(m[c > 1])], pa.binary()),
                    pa.array([golomb.encode(m[c == 1])], pa.binary())],
                    names=["owner", "sender", "marked", "plain"])
    return run


def _answer(group: pa.Table) -> pa.Table:
    """The fingerprints of each sender that another sender also has, as the bits of its list."""
    plain = [golomb.decode(x) for x in group.column("plain").to_pylist()]
    marked = [golomb.decode(x) for x in group.column("marked").to_pylist()]
    every = np.concatenate(plain + marked)
    values, counts = np.unique(every, return_counts=True)
    twice = values[counts > 1]
    rows = []
    for own, both in zip(plain, marked):
        order = np.sort(np.concatenate([own, both]))
        hit = np.isin(order, twice) | np.isin(order, both)
        words = np.zeros((len(hit) + 63) // 64 * 64, np.uint8)
        words[:len(hit)] = hit
        rows.append(np.packbits(words, bitorder="little").view("<i8").tolist())
    return pa.table([group.column("sender"), group.column("owner"),
                     pa.array(rows, pa.list_(pa.int64()))], names=["sender", "owner", "twice"])


def suspects(digests: DataFrame, rows: int, rows_per_owner: int = ROWS_PER_OWNER) -> DataFrame:
    """(doc_id, digest) of the rows whose fingerprint is not alone, with the bitmaps' help."""
    owners = rows // rows_per_owner + 1
    answers = (digests.select("sender", "mark").mapInArrow(_send(owners), _MESSAGE)
               .groupBy("owner").applyInArrow(_answer, _ANSWER))
    # Place of a row's fingerprint in its sender's list: the bit to read.
    owner = F.shiftright(F.col("mark") * owners, BITS)
    placed = digests.select(
        "doc_id", "digest", "sender", owner.alias("owner"),
        (F.dense_rank().over(Window.partitionBy("sender", owner).orderBy("mark")) - 1)
        .cast("bigint").alias("place"))
    bit = F.expr("getbit(element_at(twice, cast(place div 64 + 1 as int)), cast(place % 64 as int))")
    return placed.join(answers, ["sender", "owner"]).filter(bit == 1).select("doc_id", "digest")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     rows_per_owner: int = ROWS_PER_OWNER) -> DataFrame:
    docs = narrow(df, id_col, text_col)
    digests = _digests(docs)
    rows = digests.count()
    marked = cut_lineage(suspects(digests, rows, rows_per_owner).select("doc_id").distinct())
    few = marked.count() <= BROADCAST_ROWS
    marked = marked.withColumnRenamed("doc_id", "suspect")
    text = docs.join(F.broadcast(marked) if few else marked,
                     F.col("doc_id").eqNullSafe(F.col("suspect")), "left_semi")
    best = F.struct((-F.length("text")).cast("bigint").alias("l"), "doc_id")
    equal = (text.select(normalised(F.col("text")).alias("norm"), best.alias("best"))
             .groupBy("norm").agg(F.min("best").alias("best"), F.count(F.lit(1)).alias("n")))
    groups = equal.filter("n > 1").select(
        F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest"),
        F.col("best.doc_id").alias("best_id"), F.col("n"))
    groups = groups.groupBy("digest").agg(
        F.first("best_id").alias("best_id"), F.first("n").alias("n"),
        F.count(F.lit(1)).alias("texts"))
    keep = (F.when(F.col("texts").isNull(), F.col("doc_id")).when(F.col("texts") == 1, F.col("best_id"))
            .otherwise(F.raise_error(F.lit("two texts share one SHA-256")).cast("bigint")))
    return digests.join(groups, "digest", "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "digest", "n_chars")
