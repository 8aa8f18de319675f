"""Vectors in packed blocks, and a stated set of query vectors that visits every block.

`prepared` leaves out rows that take no part and packs each vector into bytes. `blocks` gathers them into rows
of one partition at a time, a block a row: so a visit of queries to a block moves two rows, not their vectors one by one.
`visit` sends every span of query groups to every block and runs a function on the two. A task holds one
block (BLOCK_BYTES) and one span of groups (SPAN_GROUPS of them) whatever the table's size. Blocks and groups of vectors
of other lengths never meet.

An id names one vector. Of rows that repeat an id, the one with the smallest (dimension, bytes, label) counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from gapline.operators.scale import cut_lineage

BLOCK_ROWS = 8_192         # vectors of a block
BLOCK_BYTES = 64 << 20     # bytes of a block's vectors
GROUP_ROWS = 2_048         # queries of a group
SPAN_GROUPS = 16           # groups that visit a block in one call
MOST_TASKS = 20_000

PREPARED = "vec_id bigint, label bigint, dim int, length double, vector binary"
PACKED = "part int, seq int, dim int, ids binary, labels binary, vectors binary, extra binary"


@dataclass
class Block:
    """One block or group inside a task: vectors as rows of float64."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    extra: bytes

    @classmethod
    def of(cls, row: dict) -> Block:
        ids = np.frombuffer(row["ids"], np.int64)
        kind = np.float32 if len(row["vectors"]) == 4 * len(ids) * row["dim"] else np.float64
        flat = np.frombuffer(row["vectors"], kind).astype(np.float64)
        return cls(ids, np.frombuffer(row["labels"], np.int64), flat.reshape(len(ids), row["dim"]), row["extra"] or b"")


def row_lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths, each row summed in the same order whatever rows are beside it."""
    return np.sqrt((x * x).sum(axis=1))


def _prepare(change, needs_label: bool, nonzero: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            kind = column.type.value_type.to_pandas_dtype()
            sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.list_flatten(column).fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(kind)
            edges = np.concatenate([[0], np.cumsum(sizes)])
            odd = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            good = (sizes > 0) & (odd[edges[1:]] == odd[edges[:-1]]) & batch.column(0).is_valid().to_numpy(False)
            if needs_label:
                good &= batch.column(1).is_valid().to_numpy(False)
            with np.errstate(over="ignore", invalid="ignore"):
                wide = flat.astype(np.float64) if change is None else change(flat.astype(np.float64))
                lengths = np.zeros(len(sizes))
                for size in np.unique(sizes[good]):
                    at = np.flatnonzero(good & (sizes == size))
                    lengths[at] = row_lengths(wide[edges[at][:, None] + np.arange(size)])
            if nonzero:
                some = np.concatenate([[0], np.cumsum(flat != 0)])
                good &= some[edges[1:]] > some[edges[:-1]]
            packed = pa.Array.from_buffers(pa.large_binary(), len(sizes), [
                None, pa.py_buffer((edges * flat.itemsize).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))])
            out = pa.RecordBatch.from_arrays([
                batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int64()), pa.array(sizes.astype(np.int32)),
                pa.array(lengths), packed.cast(pa.binary())], ["vec_id", "label", "dim", "length", "vector"])
            yield out.filter(pa.array(good))
    return run


def prepared(df: DataFrame, id_col: str, vector_col: str, label_col: str | None = None,
             change: Callable | None = None, nonzero: bool = False) -> DataFrame:
    """(vec_id, label, dim, length, vector) of rows that take part, one per id, written once.

    Left out are rows with a null id, a null, empty or partly null or non-finite vector, a null label where labels
    count, and zero vectors where `nonzero`. `length` is that of the vector after `change`.
    """
    inner = dict(df.select(vector_col).dtypes)[vector_col]
    vector = F.col(vector_col) if inner in ("array<float>", "array<double>") else F.col(vector_col).cast(
        ArrayType(DoubleType()))
    label = F.lit(0) if label_col is None else F.col(label_col)
    narrow = df.select(F.col(id_col).cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"),
                       vector.alias("vector"))
    rows = cut_lineage(narrow.mapInArrow(_prepare(change, label_col is not None, nonzero), PREPARED))
    if rows.groupBy("vec_id").count().filter("count > 1").isEmpty():
        return rows
    one = F.min(F.struct("dim", "vector", "label", "length")).alias("one")
    return cut_lineage(rows.groupBy("vec_id").agg(one).select(
        "vec_id", "one.label", "one.dim", "one.length", "one.vector"))


def _pack(rows: int, extra: Callable[[Block], bytes] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, n, dim = TaskContext.get().partitionId(), 0, [], 0, -1

        def out():
            t = pa.Table.from_batches(held).combine_chunks()
            row = {"part": part, "seq": seq, "dim": int(dim), "ids": t["vec_id"].to_numpy().tobytes(),
                   "labels": t["label"].to_numpy().tobytes(), "vectors": b"".join(t["vector"].to_pylist()), "extra": None}
            if extra is not None:
                row["extra"] = extra(Block.of(row))
            return _rows([row], PACKED)

        for batch in batches:
            dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
            for at, b in zip(edges, edges[1:]):
                while at < b:
                    size = max(1, min(rows, BLOCK_BYTES // (8 * int(dims[at]))))
                    if n and (n >= size or dims[at] != dim):
                        yield out()
                        held, n, seq = [], 0, seq + 1
                    dim, take = dims[at], min(b - at, size - n)
                    held.append(batch.slice(at, take))
                    n, at = n + take, at + take
        if n:
            yield out()
    return run


_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary()}


def schema_of(ddl: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _rows(rows: list[dict], ddl: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema_of(ddl))


def blocks(rows: DataFrame, size: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """A row per block of rows as they lie in their partitions, numbered, and a bound of the numbers.

    `rows` are sorted by dimension inside their partitions. Numbers have gaps where a partition has fewer blocks
    than another.
    """
    made = cut_lineage(rows.mapInArrow(_pack(size, None), PACKED))
    return _numbered(made)


def groups(rows: DataFrame, extra: Callable[[Block], bytes] | None = None, size: int = GROUP_ROWS) -> tuple[DataFrame, int]:
    """Queries as blocks, with what `extra` says of them."""
    n = rows.count() // (size * 4) + 1
    made = cut_lineage(rows.repartition(n).sortWithinPartitions("dim", "vec_id").mapInArrow(_pack(size, extra), PACKED))
    return _numbered(made)


def _numbered(made: DataFrame) -> tuple[DataFrame, int]:
    last = made.agg(F.max("part"), F.max("seq")).first()
    if last[0] is None:
        return made.withColumn("number", F.lit(0)), 0
    width = last[1] + 1
    return made.withColumn("number", F.col("part") * width + F.col("seq")), (last[0] + 1) * width


def visit(asking: tuple[DataFrame, int], asked: tuple[DataFrame, int],
          fn: Callable[[Block, Block], dict[str, np.ndarray] | None], schema: str) -> DataFrame:
    """fn(group, block) for every group and every block of its dimension, as rows of `schema`."""
    (queries, n_queries), (rows, n_rows) = asking, asked
    spans = (n_queries - 1) // SPAN_GROUPS + 1
    tasks = max(1, min(n_rows * spans, MOST_TASKS))
    to_blocks = F.explode(F.sequence(F.lit(0), F.lit(max(n_rows - 1, 0)))).alias("block")
    to_spans = F.explode(F.sequence(F.lit(0), F.lit(max(spans - 1, 0)))).alias("span")
    left = queries.select("*", to_blocks, F.floor(F.col("number") / SPAN_GROUPS).cast("int").alias("span"))
    right = rows.select("*", F.col("number").alias("block"), to_spans)
    key = ["block", "span"]

    def run(asking_rows: pa.Table, block_rows: pa.Table) -> pa.Table:
        found = []
        for row in block_rows.to_pylist():
            block = None
            for group in asking_rows.to_pylist():
                if group["dim"] == row["dim"]:
                    block = Block.of(row) if block is None else block
                    out = fn(Block.of(group), block)
                    if out is not None:
                        found.append(pa.table({f.name: pa.array(out[f.name], f.type) for f in arrow}))
        return pa.concat_tables(found) if found else arrow.empty_table()

    arrow = schema_of(schema)
    return left.repartition(tasks, *key).groupBy(*key).cogroup(
        right.repartition(tasks, *key).groupBy(*key)).applyInArrow(run, schema)
