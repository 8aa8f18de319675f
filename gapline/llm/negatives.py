"""Hard negatives by coordinate pruning over length buckets.

Rows become integer vectors, floor(scale * x). They are dealt into buckets of similar length, longest last. A
row can reach a score t with an anchor only if its cosine is at least t / (anchor's length * longest of the bucket).
That cosine allows a coordinate only a range of values around the anchor's own: on the unit sphere the angle
between the row and an axis differs from the anchor's by no more than the angle between the two. So for the anchor's
focus coordinates, its largest, the bucket's sorted coordinate lists give the rows in range by binary search. The
candidate sets are intersected and only what is left gets an exact integer product. Where the smallest range holds
over half of a bucket, the intersection would cost more than it saves and the whole bucket is verified.

The lower bounds t come from a sample of SEED_ROWS rows: the last place of its own best rows cannot be beaten by
less. They only prune; all rows are searched, and the result does not depend on the sample.

Two visits of all anchors to all buckets: the first finds each anchor's positives, the best rows of its label; the
second the best rows of other labels within the band of every positive. A visit keeps the best of a bucket only, and
a window per anchor the best of all, so no label, however large, is gathered.

Left out: rows with null id, null label, null or empty vector, or a null or non-finite component. Vectors of different
dimension do not meet. An id names one row (see `vectors`). A negative positive_score has no band and no negatives. Scores
beyond 2**63 stop the job. An empty table gives no rows; further columns of the input do not matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapline.llm import vectors
from gapline.llm.vectors import Block

FOCUS = 6                 # coordinates of an anchor whose ranges are intersected
SEED_ROWS = 4_096         # rows of the sample that gives the first lower bounds
SEED_BYTES = 16 << 20
SLACK = 1e-9              # far above the rounding of a unit vector's coordinate
PAIRS = 1 << 22           # products of a bucket made at once

FOUND = "anchor_id bigint, other_id bigint, score bigint"
BANDED = "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(scale * x)


def products(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact integer inner products, (rows, queries)."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(rows.shape[1], 1)
    if most < 2.0 ** 53:
        return (rows @ queries.T).astype(np.int64)
    if most < 2.0 ** 63:
        return rows.astype(np.int64) @ queries.astype(np.int64).T
    raise ValueError("an inner product may not fit a 64-bit integer")


class Bucket:
    """A block's integer vectors with their sorted coordinate lists, built when a coordinate is first asked for."""

    def __init__(self, block: Block, scale: int):
        self.ids, self.labels, self.rows = block.ids, block.labels, scaled(block.vectors, scale)
        lengths = vectors.row_lengths(self.rows)
        self.longest = lengths.max()
        self._unit = self.rows / np.where(lengths > 0, lengths, 1.0)[:, None]
        self._zero = lengths == 0
        self._lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self._lists:
            order = np.argsort(self._unit[:, f], kind="stable")
            self._lists[f] = order, self._unit[order, f]
        return self._lists[f]

    def candidates(self, query: np.ndarray, length: float, least: float) -> np.ndarray | None:
        """Positions that may reach `least` with the query; None for all of them."""
        if least <= 0 or length == 0:
            return None
        cosine = least / (length * self.longest) if self.longest else 2.0
        if cosine > 1 + SLACK:
            return np.zeros(0, np.int64)
        unit = query / length
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        angle, reach = np.arccos(np.clip(unit[focus], -1, 1)), np.arccos(min(cosine, 1.0))
        low = np.cos(np.minimum(angle + reach, np.pi)) - SLACK
        high = np.cos(np.maximum(angle - reach, 0)) + SLACK
        ranges = []
        for f, a, b in zip(focus.tolist(), low, high):
            order, values = self._list(f)
            ranges.append((order, np.searchsorted(values, a), np.searchsorted(values, b, "right")))
        ranges.sort(key=lambda r: r[2] - r[1])
        if 2 * (ranges[0][2] - ranges[0][1]) > len(self.ids):
            return None
        met = np.zeros(len(self.ids), np.int8)
        for order, a, b in ranges:
            met[order[a:b]] += 1
        first, a, b = ranges[0]
        kept = first[a:b]
        return kept[met[kept] == len(ranges)]

    def scores(self, queries: np.ndarray, least: np.ndarray):
        """(query, positions, exact scores) of every query whose candidates are not empty."""
        lengths, whole = vectors.row_lengths(queries), []
        for i, query in enumerate(queries):
            at = self.candidates(query, lengths[i], least[i])
            if at is None:
                whole.append(i)
            elif len(at):
                yield i, at, products(self.rows[at], query[None])[:, 0]
        every, step = np.arange(len(self.ids)), max(1, PAIRS // max(len(self.ids), 1))
        for a in range(0, len(whole), step):
            part = whole[a:a + step]
            for i, s in zip(part, np.ascontiguousarray(products(self.rows, queries[part]).T)):
                yield i, every, s


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, higher scores first, ties by smaller id."""
    if len(scores) > 8 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= floor)
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _found(columns: list[tuple], names: str) -> dict | None:
    if not columns:
        return None
    joined = [np.concatenate(c) for c in zip(*columns)]
    return dict(zip((c.split()[0] for c in names.split(", ")), joined))


def _positive_search(k: int, scale: int):
    held: list = []

    def run(group: Block, block: Block):
        if not held or held[0] is not block:
            held[:] = [block, Bucket(block, scale)]
        bucket, queries = held[1], scaled(group.vectors, scale)
        least, out = np.frombuffer(group.extra, np.float64), []
        for i, at, s in bucket.scores(queries, least):
            fit = (bucket.labels[at] == group.labels[i]) & (bucket.ids[at] != group.ids[i]) & (s >= least[i])
            at, s = at[fit], s[fit]
            top = _best(bucket.ids[at], s, k)
            out.append((np.full(len(top), group.ids[i]), bucket.ids[at[top]], s[top]))
        return _found(out, FOUND)
    return run


def _in_band(s: np.ndarray, positive: int, low: int, high: int) -> np.ndarray:
    return (100 * s >= low * positive) & (100 * s <= high * positive)


def _negative_search(k: int, scale: int, low: int, high: int):
    held: list = []

    def run(group: Block, block: Block):
        if not held or held[0] is not block:
            held[:] = [block, Bucket(block, scale)]
        bucket, queries = held[1], scaled(group.vectors, scale)
        sizes, ids, scores, least = _bands(group.extra)
        edges, out = np.concatenate([[0], np.cumsum(sizes)]), []
        floor = np.array([least[a:b].min() if b > a else np.inf for a, b in zip(edges, edges[1:])])
        asks = np.flatnonzero(np.isfinite(floor))
        for j, at, s in bucket.scores(queries[asks], floor[asks]):
            i = asks[j]
            fit = (bucket.labels[at] != group.labels[i]) & (s >= floor[i])
            at, s = at[fit], s[fit]
            for p in range(edges[i], edges[i + 1]):
                band = np.flatnonzero(_in_band(s, scores[p], low, high) & (s >= least[p]))
                top = band[_best(bucket.ids[at[band]], s[band], k)]
                n = len(top)
                out.append((np.full(n, group.ids[i]), np.full(n, ids[p]), np.full(n, scores[p]),
                            bucket.ids[at[top]], s[top]))
        return _found(out, BANDED)
    return run


def _bands(extra: bytes) -> list[np.ndarray]:
    """Per anchor the number of positives, then per positive its id, score and lower bound."""
    n = int(np.frombuffer(extra[:8], np.int64)[0])
    sizes = np.frombuffer(extra[8:8 + 8 * n], np.int64)
    rest, m = extra[8 + 8 * n:], int(sizes.sum())
    return [sizes, np.frombuffer(rest[:8 * m], np.int64), np.frombuffer(rest[8 * m:16 * m], np.int64),
            np.frombuffer(rest[16 * m:], np.float64)]


class _Seeds:
    """The sample, by dimension, as it goes to the tasks."""

    def __init__(self, rows: DataFrame, scale: int):
        width = rows.agg(F.max("dim")).first()[0] or 1
        n = max(64, min(SEED_ROWS, SEED_BYTES // (8 * width)))
        taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).select("vec_id", "label", "dim", "vector").collect()
        self._by_dim = {}
        for dim in {r.dim for r in taken}:
            part = [r for r in taken if r.dim == dim]
            block = Block.of({"ids": np.array([r.vec_id for r in part], np.int64).tobytes(), "dim": dim, "extra": b"",
                              "labels": np.array([r.label for r in part], np.int64).tobytes(),
                              "vectors": b"".join(bytes(r.vector) for r in part)})
            self._by_dim[dim] = block.ids, block.labels, scaled(block.vectors, scale)

    def scores(self, group: Block, scale: int):
        """(anchor, ids, labels, scores) with the sample rows of its dimension."""
        ids, labels, rows = self._by_dim.get(group.vectors.shape[1], (np.zeros(0, np.int64),) * 2 + (None,))
        for i, query in enumerate(scaled(group.vectors, scale)):
            yield i, ids, labels, (products(rows, query[None])[:, 0] if rows is not None else ids)


def _positive_bounds(seeds: _Seeds, k: int, scale: int):
    def run(group: Block) -> bytes:
        least = np.full(len(group.ids), -np.inf)
        for i, ids, labels, s in seeds.scores(group, scale):
            s = s[(labels == group.labels[i]) & (ids != group.ids[i])]
            if len(s) >= k:
                least[i] = np.partition(s, len(s) - k)[len(s) - k]
        return least.tobytes()
    return run


def _negative_bounds(seeds: _Seeds, k: int, scale: int, low: int, high: int):
    def run(group: Block, positives: dict[int, list[tuple[int, int]]]) -> bytes:
        sizes, ids, scores, least = [], [], [], []
        for i, _, labels, s in seeds.scores(group, scale):
            own = [p for p in positives.get(int(group.ids[i]), ()) if p[1] >= 0]
            other = s[labels != group.labels[i]]
            sizes.append(len(own))
            for other_id, score in own:
                band = other[_in_band(other, score, low, high)]
                floor = -(-low * score // 100)
                ids.append(other_id)
                scores.append(score)
                least.append(max(floor, np.partition(band, len(band) - k)[len(band) - k]) if len(band) >= k else floor)
        ints = [np.array(x, np.int64).tobytes() for x in ([len(group.ids)], sizes, ids, scores)]
        return b"".join(ints) + np.array(least, np.float64).tobytes()
    return run


def _first(df: DataFrame, key: list[str], score: str, other: str, k: int) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.desc(score), F.col(other))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hard_negatives(df: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                   label_col: str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   scale: int = 256, block_rows: int = vectors.BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `anchors` says of column vec_id which rows ask. Negatives lie between `low` and `high` percent of the positive's
    score.
    """
    rows = vectors.prepared(df, id_col, vector_col, label_col, change=lambda x: scaled(x, scale))
    n = rows.count()
    asking = rows.filter(anchors)
    seeds = _Seeds(rows, scale)
    buckets = vectors.blocks(rows.repartitionByRange(n // block_rows + 1, "dim", "length", "vec_id")
                             .sortWithinPartitions("dim", "length", "vec_id"), block_rows)
    asked = vectors.groups(asking, _positive_bounds(seeds, positives, scale))
    found = vectors.visit(asked, buckets, _positive_search(positives, scale), FOUND)
    best = vectors.cut_lineage(_first(found, ["anchor_id"], "score", "other_id", positives))
    told = _with_positives(asked, best, _negative_bounds(seeds, negatives, scale, low, high))
    found = vectors.visit(told, buckets, _negative_search(negatives, scale, low, high), BANDED)
    ranked = _first(found, ["anchor_id", "positive_id", "positive_score"], "negative_score", "negative_id", negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _with_positives(asked: tuple[DataFrame, int], best: DataFrame, bounds) -> tuple[DataFrame, int]:
    """The groups again, each with its anchors' positives and their lower bounds."""
    import pyarrow as pa

    queries, count = asked
    schema = vectors.schema_of(vectors.PACKED + ", number int")

    def members(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), row["number"], np.int32))],
                                                 ["anchor_id", "number"])

    def attach(group_rows: pa.Table, found: pa.Table) -> pa.Table:
        positives: dict[int, list[tuple[int, int]]] = {}
        for anchor, other, score in zip(*(found[c].to_pylist() for c in ("anchor_id", "other_id", "score"))):
            positives.setdefault(anchor, []).append((other, score))
        out = [row | {"extra": bounds(Block.of(row), positives)} for row in group_rows.to_pylist()]
        return pa.Table.from_pylist(out, schema)

    place = queries.select("ids", "number").mapInArrow(members, "anchor_id bigint, number int")
    placed = best.join(place, "anchor_id")
    out = queries.groupBy("number").cogroup(placed.groupBy("number")).applyInArrow(
        attach, vectors.PACKED + ", number int")
    return vectors.cut_lineage(out), count
