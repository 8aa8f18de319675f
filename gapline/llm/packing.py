"""Best-fit packing of token sequences with certified bin counts.

Documents become token ids and an end id; only longer ones are cut, into full pieces and a first
piece with the rest. Pieces are dealt to groups by hash, and every group packs its pieces by
best-fit decreasing over the histogram of lengths. Dual feasible functions give a lower bound of the
bins a group needs. A group that meets its bound gives up only its emptiest bin, whose rest is the
rounding of the bound; a group with a gap also gives up its most wasteful bins. The pieces of
these bins are exchanged: dealt into an eighth of the groups, packed again, and so on until one group
is left. A repacking that needs no fewer bins than before is dropped.

Groups hold about GROUP_PIECES pieces whatever the table, and what is exchanged is a few bins a group,
so no task grows with the input. Rounds grow with its logarithm.

Result of `pack`, one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset,
group_bins and group_bound (bins and lower bound of the group that placed it). Null or empty text:
one piece with the end id alone. Rows that repeat an id are packed like any other. An empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.llm.bpe import vocabulary
from gapline.llm.common import narrow, slices, tidy
from gapline.operators.scale import cut_lineage

GROUP_PIECES = 100_000
MERGE = 8                         # groups that meet in one group of the next round
DFF_STEPS = 100                   # rounding functions tried besides the threshold functions

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_PLACED = (_PIECES + ", part bigint, sequence_id bigint, offset bigint, open boolean, "
           "group_bins bigint, group_bound bigint")


def pieces(df: DataFrame, path: str, size: int, end_id: int, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for part in slices(batches, size=1 << 19):
            ids, edges = vocab.encode(part.column(1).to_pylist())
            n = np.diff(edges) + 1
            count = -(-n // size)
            first = n - (count - 1) * size
            row = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * size)
            length = np.where(piece == 0, first[row], size)
            full = np.insert(ids, edges[1:], end_id).astype("<u4")
            at = (edges[:-1] + np.arange(len(n)))[row] + start
            crc = [zlib.crc32(full[a:b]) for a, b in zip(at.tolist(), (at + length).tolist())]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)),
                 pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])
        vocab.forget()

    return narrow(df, id_col, text_col).mapInArrow(tidy(run), _PIECES)


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Bins that any packing needs: the largest bound of two families of dual feasible functions.

    Threshold t: lengths above size - t count as a full bin, those under t as nothing.
    Rounding k: a length counts as floor((k + 1) x / size) / k bins, or as itself where
    (k + 1) x / size is whole.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=size + 1)[:size + 1].astype(np.int64)
    x = np.arange(size + 1, dtype=np.int64)
    total = int((counts * x).sum())
    best = -(-total // size)
    over = np.cumsum(counts[::-1])[::-1]                     # over[v]: lengths of v or more
    sums = np.append(0, np.cumsum(counts * x))               # sums[v]: total of lengths under v
    for t in range(1, size // 2 + 1):
        weight = int(over[size - t + 1]) * size + int(sums[size - t + 1] - sums[t])
        best = max(best, -(-weight // size))
    for k in range(1, DFF_STEPS + 1):
        step, rest = np.divmod((k + 1) * x, size)
        # In units of 1 / (k * size) bins, so that all numbers are whole.
        weight = int((counts * np.where(rest == 0, k * x, step * size)).sum())
        best = max(best, -(-weight // (k * size)))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, and the number of bins.

    Pieces of one length are placed together: the bins with the least room that fits take as
    many of them as go in, which is what best fit does one by one.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[list[np.ndarray]] = [[] for _ in range(size + 1)]     # bins by room left
    used, at = 0, 0
    values, counts = np.unique(lengths, return_counts=True)
    for value, count in zip(values[::-1].tolist(), counts[::-1].tolist()):
        items, at = order[at:at + count], at + count
        for r in range(value, size + 1):
            if not len(items):
                break
            if not room[r]:
                continue
            free = np.concatenate(room[r])
            room[r] = []
            items = _fill(items, free, r, value, size, bins, offsets, room)
        if len(items):
            each = size // value
            fresh = np.arange(used, used - (-len(items) // each))
            used += len(fresh)
            _fill(items, fresh, size, value, size, bins, offsets, room)
    return bins, offsets, used


def _fill(items, free, r, value, size, bins, offsets, room) -> np.ndarray:
    """Put items into bins with room r, as many a bin as fit; the items left over."""
    each = r // value
    now = min(len(items), each * len(free))
    slot = np.arange(now)
    target = free[slot // each]
    bins[items[:now]] = target
    offsets[items[:now]] = size - r + (slot % each) * value
    touched, last = divmod(now, each)
    if touched:
        room[r - each * value].append(free[:touched])
    if last:
        room[r - last * value].append(free[touched:touched + 1])
    if len(free) > touched + bool(last):
        room[r].append(free[touched + bool(last):])
    return items[now:]


def _pack_group(size: int, number: int, last: bool):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("piece", "ascending"),
                               ("ids_crc32", "ascending")])
        lengths = group.column("length").to_numpy()
        part = group.column("part")[0].as_py()
        bins, offsets, used = best_fit_decreasing(lengths, size)
        if number:
            old, back = np.unique(group.column("sequence_id").to_numpy(), return_inverse=True)
            if used >= len(old):                             # no better than before
                bins, offsets, used = back, group.column("offset").to_numpy(), len(old)
        bound = lower_bound(lengths, size)
        waste = size - np.bincount(bins, weights=lengths, minlength=used).astype(np.int64)
        give = np.zeros(used, bool)
        if not last:
            worst = np.argsort(-waste, kind="stable")
            worst = worst[waste[worst] > 0]
            enough = np.cumsum(waste[worst]) >= (used - bound + 1) * size
            give[worst[:(int(np.argmax(enough)) + 1 if enough.any() else len(worst))
                       if used > bound else 1]] = True
        return pa.table({
            **{c: group.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "part")},
            "sequence_id": pa.array((np.int64(number) << 56) | (np.int64(part) << 32) | bins),
            "offset": pa.array(offsets), "open": pa.array(give[bins]),
            "group_bins": pa.array(np.full(len(bins), used)),
            "group_bound": pa.array(np.full(len(bins), bound))})
    return run


def pack(cut: DataFrame, size: int, group_pieces: int = GROUP_PIECES, least_groups: int = 1) -> DataFrame:
    """Place the rows of `pieces` into sequences of at most `size` ids. More groups than pieces need waste bins."""
    rest = cut_lineage(cut).withColumn("sequence_id", F.lit(0).cast("bigint")).withColumn(
        "offset", F.lit(0).cast("bigint"))
    groups = max(least_groups, rest.count() // group_pieces + 1)
    done: DataFrame | None = None
    number = 0
    while True:
        dealt = rest.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", F.lit(number)), F.lit(groups))
                                if not number else F.pmod(F.xxhash64("sequence_id"), F.lit(groups)))
        placed = cut_lineage(dealt.groupBy("part").applyInArrow(
            _pack_group(size, number, groups == 1), _PLACED))
        closed = placed.filter(~F.col("open")).drop("open", "part")
        done = closed if done is None else done.unionByName(closed)
        if groups == 1:
            return done
        rest = placed.filter("open").select(
            "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
        groups, number = -(-groups // MERGE), number + 1


def pack_documents(df: DataFrame, path: str, size: int = 1024, end_id: int = 2,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(pieces(df, path, size, end_id, id_col, text_col), size)
