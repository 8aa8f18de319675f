"""Suffix-array dedup: remove what an earlier document already holds, by longest previous factors.

A byte goes if some string of `length` bytes over it also starts in a document with a smaller id. The longest
previous factor of a position is the longest match with an earlier document; in suffix order it is the
larger of the common prefixes with the previous and with the next position of a smaller document.

Sorting all suffixes of a corpus is not needed: only positions that share a string can match, and equal
strings have equal minimizers (the smallest hash of their 24-byte pieces). So the suffix order is cut down in
steps, each an exchange in which a task sends one entry per key, however many documents hold it:

Texts move once: compressed, dealt by row and kept in the shared folder, where each step finds them beside the
short lists of the step before.

1. Texts equal to an earlier one are settled as a whole.
2. Minimizers of all other texts go to the owners of their hash range, Golomb-coded. A minimizer that
   only one document has cannot match; the others make the suspects.
3. A run of positions under one suspect minimizer is a stretch of text. Stretches equal to one of a smaller
   document are covered. If all stretches of a minimizer are equal, its first is settled too.
4. What is left are the edges of copied passages. Their suffixes are sorted by their first `length` bytes in
   each task, longest previous factors come from nearest smaller documents in that order, and the
   suffixes without an earlier match go to the owners of their hash, who find the smallest document of each.

Owners know strings by 64-bit hashes over a prime field (`Rolling`; two of 128 bits and the length for whole
texts), so what goes between tasks is decided by equal hashes, not by a second suffix order; minimizers only select
(40 bits). Matches never cross
documents. Result of `remove_repeats`, one row per input row: doc_id, kept (binary), n_bytes, n_removed,
n_spans. Null texts are empty and stay; texts under `length` bytes stay. Rows that repeat an id do not
remove each other. A null id is the smallest. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.llm import golomb
from gapline.llm.common import NO_ID, Rolling, Wrapping, flat_bytes, give_back, id_array, mix, slices, tidy
from gapline.operators.scale import cut_lineage

LENGTH = 50                       # bytes of a repeat
PIECE = 24                        # bytes of a minimizer
KEY_BITS = 40
FLUSH = 800_000                   # entries a task gathers before it sends them
OWNER_ENTRIES = 500_000           # entries an owner gets, about: some 100 MB while it works
BROADCAST_ROWS = 1_000_000        # keys of rows that may be broadcast: 16 MB
BASE = 0x9E3779B97F4A7C15
NOISE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))

_MESSAGE = "owner bigint, ids binary, tags binary, refs binary, keys binary, values binary, many binary"
_REPLY = "target bigint, flag binary, ids binary, tags binary, counts binary, values binary"
_TOLD = "id bigint, tag bigint, covered array<binary>, open array<binary>"


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=3)
    for part in slices(batches, size=1 << 20):
        blobs = [packer.compress(t) for t in part.column(2).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(blobs, pa.binary())],
                                         names=["id", "tag", "blob"])


def unpacked(batches: Iterator[pa.RecordBatch], size: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batches with the third column decompressed, in pieces of about `size` bytes of it."""
    reader = zstandard.ZstdDecompressor()
    for batch in batches:
        texts: list[bytes] = []
        start, held = 0, 0
        for i in range(batch.num_rows):
            texts.append(reader.decompress(batch.column(2)[i].as_py()))
            held += len(texts[-1])
            if held >= size or i + 1 == batch.num_rows:
                part = batch.slice(start, i + 1 - start)
                yield part.set_column(2, "text", pa.array(texts, pa.large_binary()))
                texts, start, held = [], i + 1, 0
        batch = part = None
        give_back()


class Slice:
    """Bytes, edges and rolling hashes of a piece of a batch."""

    def __init__(self, part: pa.RecordBatch, length: int):
        self.ids = part.column(0).to_numpy(zero_copy_only=False)
        self.tags = part.column(1).to_numpy(zero_copy_only=False)
        self.data, self.edges = flat_bytes(part.column(2))
        self.length = length
        self._rolling: Rolling | None = None

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes that decide whether strings are equal."""
        if self._rolling is None:
            self._rolling = Rolling(self.data, NOISE)
        return self._rolling.hashes(starts, ends)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Stretches of string starts under one minimizer: row, first and last start, key."""
        n, none = len(self.data), np.zeros(0, np.int64)
        if n < self.length:
            return none, none, none, none.astype(np.uint64)
        least = Wrapping(self.data, NOISE).windows(PIECE)     # only selects
        window, done = self.length - PIECE + 1, 1
        while done * 2 <= window:
            least = np.minimum(least[:-done], least[done:])
            done *= 2
        if done < window:
            least = np.minimum(least[:len(least) - (window - done)], least[window - done:])
        # least[p] is now the minimizer of the string that starts at p; strings must end inside their row.
        row = np.repeat(np.arange(len(self.ids)), np.diff(self.edges))[:len(least)]
        inside = np.arange(len(least)) + self.length <= self.edges[1:][row]
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new & inside)
        ends = np.append(np.flatnonzero(new)[1:], len(least)) - 1
        last = ends[np.searchsorted(np.flatnonzero(new), first)]
        last = np.minimum(last, self.edges[1:][row[first]] - self.length)
        key = mix(least[first] + np.uint64(5)) >> np.uint64(64 - KEY_BITS)
        return row[first], first, last, key


def _positions(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges, and the range of each."""
    size = last - first + 1
    which = np.repeat(np.arange(len(size)), size)
    return np.arange(len(which)) - (np.cumsum(size) - size)[which] + first[which], which


def _tagged(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """A key that stands for a value in one row of a slice."""
    return values ^ mix(row.astype(np.uint64) + np.uint64(1))


def _in_lists(values: np.ndarray, row: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether each value is in the list of its row; a list is an array of packed numbers."""
    parts, rows = [], []
    for i, blobs in enumerate(lists.to_pylist()):
        for b in blobs or ():
            parts.append(np.frombuffer(b, np.uint64))
            rows.append(np.full(len(parts[-1]), i))
    if not parts:
        return np.zeros(len(values), bool)
    return np.isin(_tagged(values, row), _tagged(np.concatenate(parts), np.concatenate(rows)))


class Outbox:
    """Entries (key, value, row) of a task, and the rows they belong to."""

    def __init__(self, owners: int, bits: int):
        self.owners, self.bits = owners, bits
        self.clear()

    def clear(self) -> None:
        self.ids: list[np.ndarray] = []
        self.tags: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.rows = self.count = 0

    def add(self, part: Slice, row: np.ndarray, *columns: np.ndarray) -> None:
        used, ref = np.unique(row, return_inverse=True)
        self.ids.append(part.ids[used])
        self.tags.append(part.tags[used])
        self.parts.append((ref + self.rows, *columns))
        self.rows += len(used)
        self.count += len(row)

    def gathered(self) -> tuple[np.ndarray, ...]:
        parts, self.parts = self.parts, []
        return tuple(np.concatenate(c) for c in zip(*parts))

    def all_rows(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(self.ids), np.concatenate(self.tags)

    def owner_of(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(self.bits - 32)) * np.uint64(self.owners) >> np.uint64(32)).astype(np.int64)


def _pack(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in _MESSAGE.split(", ")]
    types = [pa.int64()] + [pa.binary()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _send(box: Outbox, ids: np.ndarray, tags: np.ndarray, keys: np.ndarray, refs: np.ndarray,
          values: np.ndarray | None, many: np.ndarray) -> Iterator[tuple]:
    """Messages per owner: sorted keys with the row of each, and keys that need no answer."""
    write = golomb.encode
    own, own_many = box.owner_of(keys), box.owner_of(many)
    for o in np.union1d(own, own_many).tolist():
        a, b = np.searchsorted(own, [o, o + 1])
        c, d = np.searchsorted(own_many, [o, o + 1])
        used, ref = np.unique(refs[a:b], return_inverse=True)
        ref = ref.astype("<u2" if len(used) < 1 << 16 else "<u4")
        yield (o, ids[used].tobytes(), tags[used].tobytes(), ref.tobytes(), write(keys[a:b]),
               b"" if values is None else values[a:b].tobytes(), write(many[c:d]))


def _told(box: Outbox, ids, tags, refs, covered, open_, rng) -> Iterator[tuple]:
    """What a task knows by itself, passed on through owners in turn: `covered` or open values of rows."""
    for flag, (ref, value) in ((b"c", (refs[0], covered)), (b"o", (refs[1], open_))):
        if len(ref):
            used, counts = np.unique(ref, return_counts=True)
            yield (int(rng.integers(box.owners)), ids[used].tobytes(), tags[used].tobytes(),
                   counts.astype("<u4").tobytes(), None, value[np.argsort(ref, kind="stable")].tobytes(), flag)


def _bundles(ids, tags, values, flag: bytes, targets: int) -> Iterator[tuple]:
    """What documents are told, packed into one row per target: a target gets all rows of its documents."""
    target = (mix(ids.view(np.uint64) ^ mix(tags.view(np.uint64))) % np.uint64(targets)).astype(np.int64)
    order = np.lexsort((tags, ids, target))
    target, ids, tags, values = target[order], ids[order], tags[order], values[order]
    for own in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(target)) + 1):
        if len(own):
            yield (int(target[own[0]]), flag, *_by_row(ids[own], tags[own]), values[own].tobytes())


def _by_row(ids: np.ndarray, tags: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Ids, tags and lengths of the runs of equal (id, tag)."""
    first = np.append(True, (np.diff(ids) != 0) | (np.diff(tags) != 0))
    counts = np.diff(np.append(np.flatnonzero(first), len(ids)))
    return ids[first].tobytes(), tags[first].tobytes(), counts.astype("<u4").tobytes()


def _unbundle(wide):
    """One row per document from the bundles of a target."""
    def run(group: pa.Table) -> pa.Table:
        lists: dict[tuple[int, int], tuple[list, list]] = {}
        for flag, ids, tags, counts, values in zip(*(group.column(c).to_pylist() for c in (
                "flag", "ids", "tags", "counts", "values"))):
            ends = np.cumsum(np.frombuffer(counts, "<u4").astype(np.int64)) * np.dtype(wide).itemsize
            for i, t, a, b in zip(np.frombuffer(ids, np.int64).tolist(), np.frombuffer(tags, np.int64).tolist(),
                                  np.append(0, ends[:-1]).tolist(), ends.tolist()):
                lists.setdefault((i, t), ([], []))[flag == b"o"].append(values[a:b])
        blobs = pa.list_(pa.binary())
        return pa.table({
            "id": pa.array([k[0] for k in lists], pa.int64()), "tag": pa.array([k[1] for k in lists], pa.int64()),
            "covered": pa.array([[b"".join(v[0])] if v[0] else [] for v in lists.values()], blobs),
            "open": pa.array([[b"".join(v[1])] if v[1] else [] for v in lists.values()], blobs)})
    return run


def _wide(kind: str):
    """What a value is: a place in a text, or a hash."""
    return "<u4" if kind == "suffixes" else np.uint64


def _narrowest(values: bytes, n: int, wide) -> np.ndarray:
    return np.frombuffer(values, "<u2").astype(wide) if len(values) == 2 * n else np.frombuffer(values, wide)


def _answers(kind: str, targets: int):
    """An owner's work on the messages it got."""
    def run(group: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        told: dict[bytes, list] = {b"c": [], b"o": []}
        got: list[tuple] = []
        many: list[np.ndarray] = []
        read = golomb.decode
        wide = _wide(kind)
        for ids, tags, refs, keys, values, flag in zip(*(group.column(c).to_pylist() for c in (
                "ids", "tags", "refs", "keys", "values", "many"))):
            ids, tags = np.frombuffer(ids, np.int64), np.frombuffer(tags, np.int64)
            if keys is None:
                counts = np.frombuffer(refs, "<u4")
                told[flag].append((np.repeat(ids, counts), np.repeat(tags, counts), np.frombuffer(values, wide)))
                continue
            ref = np.frombuffer(refs, "<u2" if len(ids) < 1 << 16 else "<u4").astype(np.int64)
            keys = read(keys)
            got.append((keys, ids[ref], tags[ref],
                        _narrowest(values, len(keys), wide) if values else keys))
            many.append(read(flag))
        if got:
            key, ids, tags, value = (np.concatenate(c) for c in zip(*got))
            got = []
            # Order of keys, then of what they stand for, then of documents: suffix order.
            stands = value if kind == "stretches" else key
            order = np.lexsort((tags, ids, stands, key))
            key, ids, tags, value = key[order], ids[order], tags[order], value[order]
            order = stands = None
            same_key = key[1:] == key[:-1]
            group_of = np.append(0, np.cumsum(~same_key)) if len(key) else np.zeros(0, np.int64)
            if kind == "minimizers":
                shared = (np.bincount(group_of)[group_of] > 1) | np.isin(key, np.concatenate(many)) \
                    if len(key) else np.zeros(0, bool)
                told[b"c"].append((ids[shared], tags[shared], key[shared]))
            elif kind == "stretches":
                equal = same_key & (value[1:] == value[:-1])
                first = np.ones(len(key), bool)
                first[1:] = ~equal
                least = ids[first][np.cumsum(first) - 1] if len(key) else ids
                late = ids > least
                told[b"c"].append((ids[late], tags[late], value[late]))
                if len(key):
                    mixed = (np.bincount(group_of, weights=first)[group_of] > 1) | np.isin(
                        key, np.concatenate(many))
                    told[b"o"].append(tuple(x[mixed & ~late] for x in (ids, tags, value)))
            else:
                first = np.append(True, ~same_key) if len(key) else np.zeros(0, bool)
                least = ids[first][np.cumsum(first) - 1] if len(key) else ids
                late = ids > least
                told[b"c"].append((ids[late], tags[late], value[late]))
        for flag, parts in told.items():
            if parts:
                rows += _bundles(*(np.concatenate(c) for c in zip(*parts)), flag, targets)
        types = [pa.int64()] + [pa.binary()] * 5
        columns = list(zip(*rows)) or [[]] * 6
        got = many = told = rows = []
        give_back()
        return pa.table({c.split()[0]: pa.array(v, t)
                         for c, v, t in zip(_REPLY.split(", "), columns, types)})
    return run


def _send_minimizers(owners: int, length: int):
    def flush(box: Outbox, rng) -> pa.RecordBatch:
        ids, tags = box.all_rows()
        ref, key = box.gathered()
        order = np.lexsort((ref, key))
        ref, key = ref[order], key[order]
        new = np.append(True, (key[1:] != key[:-1]) | (ref[1:] != ref[:-1]))
        ref, key = ref[new], key[new]
        first = np.append(True, key[1:] != key[:-1])
        number = np.cumsum(first) - 1
        shared = np.bincount(number)[number] > 1
        alone = ~shared
        rows = list(_send(box, ids, tags, key[alone], ref[alone], None, key[first & shared]))
        rows += _told(box, ids, tags, (ref[shared], ref[:0]), key[shared], key[:0], rng)
        return _pack(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box, rng = Outbox(owners, KEY_BITS), np.random.default_rng(1)
        for batch in unpacked(batches):
            part = Slice(batch, length)
            row, _, _, key = part.runs()
            if len(row):
                box.add(part, row, key)
            if box.count > FLUSH:
                yield flush(box, rng)
                box.clear()
        if box.count:
            yield flush(box, rng)
    return run


def _suspect_runs(batch: pa.RecordBatch, length: int):
    """Stretches of a batch whose minimizer is on the list of their row, with their hash."""
    part = Slice(batch, length)
    row, first, last, key = part.runs()
    keep = _in_lists(key, row, batch.column(3))
    row, first, last, key = row[keep], first[keep], last[keep], key[keep]
    return part, row, first, last, key, part.hashes(first, last + length)


def _open_strings(batch: pa.RecordBatch, length: int) -> tuple[Slice, np.ndarray, np.ndarray]:
    """Row and place of every string that starts in an open stretch."""
    part, row, first, last, _, value = _suspect_runs(batch, length)
    keep = _in_lists(value, row, batch.column(4))
    at, which = _positions(first[keep], last[keep])
    return part, row[keep][which], at


def _send_stretches(owners: int, length: int):
    def flush(box: Outbox, rng) -> pa.RecordBatch:
        ids, tags = box.all_rows()
        ref, key, value = box.gathered()
        order = np.lexsort((ref, ids[ref], value, key))
        ref, key, value = ref[order], key[order], value[order]
        new_key = np.append(True, key[1:] != key[:-1])
        first = new_key | np.append(True, value[1:] != value[:-1])
        least = ids[ref[first]][np.cumsum(first) - 1]
        late = ids[ref] > least
        number = np.cumsum(new_key) - 1
        mixed = np.bincount(number, weights=first)[number] > 1
        lone = ~late & ~mixed
        lone &= np.append(True, (key[1:] != key[:-1]) | (value[1:] != value[:-1]) | (ref[1:] != ref[:-1]))
        # One key may have several rows of its smallest id; all of them ask.
        rows = []
        asked = np.flatnonzero(lone)
        layer = asked - np.maximum.accumulate(np.where(new_key, np.arange(len(key)), 0))[asked]
        for k in np.unique(layer).tolist():
            own = asked[layer == k]
            rows += _send(box, ids, tags, key[own], ref[own], value[own],
                          key[new_key & mixed] if k == 0 else key[:0])
        if not len(asked):
            rows += _send(box, ids, tags, key[:0], ref[:0], value[:0], key[new_key & mixed])
        open_ = ~late & mixed
        rows += _told(box, ids, tags, (ref[late], ref[open_]), value[late], value[open_], rng)
        return _pack(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box, rng = Outbox(owners, KEY_BITS), np.random.default_rng(2)
        for batch in unpacked(batches):
            part, row, _, _, key, value = _suspect_runs(batch, length)
            if len(row):
                box.add(part, row, key, value)
            if box.count > FLUSH:
                yield flush(box, rng)
                box.clear()
        if box.count:
            yield flush(box, rng)
    return run


def suffix_order(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes by their first bytes (one row each), and the common prefix with the one before."""
    n, length = windows.shape
    padded = np.zeros((n, (length + 7) // 8 * 8), np.uint8)
    padded[:, :length] = windows
    words = padded.view(">u8").astype(np.uint64)
    order = np.lexsort(tuple(words[:, k] for k in range(words.shape[1] - 1, -1, -1)))
    sorted_ = windows[order]
    lcp = np.zeros(n, np.int64)
    if n > 1:
        other = sorted_[1:] != sorted_[:-1]
        lcp[1:] = np.where(other.any(axis=1), np.argmax(other, axis=1), length)
    return order, lcp


def longest_previous(documents: np.ndarray, lcp: np.ndarray, length: int) -> np.ndarray:
    """Longest previous factor of every place in suffix order, matches under `length` as 0.

    The nearest places of a smaller document on both sides are found by jumping along such places; the
    common prefix is the smallest on the way.
    """
    def one_side(doc: np.ndarray, low: np.ndarray) -> np.ndarray:
        to = np.arange(len(doc)) - 1
        low = low.copy()
        to[low < length] = -1
        while True:
            more = np.flatnonzero(to >= 0)
            more = more[doc[to[more]] >= doc[more]]
            if not len(more):
                break
            via = to[more]
            low[more] = np.minimum(low[more], low[via])
            to[more] = np.where(low[more] < length, -1, to[via])
        return np.where(to >= 0, low, 0)

    before = one_side(documents, lcp)
    after = one_side(documents[::-1], np.append(lcp[1:], 0)[::-1])[::-1]
    return np.maximum(before, after)


def _send_suffixes(owners: int, length: int):
    def flush(box: Outbox, rng) -> pa.RecordBatch:
        ids, tags = box.all_rows()
        ref, key, place, windows = box.gathered()
        order, lcp = suffix_order(windows)
        ref, key, place = ref[order], key[order], place[order]
        late = longest_previous(ids[ref], lcp, length) >= length
        ask = np.flatnonzero(~late)
        ask = ask[np.argsort(key[ask], kind="stable")]
        short = place[ask].astype("<u2") if len(ask) and int(place[ask].max()) < 1 << 16 else place[ask]
        rows = list(_send(box, ids, tags, key[ask], ref[ask], short, key[:0]))
        rows += _told(box, ids, tags, (ref[late], ref[:0]), place[late], place[:0], rng)
        return _pack(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box, rng = Outbox(owners, 64), np.random.default_rng(3)
        for batch in unpacked(batches):
            part, row, at = _open_strings(batch, length)
            key = part.hashes(at, at + length)
            if len(at):
                windows = np.lib.stride_tricks.sliding_window_view(part.data, length)[at]
                box.add(part, row, key, (at - part.edges[row]).astype("<u4"), windows)
            if box.count > FLUSH // 3:
                yield flush(box, rng)
                box.clear()
        if box.count:
            yield flush(box, rng)
    return run


def _remove(length: int, as_text: bool):
    names = ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpacked(batches):
            part, row, first, last, _, value = _suspect_runs(batch, length)
            keep = _in_lists(value, row, batch.column(4))
            n = len(part.data)
            change = np.zeros(n + 1, np.int64)
            np.add.at(change, first[keep], 1)
            np.add.at(change, last[keep] + length, -1)
            for i, blobs in enumerate(batch.column(5).to_pylist()):
                for b in blobs or ():
                    at = np.frombuffer(b, "<u4").astype(np.int64) + part.edges[i]
                    np.add.at(change, at, 1)
                    np.add.at(change, at + length, -1)
            gone = np.cumsum(change[:-1]) > 0
            kept, removed, spans = [], [], []
            for a, b in zip(part.edges.tolist(), part.edges[1:].tolist()):
                own = gone[a:b]
                left = part.data[a:b][~own].tobytes()
                kept.append(left.decode("utf-8", "ignore") if as_text else left)
                removed.append(int(own.sum()))
                spans.append(int((own[1:] & ~own[:-1]).sum() + own[0]) if b > a else 0)
            yield pa.RecordBatch.from_arrays(
                [id_array(part.ids), pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(np.diff(part.edges)),
                 pa.array(removed, pa.int64()), pa.array(spans, pa.int64())], names=names)
    return run


def _exchange(rows: DataFrame, send, kind: str, owners: int) -> DataFrame:
    """(id, tag, covered, open): packed lists per document."""
    return (rows.mapInArrow(tidy(send(owners)), _MESSAGE).groupBy("owner").applyInArrow(_answers(kind, owners), _REPLY)
            .groupBy("target").applyInArrow(_unbundle(_wide(kind)), _TOLD))


def _pick(docs: DataFrame, chosen: DataFrame, how: str, broadcast_rows: int) -> DataFrame:
    """Rows of docs that are (left_semi) or are not (left_anti) chosen; ids move only while few."""
    few = chosen.count() <= broadcast_rows
    return docs.join(F.broadcast(chosen) if few else chosen, ["id", "tag"], how)


def _kept_in_place(rows: DataFrame, parts: int) -> DataFrame:
    """Rows dealt by (id, tag) and checkpointed so that later joins find them dealt and sorted.

    A checkpoint hands on the partitioning of a static plan; an adaptive plan does not tell its own.
    """
    conf = rows.sparkSession.conf
    before = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut_lineage(rows.repartition(parts, "id", "tag").sortWithinPartitions("id", "tag"))
    finally:
        conf.set("spark.sql.adaptive.enabled", before)


def remove_repeats(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
                   owner_entries: int = OWNER_ENTRIES,
                   broadcast_rows: int = BROADCAST_ROWS, as_text: bool = False) -> DataFrame:
    """See the module's text; `as_text` gives `kept` as a string, where a character cut in two goes whole."""
    if length < PIECE:
        raise ValueError(f"repeats under {PIECE} bytes are not searched")
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), text.alias("text"))
    prints = cut_lineage(docs.select("id", F.xxhash64("text").alias("one"), F.xxhash64(F.lit(1), "text").alias("two"),
                                     F.octet_length("text").cast("bigint").alias("n")))
    total = prints.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    owners = int(total // 16 // owner_entries) + 1
    # Rows are told apart by id alone, or by id and text where an id repeats.
    unique = prints.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").isEmpty()
    tag = F.lit(0).cast("bigint") if unique else F.xxhash64("text")
    docs = docs.select("id", tag.alias("tag"), "text")
    firsts = prints.filter(F.col("n") >= length).groupBy("one", "two", "n").agg(
        F.min("id").alias("first"), F.max("id").alias("most")).filter("first < most").drop("most")
    copies = cut_lineage(prints.join(firsts, ["one", "two", "n"]).filter("first < id").select(
        "id", (F.lit(0).cast("bigint") if unique else F.col("one")).alias("tag")).distinct())
    fresh = _pick(docs, copies, "left_anti", broadcast_rows)

    # Lists are dealt like the texts, so joining them leaves the texts where they are.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = _kept_in_place(fresh.mapInArrow(tidy(_compress), "id bigint, tag bigint, blob binary"), parts)
    suspects = _kept_in_place(_exchange(texts, partial(_send_minimizers, length=length), "minimizers", owners)
                              .select("id", "tag", F.col("covered").alias("keys")), parts)
    told = texts.join(suspects, ["id", "tag"])
    stretches = _kept_in_place(_exchange(told, partial(_send_stretches, length=length), "stretches", owners), parts)
    edges = stretches.filter(F.size("open") > 0).select("id", "tag", "open")
    places = cut_lineage(_exchange(told.join(edges, ["id", "tag"]), partial(_send_suffixes, length=length), "suffixes", owners)
                         .select("id", "tag", F.col("covered").alias("places")))
    found = texts.join(suspects, ["id", "tag"], "left").join(
        stretches.select("id", "tag", "covered"), ["id", "tag"], "left").join(places, ["id", "tag"], "left")

    schema = f"doc_id bigint, kept {'string' if as_text else 'binary'}, n_bytes bigint, n_removed bigint, n_spans bigint"
    cut = found.select("id", "tag", "blob", "keys", "covered", "places").mapInArrow(tidy(_remove(length, as_text)), schema)
    n = F.octet_length("text").cast("bigint")
    gone = _pick(docs, copies, "left_semi", broadcast_rows).select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), F.lit("" if as_text else b"").alias("kept"),
        n.alias("n_bytes"), n.alias("n_removed"), F.lit(1).cast("bigint").alias("n_spans"))
    return cut.unionByName(gone)
