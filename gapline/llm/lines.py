"""Line dedup by a sharded minimal perfect hash over line hashes.

1. Each task counts the documents of every distinct line key it sees, so a line that stands in a
   third of all documents is one row per task. The counts of a key meet under its 128-bit hash.
2. Hashes found in `min_docs` documents are dealt into shards. Each shard becomes a minimal
   perfect hash (bit arrays by level, with ranks) that indexes a fingerprint and a count array. The
   fingerprint is the other half of the hash, 64 bits, so that a line that is not indexed cannot
   pass for one that is.
3. Documents probe the arrays; lines are never joined. While the whole index is under
   `index_bytes`, checked before it moves, every task holds it. A larger index stays in its
   shards: tasks send each shard one packed list of hashes, and the line numbers found come back.

Result, one row per input row: doc_id, kept_text, n_lines, n_dropped. Null or empty text is one
empty line; empty lines are never dropped. Repeated rows count as documents of their own. Keys
differ only by ASCII case and by ASCII blanks at the ends. An empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from gapline.llm.common import id_array, ids_of, mix, narrow, slices
from gapline.operators.scale import cut_lineage

BLANKS = b" \t\n\x0b\x0c\r"
KEYS_PER_SHARD = 100_000
INDEX_BYTES = 64 << 20            # of an index that every task may hold
KEY_BYTES = 13                    # index bytes per key, about
COUNTED_KEYS = 200_000            # keys counted in a task before they are passed on
ROOM = 2                          # bits of a level per key that is still without a place
MAX_LEVELS = 64

_FLUSH = "h1 bigint, h2 bigint, n bigint"
_RESULT = "doc_id bigint, kept_text string, n_lines bigint, n_dropped bigint"
_PROBE = "shard bigint, ids binary, texts binary, at binary, h1 binary, h2 binary"


def line_key(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()


def hashes_of(keys: list[bytes]) -> np.ndarray:
    """Two unsigned 64-bit halves per key."""
    raw = b"".join(map(xxhash.xxh3_128_digest, keys))
    return np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def flush():
        h = np.frombuffer(b"".join(counts), ">u8").astype(np.uint64).view(np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(list(counts.values()), pa.int64())],
            names=["h1", "h2", "n"])

    for part in slices(batches):
        for text in part.column(1).cast(pa.binary()).to_pylist():
            keys = set(map(line_key, text.split(b"\n")))
            keys.discard(b"")
            counts.update(map(xxhash.xxh3_128_digest, keys))
        if len(counts) > COUNTED_KEYS:
            yield flush()
            counts.clear()
    if counts:
        yield flush()


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys, built level by level.

    A key takes its bit on the first level where no other key wants it; its number is the rank of
    that bit. Keys left after MAX_LEVELS levels (never seen) would stop the build.
    """

    def __init__(self, keys: np.ndarray):
        self.levels: list[np.ndarray] = []
        left = keys
        while len(left):
            if len(self.levels) == MAX_LEVELS:
                raise ValueError("keys of a perfect hash must be distinct")
            size = max(64, (ROOM * len(left) + 63) // 64 * 64)
            at = self._place(left, len(self.levels), size)
            wanted = np.bincount(at, minlength=size)
            self.levels.append(np.packbits(wanted == 1, bitorder="little").view("<u8"))
            left = left[wanted[at] > 1]
        ones = np.concatenate([np.bitwise_count(x) for x in self.levels] or [np.zeros(0, np.uint8)])
        self.ranks = np.append(0, np.cumsum(ones, dtype=np.int64)).astype(np.uint32)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64)))
                % np.uint64(size)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; any number or -1 for a key that is not in the set."""
        out = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for level, words in enumerate(self.levels):
            at = self._place(keys[left], level, len(words) * 64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (self.ranks[base + (at >> 6)].astype(np.int64)
                              + np.bitwise_count(below).astype(np.int64))[hit]
            left = left[~hit]
            base += len(words)
        return out


class Shard:
    """Perfect hash, fingerprints and document counts of one shard."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray):
        self.hash = PerfectHash(h1)
        at = self.hash.find(h1)
        self.fingerprints = np.empty(len(h1), np.uint64)
        self.counts = np.empty(len(h1), np.int64)
        self.fingerprints[at], self.counts[at] = h2, counts

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Documents that hold each line, 0 where the line is not indexed."""
        if not len(self.fingerprints):
            return np.zeros(len(h1), np.int64)
        at = self.hash.find(h1)
        return np.where((at >= 0) & (self.fingerprints[at] == h2), self.counts[at], 0)


def shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    return ((h1 >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def _build(group: pa.Table) -> pa.Table:
    h1, h2, n = (group.column(c).to_numpy().view(np.uint64) if c != "n" else group.column(c).to_numpy()
                 for c in ("h1", "h2", "n"))
    # Two keys with one h1 cannot share a perfect hash: the later ones go to further layers.
    shards, left = [], np.arange(len(h1))
    while len(left):
        _, first = np.unique(h1[left], return_index=True)
        now = left[first]
        shards.append(Shard(h1[now], h2[now], n[now]))
        left = np.setdiff1d(left, now)
    return pa.table([group.column("shard")[:1], pa.array([pickle.dumps(shards)], pa.binary())],
                    names=["shard", "index"])


def probe_all(shards: list[Shard], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h1), np.int64)
    for s in shards:
        out = np.maximum(out, s.probe(h1, h2))
    return out


def line_counts(docs: DataFrame) -> DataFrame:
    """(h1, h2, n): documents per distinct line key, by its 128-bit hash."""
    return docs.mapInArrow(_count, _FLUSH).groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def build_index(docs: DataFrame, min_docs: int,
                keys_per_shard: int = KEYS_PER_SHARD) -> tuple[DataFrame, int, int]:
    """(shard, index) rows, the number of shards, and the number of keys."""
    frequent = cut_lineage(line_counts(docs).filter(F.col("n") >= min_docs))
    keys = frequent.count()
    shards = keys // keys_per_shard + 1
    shard = F.expr(f"cast(shiftrightunsigned(h1, 32) % {shards} as bigint)").alias("shard")
    return (frequent.select(shard, "*").groupBy("shard")
            .applyInArrow(_build, "shard bigint, index binary"), shards, keys)


def _keep(text: bytes, lines: list[bytes], hits: set[int]) -> bytes:
    return b"\n".join(x for i, x in enumerate(lines) if i not in hits) if hits else text


def _rows(part: pa.RecordBatch, texts: list[bytes], hits: dict[int, set[int]]) -> pa.RecordBatch:
    kept, total, dropped = [], [], []
    for i, text in enumerate(texts):
        lines = text.split(b"\n")
        gone = hits.get(i, set())
        kept.append(_keep(text, lines, gone))
        total.append(len(lines))
        dropped.append(len(gone))
    return pa.RecordBatch.from_arrays(
        [part.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()),
         pa.array(dropped, pa.int64())], names=["doc_id", "kept_text", "n_lines", "n_dropped"])


def _lines_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, line number and hashes of all lines that have a key."""
    rows, at, keys = [], [], []
    for i, text in enumerate(texts):
        for j, line in enumerate(text.split(b"\n")):
            if key := line_key(line):
                rows.append(i)
                at.append(j)
                keys.append(key)
    return np.array(rows, np.int64), np.array(at, np.int64), hashes_of(keys)


def _probe_held(index, shards: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: pickle.loads(v) for k, v in index.value}
        for part in slices(batches):
            texts = part.column(1).cast(pa.binary()).to_pylist()
            rows, at, h = _lines_of(texts)
            of = shard_of(h[:, 0], shards)
            hits: dict[int, set[int]] = {}
            for s in np.unique(of).tolist():
                own = np.flatnonzero(of == s)
                if s in held:
                    own = own[probe_all(held[s], h[own, 0], h[own, 1]) >= limit]
                    for r, j in zip(rows[own].tolist(), at[own].tolist()):
                        hits.setdefault(r, set()).add(j)
            yield _rows(part, texts, hits)
    return run


def text_hash(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


@F.pandas_udf(LongType())
def _mark(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: text_hash(t.encode()))


def _probes(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = part.column(1).cast(pa.binary()).to_pylist()
            ids, marks = ids_of(part), np.array([text_hash(t) for t in texts], np.int64)
            rows, at, h = _lines_of(texts)
            of = shard_of(h[:, 0], shards)
            for s in np.unique(of).tolist():
                own = np.flatnonzero(of == s)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s]), *(pa.array([x.tobytes()], pa.binary()) for x in (
                        ids[rows[own]], marks[rows[own]], at[own], h[own, 0], h[own, 1]))],
                    names=["shard", "ids", "texts", "at", "h1", "h2"])
    return run


def _found(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts, at, h1, h2, index in zip(*(c.to_pylist() for c in batch.columns)):
                hit = probe_all(pickle.loads(index), np.frombuffer(h1, np.uint64),
                                np.frombuffer(h2, np.uint64)) >= limit
                ids, texts, at = (np.frombuffer(x, np.int64)[hit] for x in (ids, texts, at))
                yield pa.RecordBatch.from_arrays(
                    [id_array(ids), pa.array(texts), pa.array(at)], names=["id", "mark", "at"])
    return run


def _drop_found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        texts = part.column(1).cast(pa.binary()).to_pylist()
        hits = {i: set(x) for i, x in enumerate(part.column(2).to_pylist()) if x}
        yield _rows(part, texts, hits)


def drop_frequent_lines(df: DataFrame, min_docs: int = 10, id_col: str = "doc_id",
                        text_col: str = "text", index_bytes: int = INDEX_BYTES,
                        keys_per_shard: int = KEYS_PER_SHARD) -> DataFrame:
    docs = narrow(df, id_col, text_col)
    index, shards, keys = build_index(docs, min_docs, keys_per_shard)
    if keys * KEY_BYTES <= index_bytes:
        held = docs.sparkSession.sparkContext.broadcast(
            [(r["shard"], bytes(r["index"])) for r in index.collect()])
        return docs.mapInArrow(_probe_held(held, shards, min_docs), _RESULT)
    probes = docs.mapInArrow(_probes(shards), _PROBE)
    found = (probes.join(index, "shard").select("ids", "texts", "at", "h1", "h2", "index")
             .mapInArrow(_found(min_docs), "id bigint, mark bigint, at bigint")
             .groupBy("id", "mark").agg(F.collect_set("at").alias("at")))
    marked = docs.select("*", _mark(F.col("text")).alias("_mark"))
    return (marked.join(found, F.col("doc_id").eqNullSafe(F.col("id"))
                        & (F.col("_mark") == F.col("mark")), "left")
            .select("doc_id", "text", "at").mapInArrow(_drop_found, _RESULT))
