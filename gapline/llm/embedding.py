"""Document fingerprints by a randomised edit embedding.

All texts are walked with the same random bits: at step j the walk reads the character under it and moves on
or stays, as a bit that depends on j and the character says. A few edits shift a walk only until it meets
the other one again, so edit distance becomes Hamming distance between the strings of characters read. A
walk over n characters takes about 2n steps and counts as 3n, blank after its end.

A fingerprint holds the length and four bits of the character read at SAMPLES steps. The steps are those
with the smallest random priority below 3n, the same for all texts of one length, and of two lengths the
longer text's steps below the shorter's end are also the shorter's. So any two fingerprints can be compared
step by step; equal texts have equal ones.

Near texts have a likeness of at least `least`. Texts of equal fingerprints are one class. Classes meet in
buckets of equal characters at 8 sampled steps, BANDS times over, at the power of two below a walk's length and
at the one below where a near text may be that much shorter. All members of a bucket are verified against each
other, as arrays; larger ones than two times BLOCK_ROWS are dealt as pairs of blocks by a hash of their members.
So within a bucket nothing is lost; a pair of likeness 0.85 shares no bucket with a probability of about 0.004 if
steps were independent, one of 0.9 with 6e-5.

Null and empty texts have the fingerprint of length 0. Rows with one id count one after the other, in
order of their texts; a null id comes first. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType

from gapline.llm.common import NO_ID, character_noise, give_back, id_array, mix, narrow, slices
from gapline.operators.scale import cut_lineage

SAMPLES = 256
BLOCK = 256                       # steps between two looks at which walks have ended
CHUNK_BYTES = 8 << 20             # characters walked together in a task
BUCKET_BYTES = 8 << 20            # text of one range of ids, about
CHANCE = 1 / 16                   # of equal bits under unequal characters
BANDS, BAND_STEPS = 16, 8         # a key is the 8 bytes of its steps
KEY_STEPS = 48                    # steps of one level that keys are drawn from
BLOCK_ROWS = 1024                 # half of the members verified together
NEAR = 0.85

# near_id is there where a least likeness is given.
_ROW = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double")
DIGITS = np.frombuffer(b"0123456789abcdef-", np.uint8)


@lru_cache(maxsize=1)
def _noise() -> np.ndarray:
    """A random odd 32-bit number for every code point."""
    return (character_noise() >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


@lru_cache(maxsize=64)
def _ranked(bits: int) -> np.ndarray:
    """The steps below 2**bits with the smallest priorities, in order of priority."""
    u = mix(np.arange(1 << bits, dtype=np.uint64) + np.uint64(0xABCDEF12345))
    return np.argsort(u, kind="stable")[:8 * SAMPLES]


@lru_cache(maxsize=20_000)
def steps_of(n: int) -> np.ndarray:
    """The sampled steps of a text of n characters, in order of priority."""
    end = 3 * n
    if not end:
        return np.zeros(0, np.int64)
    ranked = _ranked(max(1, (end - 1).bit_length()))
    own = ranked[ranked < end][:SAMPLES]
    if len(own) < min(SAMPLES, end):      # more than half of the range lies below the end
        u = mix(np.arange(end, dtype=np.uint64) + np.uint64(0xABCDEF12345))
        own = np.argsort(u, kind="stable")[:SAMPLES]
    return own


@lru_cache(maxsize=4)
def _keys(blocks: int) -> np.ndarray:
    return (mix(np.arange(blocks * BLOCK, dtype=np.uint64) + np.uint64(77)) >> np.uint64(32)
            ).astype(np.uint32) | np.uint32(1)


def embed(texts: list[str]) -> list[str]:
    """Fingerprints. All walks go on together; a step costs a few array operations."""
    if not texts:
        return []
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths + 1) - 1
    points = np.zeros(int(ends[-1]) + 1, np.uint32)           # a walk stays at the 0 after its text
    for t, a, b in zip(texts, (ends - lengths).tolist(), ends.tolist()):
        if t:
            points[a:b] = _noise()[np.frombuffer(t.encode("utf-32-le"), np.uint32)]
    steps = [steps_of(int(n)) for n in lengths]
    who = np.repeat(np.arange(len(texts)), [len(s) for s in steps])
    when = np.concatenate(steps)
    order = np.argsort(when // BLOCK, kind="stable")
    edges = np.searchsorted((when // BLOCK)[order], np.arange(int(3 * lengths.max()) // BLOCK + 2))
    got = np.full(len(when), 16, np.uint8)
    active = np.flatnonzero(lengths)
    at = (ends - lengths)[active]
    column = np.full(len(texts), -1, np.int64)
    block = 0
    while len(active):
        seen = np.empty((BLOCK, len(active)), np.uint32)
        keys = _keys(1 << block.bit_length())[block * BLOCK:(block + 1) * BLOCK]
        for t in range(BLOCK):
            c = points[at]
            seen[t] = c
            c *= keys[t]
            c >>= 31
            at += c
        if block + 1 < len(edges):
            own = order[edges[block]:edges[block + 1]]
            column[:] = -1
            column[active] = np.arange(len(active))
            own = own[column[who[own]] >= 0]
            read = seen[when[own] - block * BLOCK, column[who[own]]]
            got[own] = np.where(read == 0, 16, (read * np.uint32(0x9E3779B1)) >> np.uint32(28))
        stay = points[at] != 0
        active, at = active[stay], at[stay]
        block += 1
    shown = DIGITS[got].tobytes().decode("ascii")
    starts = np.append(0, np.cumsum([len(s) for s in steps])).tolist()
    return [f"{n:08x}:{shown[a:b]}" for n, a, b in zip(lengths.tolist(), starts, starts[1:])]


def likeness(a: str, b: str) -> float:
    """Share of equal sampled characters, corrected for chance, 1 for equal texts."""
    if a == b:
        return 1.0
    (n, x), (m, y) = ((int(f[:8], 16), np.frombuffer(f[9:].encode("ascii"), np.uint8)) for f in (a, b))
    if n > m:
        (n, x), (m, y) = (m, y), (n, x)
    below = steps_of(m) < 3 * n           # the longer text's steps that the shorter has too
    k = int(below.sum())
    near = np.full(len(y), ord("-"), np.uint8)
    near[below] = x[:k]                   # both are in order of priority
    read = (near != ord("-")) | (y != ord("-"))
    if not read.any():
        return 0.0
    same = float(((near == y) & read).sum() / read.sum())
    return min(1.0, max(0.0, (same - CHANCE) / (1 - CHANCE)))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list = []
    texts: list[str] = []

    def done():
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
             pa.array(prints := embed(texts), pa.string()), pa.array(map(name_of, prints), pa.int64()),
             pa.array(_packed(prints), pa.binary())],
            names=["doc_id", "n_chars", "fingerprint", "name", "packed"])

    size = 0
    for batch in slices(batches):
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size > CHUNK_BYTES // 2:
                yield done()
                ids, texts, size = [], [], 0
    if ids:
        yield done()
    ids, texts = [], []
    give_back()


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint, name, packed) of every row, in one pass without a shuffle.

    `name` is the class; `packed` is the fingerprint in 164 bytes.
    """
    return narrow(df, id_col, text_col).mapInArrow(
        _fingerprints, "doc_id bigint, n_chars bigint, fingerprint string, name bigint, packed binary")


def name_of(fingerprint: str) -> int:
    """The 64-bit name of a class of equal fingerprints."""
    return int.from_bytes(hashlib.blake2b(fingerprint.encode(), digest_size=8).digest(), "little", signed=True)


def _level(n: int) -> int:
    """The largest power of two that a walk over n characters surely reaches."""
    return max(1, int(1.9 * n)).bit_length() - 1


@lru_cache(maxsize=64)
def _bands(steps: int) -> np.ndarray:
    """Places of the steps of each band among the first `steps` of a level; one band of all if they are few."""
    if steps <= BAND_STEPS:
        return np.append(np.arange(steps), np.full(BAND_STEPS - steps, KEY_STEPS))[None]
    drawn = np.random.default_rng(steps)
    return np.array([np.sort(drawn.permutation(steps)[:BAND_STEPS]) for _ in range(BANDS)])


@lru_cache(maxsize=20_000)
def _places(n: int, bits: int) -> np.ndarray:
    return np.flatnonzero(steps_of(n) < 1 << bits)[:KEY_STEPS]


def band_keys(fingerprint: str, least: float = NEAR) -> list[int]:
    """Bucket keys of one fingerprint, at every level it may share with a text of likeness `least`."""
    n, shown = int(fingerprint[:8], 16), np.frombuffer(fingerprint[9:].encode("ascii"), np.uint8)
    out = []
    for bits in range(_level(int(max(0.0, least - 0.12) * n)), _level(n) + 1) if n else ():
        steps, places = min(KEY_STEPS, 1 << bits), _places(n, bits)
        read = np.full(KEY_STEPS + 1, ord("."), np.uint8)
        read[:len(places)] = shown[places]
        bands = _bands(steps)
        whole = ((bands < len(places)) | (bands == KEY_STEPS)).all(1)
        seeds = mix(np.arange(len(bands), dtype=np.uint64) + np.uint64(1 + (bits << 8)))
        keys = mix(np.ascontiguousarray(read[bands]).view(np.uint64)[:, 0] ^ seeds)
        out += keys[whole].view(np.int64).tolist()
    return out


def _digits(prints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and the read characters as rows of SAMPLES digits, 16 where nothing was read."""
    lengths = np.array([int(f[:8], 16) for f in prints], np.int64)
    shown = np.frombuffer("".join(f[9:].ljust(SAMPLES, "-") for f in prints).encode("ascii"), np.uint8)
    place = np.full(256, 16, np.uint8)
    place[DIGITS] = np.arange(17)
    return lengths, place[shown].reshape(len(prints), SAMPLES)


def _packed(prints: list[str]) -> list[bytes]:
    """Length, four bits a step, and a bit for each step where nothing was read."""
    lengths, shown = _digits(prints)
    blank = shown == 16
    half = np.where(blank, 0, shown)
    rows = np.concatenate([lengths.astype("<u4").view(np.uint8).reshape(-1, 4), half[:, ::2] << 4 | half[:, 1::2],
                           np.packbits(blank, axis=1)], axis=1)
    return [r.tobytes() for r in rows]


def _unpacked(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """What `_digits` gives, from packed fingerprints."""
    rows = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), 4 + SAMPLES * 5 // 8)
    lengths = np.ascontiguousarray(rows[:, :4]).view("<u4")[:, 0].astype(np.int64)
    half, blank = rows[:, 4:4 + SAMPLES // 2], np.unpackbits(rows[:, 4 + SAMPLES // 2:], axis=1)
    shown = np.stack([half >> 4, half & 15], axis=2).reshape(len(blobs), SAMPLES)
    return lengths, np.where(blank == 1, np.uint8(16), shown)


def _texts_of(blobs: list[bytes]) -> list[str]:
    """Packed fingerprints as texts."""
    lengths, shown = _unpacked(blobs)
    return [f"{n:08x}:{DIGITS[row[:len(steps_of(n))]].tobytes().decode('ascii')}"
            for n, row in zip(lengths.tolist(), shown)]


def likenesses(n: int, shown: np.ndarray, lengths: np.ndarray, others: np.ndarray, least: float) -> np.ndarray:
    """Likeness of one fingerprint to those of texts no longer than it; 0 where it surely is below `least`."""
    steps = steps_of(n)
    shown, out = shown[:len(steps)], np.zeros(len(lengths))
    read = int((shown != 16).sum())
    if not read:
        out[lengths == n] = 1.0
        return out
    ordered = np.sort(steps)
    common = np.searchsorted(ordered, 3 * lengths)            # steps that the shorter text has too
    maybe = np.flatnonzero((common / read - CHANCE) / (1 - CHANCE) >= least)
    if not len(maybe):
        return out
    below = steps[None, :] < 3 * lengths[maybe, None]
    place = np.cumsum(below, axis=1) - 1                      # both are in order of priority
    near = np.where(below, np.take_along_axis(others[maybe], np.maximum(place, 0), axis=1), 16)
    seen = (near != 16) | (shown != 16)[None, :]
    same = ((near == shown[None, :]) & seen).sum(axis=1) / seen.sum(axis=1)
    out[maybe] = np.clip((same - CHANCE) / (1 - CHANCE), 0.0, 1.0)
    equal = (lengths[maybe] == n) & (others[maybe][:, :len(steps)] == shown[None, :]).all(axis=1)
    out[maybe[equal]] = 1.0
    return out


def _verify(least: float):
    """Per unit, the smallest id that each member is near to, where there is a smaller one."""
    def run(unit: pd.DataFrame) -> pd.DataFrame:
        lengths, shown = _unpacked(unit["packed"].tolist())
        order = np.lexsort((unit["id"].to_numpy(), lengths))
        ids, names = unit["id"].to_numpy()[order], unit["name"].to_numpy()[order]
        lengths, shown = lengths[order], shown[order]
        best, close = ids.copy(), np.ones(len(ids))
        for i in range(1, len(ids)):                          # each as the longer one of its pairs
            like = likenesses(int(lengths[i]), shown[i], lengths[:i], shown[:i], least)
            for k in np.flatnonzero(like >= least).tolist():
                late, early = (i, k) if ids[i] > ids[k] else (k, i)
                if ids[early] < best[late]:
                    best[late], close[late] = ids[early], like[k]
        found = np.flatnonzero(best < ids)
        return pd.DataFrame({"linked": names[found], "near_id": best[found], "likeness": close[found]})
    return run


def _buckets(most: int):
    """Rows sorted by key to one row per key of several classes: their packed names and a name for the set.

    A key of more than `most` classes gives its size only; no more than `most` names are held.
    """
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("unit", pa.int64()), ("names", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, held = None, 0, []

        def done() -> list:
            if n < 2:
                return []
            if n > most:
                return [(now, n, None, None)]
            names = np.unique(np.concatenate(held)).tobytes()
            unit = int.from_bytes(hashlib.blake2b(names, digest_size=8).digest(), "little", signed=True)
            return [(now, n, unit, names)]

        for batch in batches:
            classes, keys = (batch.column(i).to_numpy() for i in range(2))
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)] if len(keys) else [0]
            rows = []
            for a, b in zip(edges, edges[1:]):
                if keys[a] != now:
                    rows += done()
                    now, n, held = int(keys[a]), 0, []
                n += b - a
                if n <= most:
                    held.append(classes[a:b])
                else:
                    held = []
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(
                zip(*rows) if rows else [[]] * 4, schema)], schema=schema)
        last = done()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(
            zip(*last) if last else [[]] * 4, schema)], schema=schema)
    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [np.frombuffer(b, np.int64) for b in batch.column(3).to_pylist()]
        sizes = np.array([len(x) for x in names], np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(batch.column(2).to_numpy(), sizes)), pa.array(np.concatenate([*names, np.zeros(0, np.int64)]))],
            names=["unit", "member"])


def near_links(prints: DataFrame, least: float = NEAR) -> DataFrame:
    """(doc_id, near_id, likeness, name): the smallest id near to a text, where it is smaller than its own.

    `prints` has doc_id, name and packed.
    """
    keys = F.pandas_udf(lambda s: pd.Series([band_keys(f, least) for f in _texts_of(s.tolist())], dtype=object),
                        ArrayType(LongType()))
    first = F.min(F.struct("doc_id", "packed")).alias("first")
    classes = cut_lineage(prints.groupBy(F.col("name").alias("class")).agg(first).select(
        "class", F.col("first.doc_id").alias("own"), "first.packed"))
    spread = classes.select("class", F.explode(keys("packed")).alias("key"))
    buckets = cut_lineage(spread.repartition("key").sortWithinPartitions("key").mapInArrow(
        _buckets(2 * BLOCK_ROWS), "key bigint, n bigint, unit bigint, names binary"))
    small = buckets.filter("unit is not null").dropDuplicates(["unit"])                # bands often agree
    members = small.mapInArrow(_members, "unit bigint, member bigint")
    large = buckets.filter("unit is null").select("key", "n")
    if not large.isEmpty():
        # Of a larger bucket every pair of blocks is a unit; a block holds the members of one share of the hash range.
        blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
        own = F.pmod(F.xxhash64("class"), blocks).cast("int")
        pairs = spread.join(large, "key").withColumn("own", own).withColumn(
            "other", F.explode(F.filter(F.sequence(F.lit(0), blocks - 1), lambda b: b != F.col("own"))))
        members = members.unionByName(pairs.select(
            F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("unit"),
            F.col("class").alias("member")))
    found = members.join(classes, F.col("member") == F.col("class")).select(
        "unit", F.col("own").alias("id"), F.col("member").alias("name"), "packed"
    ).groupBy("unit").applyInPandas(_verify(least), "linked bigint, near_id bigint, likeness double")
    best = found.groupBy("linked").agg(F.min_by("likeness", "near_id").alias("likeness"),
                                       F.min("near_id").alias("near_id"))
    told = classes.select("class", "own").join(best, F.col("class") == F.col("linked"), "left")
    own, least_id = F.col("own"), F.least("own", "near_id")
    return prints.select("doc_id", "name").join(told, F.col("name") == F.col("class")).filter(
        least_id < F.col("doc_id")).select(
        "doc_id", F.nullif(least_id, F.lit(NO_ID)).alias("near_id"),
        F.when(F.col("near_id") < own, F.col("likeness")).otherwise(1.0).alias("likeness"), "name")


def _rows(ids: list[int], texts: list[str], real: int, near: dict | None) -> pa.RecordBatch:
    """Result rows of the first `real` texts; each is followed by its next document."""
    n = [len(t) for t in texts]
    edited = [t[:len(t) - len(t) // 4] + u[:len(t) // 4] for t, u in zip(texts[:real], texts[1:])]
    prints = embed(texts + edited)
    own, other = prints[:len(texts)], prints[len(texts):]
    names = [c.split()[0] for c in _ROW.split(", ")]
    columns = [
        id_array(ids[:real]), pa.array(n[:real], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        pa.array(own[:real], pa.string()), pa.array(other, pa.string()),
        pa.array([likeness(a, b) for a, b in zip(own, other)], pa.float64()),
        pa.array([likeness(a, b) for a, b in zip(own[:real], own[1:])], pa.float64())]
    if near is not None:
        names.append("near_id")
        columns.append(id_array([near.get((i, name_of(f)), i) for i, f in zip(ids[:real], own)]))
    return pa.RecordBatch.from_arrays(columns, names=names)


def _walk_ranges(batches: Iterator[pa.RecordBatch], linked: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows arrive by (bucket, tail, id, text); tails are the first documents of the next range.

    Where `linked`, rows without a text come before the texts of their id, with a class and its near id.
    """
    ids: list[int] = []
    texts: list[str] = []
    now, size, tail, near = None, 0, False, {} if linked else None
    for batch in slices(batches):
        more = [c.to_pylist() for c in batch.columns[4:]] or [[None] * batch.num_rows] * 2
        for bucket, is_tail, i, t, name, near_id in zip(*(c.to_pylist() for c in batch.columns[:4]), *more):
            if bucket != now:
                if now is not None and not tail and ids:
                    yield _rows(ids, texts + texts[:1], len(ids), near)
                ids, texts, now, size, tail = [], [], bucket, 0, False
                near = {} if linked else None
            if tail:
                continue
            if t is None:
                near[i, name] = near_id
                continue
            if is_tail:
                tail = True
                if ids:
                    yield _rows(ids, [*texts, t], len(ids), near)
                continue
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size > CHUNK_BYTES and len(ids) > 1:           # the last row waits for its next
                yield _rows(ids[:-1], texts, len(ids) - 1, near)
                ids, texts, size = ids[-1:], texts[-1:], len(t)
                if linked:
                    near = {k: v for k, v in near.items() if k[0] == i}
    if not tail and ids:
        yield _rows(ids, texts + texts[:1], len(ids), near)
    ids, texts = [], []
    give_back()


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        bucket_bytes: int = BUCKET_BYTES, least: float | None = None) -> DataFrame:
    """Fingerprints of every text, of its edited form, and their likeness; see the module's rows.

    With `least` a row also has near_id: the smallest id among its own and those of near texts.

    Edited: the last quarter of the characters replaced by the start of the next document in order of ids
    (after the last comes the first). Texts move once, into ranges of ids; the first document of a range
    is copied to the end of the range before it. The driver holds one id per range.
    """
    docs = narrow(df, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    rows, size, smallest = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text").cast("bigint")),
                                 F.min("doc_id")).first()
    buckets = int((size or 0) // bucket_bytes) + 1
    cuts = np.zeros(0, np.int64)
    if buckets > 1:
        shares = [k / buckets for k in range(1, buckets)]
        cuts = np.unique(np.array(docs.agg(F.percentile_approx(
            "doc_id", shares, 20 * buckets)).first()[0], np.int64))
        cuts = cuts[cuts > smallest]
    last = len(cuts)

    def place(ids: pd.Series) -> pd.Series:
        x = ids.to_numpy()
        own = np.searchsorted(cuts, x, "right")
        first = (own > 0) & (x == (cuts[np.maximum(own, 1) - 1] if last else x))
        # Own range as it is, a range that gets the row as its tail as -1 - range.
        return pd.Series([[o, *([-o] if f else []), *([-1 - last] if i == smallest else [])]
                          for o, f, i in zip(own.tolist(), first.tolist(), x.tolist())])

    spots = F.pandas_udf(place, ArrayType(IntegerType()))
    dealt = docs.select("*", F.explode(spots("doc_id")).alias("spot")).select(
        F.when(F.col("spot") < 0, -1 - F.col("spot")).otherwise(F.col("spot")).alias("bucket"),
        (F.col("spot") < 0).alias("tail"), "doc_id", "text")
    if least is not None:
        links = near_links(cut_lineage(fingerprints(docs).select("doc_id", "name", "packed")), least)
        told = links.select(F.element_at(spots("doc_id"), 1).alias("bucket"), F.lit(False).alias("tail"), "doc_id",
                            F.lit(None).cast("string").alias("text"), "name",
                            F.coalesce("near_id", F.lit(NO_ID)).alias("near_id")).distinct()
        none = F.lit(None).cast("bigint")
        dealt = dealt.withColumns({"name": none, "near_id": none}).unionByName(told)
    return (dealt.repartition(max(1, buckets), "bucket")
            .sortWithinPartitions("bucket", "tail", "doc_id", "text")
            .mapInArrow(lambda rows: _walk_ranges(rows, least is not None),
                        _ROW if least is None else _ROW + ", near_id bigint"))
