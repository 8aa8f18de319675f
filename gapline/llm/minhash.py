"""Near duplicates by min-max hashing, confirmed on full shingle sets.

1. One pass hashes the distinct word shingles of each text and keeps, under each of PERMUTATIONS odd
   multipliers, both the smallest and the largest product. Each of the two matches between two sets with
   probability equal to their similarity, so a signature has two values per permutation. Seven
   values make a band, 36 bands a signature: two sets at the threshold 0.85 share no band once in a
   million pairs.
2. Texts with equal sets form a class first; only its smallest id goes on. A group of exact copies
   is one row from here.
3. Ids that share a band key are tied to the smallest of them (a star, not all pairs). Connected stars make
   candidate groups; every link lies inside one.
4. The full sets of a group meet in one task. An inverted index counts all intersections
   exactly, and a union-find keeps the components. A group with more than GROUP_SHINGLES shingles is
   dealt by band key instead, and a bucket still above that by pairs of blocks; those tasks give spanning
   links, which are connected in turn. Nothing is capped.

Result of `near_duplicates`, one row per input row: doc_id, n_shingles, component_id, kept. Texts without
words (null, empty, blanks) have an empty set, link with nothing and stay. Rows that repeat an id are
one document to links: their component is the smallest of both. A null id is the smallest. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.llm.common import NO_ID, Rolling, flat_bytes, give_back, ids_of, mix, narrow, slices, tidy
from gapline.operators.scale import cut_lineage

WORDS = 5
MISS = 1e-6               # chance that two sets just similar enough share no band, were its rows independent
MOST_ROWS, MOST_BANDS = 7, 48
GROUP_SHINGLES = 2_000_000        # of a group that one task compares: 16 MB
BROADCAST_ROWS = 1_000_000        # ids of suspects that may be broadcast: 16 MB

_rng = np.random.default_rng(20)
BYTE_NOISE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BYTE_NOISE[65:91] = BYTE_NOISE[97:123]            # A-Z count as a-z
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
PLACE = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MULTIPLIERS = _rng.integers(0, 1 << 63, MOST_ROWS * 200, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows of each) that miss a pair of this similarity with a chance of MISS: as many rows as leave at most
    MOST_BANDS bands. 85 gives 36 bands of 7, 80 gives 46 of 6."""
    for rows in range(MOST_ROWS, 0, -1):
        bands = int(np.ceil(np.log(MISS) / np.log1p(-(min(percent, 99.9) / 100) ** rows)))
        if bands <= MOST_BANDS or rows == 1:
            return min(bands + (bands * rows) % 2, 200), rows
    raise AssertionError


def shingle_sets(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted inside each text, and the n + 1 edges of the texts."""
    data, edges = flat_bytes(column)
    n = len(edges) - 1
    blank = BLANK[data]
    start, end = ~blank, ~blank
    first = np.zeros(len(data) + 1, bool)
    first[edges] = True
    start[1:] &= blank[:-1] | first[1:-1]
    end[:-1] &= blank[1:] | first[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    word = Rolling(data, BYTE_NOISE).hashes(starts, ends)
    of = np.searchsorted(edges, starts, "right") - 1
    count = np.bincount(of, minlength=n)
    at = np.cumsum(count) - count
    doc = of[:len(of) - words + 1] if len(of) >= words else of[:0]
    h = np.zeros(len(doc), np.uint64)
    for k in range(words if len(doc) else 0):
        h += word[k:len(word) - words + 1 + k] * PLACE[k]
    whole = doc == of[words - 1:] if len(doc) else np.zeros(0, bool)
    h, doc = mix(h[whole]), doc[whole]
    short = np.flatnonzero((count > 0) & (count < words))     # the whole sequence as one shingle
    if len(short):
        g = count[short].astype(np.uint64) * PLACE[words]
        for k in range(words - 1):
            has = count[short] > k
            g[has] += word[at[short[has]] + k] * PLACE[words + 1 + k]
        h, doc = np.append(h, mix(g)), np.append(doc, short)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.append(0, np.cumsum(np.bincount(doc, minlength=n)))


def signatures(h: np.ndarray, edges: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys (texts x bands) of texts that all have shingles."""
    n, used = len(edges) - 1, -(-bands * rows // 2)
    values = np.empty((2 * used, n), np.uint64)
    for p, a in enumerate(MULTIPLIERS[:used]):
        product = h * a
        values[2 * p] = np.minimum.reduceat(product, edges[:-1])
        values[2 * p + 1] = np.maximum.reduceat(product, edges[:-1])
    keys = np.empty((n, bands), np.uint64)
    for b in range(bands):
        key = np.full(n, b + 1, np.uint64) * PLACE[40]
        for r in range(rows):
            key += mix(values[b * rows + r]) * PLACE[41 + r]
        keys[:, b] = mix(key)
    return keys


def _sketch(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, size=1 << 19):
            h, edges = shingle_sets(part.column(1), words)
            size = np.diff(edges)
            full = np.flatnonzero(size)
            print_ = np.zeros((len(size), 2), np.uint64)
            ends = np.zeros(len(size) + 1, np.int64)
            keys = np.zeros((0, bands), np.uint64)
            if len(full):
                keys = signatures(h, np.append(edges[:-1][full], edges[-1]), bands, rows)
                for side in range(2):
                    print_[full, side] = np.add.reduceat(mix(h * PLACE[50 + side]), edges[:-1][full])
                ends[full + 1] = bands
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids_of(part)), pa.array(size), pa.array(print_[:, 0].view(np.int64)),
                 pa.array(print_[:, 1].view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(np.cumsum(ends).astype(np.int32)),
                                          pa.array(keys.ravel().view(np.int64)))],
                names=["id", "n", "f1", "f2", "bands"])
    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, size=1 << 19):
            h, edges = shingle_sets(part.column(1), words)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids_of(part)),
                 pa.array([h[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())],
                names=["id", "shingles"])
    return run


def connected(edges: DataFrame) -> DataFrame:
    """(id, root) for the ends of edges (a, b): root is the smallest id that can be reached.

    Large-star and small-star rounds: every node ties its larger neighbours, then itself and
    its smaller ones, to the smallest node it knows, until nothing changes.
    """
    edges = cut_lineage(edges.filter("a <> b").distinct())
    state = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a and b <> m").select(F.col("b").alias("u"), F.col("m").alias("v"))
        # Now every edge (u, v) has v < u.
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(small, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            small.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()
        edges = cut_lineage(tied)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())
        if now == state:
            break
        state = now
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("id"), "root")
    return roots.union(roots.select(F.col("root").alias("id"), "root").distinct())


def links_of(sets: list[np.ndarray], sides: np.ndarray | None, percent: int) -> np.ndarray:
    """The root (position) of every set, linked sets being joined. All intersections are counted.

    With `sides`, only sets of different sides are compared, or all where one side is given.
    """
    root = np.arange(len(sets))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, index, df = np.unique(flat, return_inverse=True, return_counts=True)
    shared = df[index] > 1
    index, owner = index[shared], owner[shared]
    by_value = owner[np.argsort(index, kind="stable")]        # postings, ascending owners
    end = np.cumsum(np.bincount(index, minlength=len(values)))
    begin = np.append(0, end[:-1])
    at = np.append(0, np.cumsum(np.bincount(owner, minlength=len(sets))))
    for x in range(1, len(sets)):
        own = index[at[x]:at[x + 1]]
        if 100 * len(own) < percent * sizes[x]:               # too many shingles of its own
            continue
        lengths = end[own] - begin[own]
        total = int(lengths.sum())
        before = np.cumsum(lengths) - lengths
        posts = by_value[np.repeat(begin[own] - before, lengths) + np.arange(total)]
        both = np.bincount(posts[posts < x], minlength=x)
        hits = np.flatnonzero(100 * both >= percent * (sizes[x] + sizes[:x] - both))
        if sides is not None:
            hits = hits[sides[hits] != sides[x]]
        for y in hits.tolist():
            a, b = find(x), find(y)
            root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(len(sets))], np.int64)


def _confirm(percent: int):
    """Links inside every unit of a group, as (member, smallest member) rows."""
    def run(group: pa.Table) -> pa.Table:
        unit = group.column("unit").to_numpy()
        side = group.column("side").to_numpy()
        ids = group.column("id").to_numpy()
        order = np.lexsort((ids, unit))
        sets = group.column("shingles").combine_chunks()
        a, b = [], []
        for rows in np.split(order, np.flatnonzero(np.diff(unit[order])) + 1):
            if len(rows) < 2:
                continue
            own = [np.frombuffer(sets[int(r)].as_py(), np.uint64) for r in rows]
            sides = side[rows] if len(set(side[rows].tolist())) > 1 else None
            root = links_of(own, sides, percent)
            moved = np.flatnonzero(root != np.arange(len(rows)))
            a.append(ids[rows[moved]])
            b.append(ids[rows[root[moved]]])
        empty, sets = [np.zeros(0, np.int64)], None
        give_back()
        return pa.table({"a": np.concatenate(a or empty), "b": np.concatenate(b or empty)})
    return run


def _units(rows: DataFrame, unit: list[str], limit: int) -> DataFrame:
    """Deal rows (unit columns, id, n) to tasks: (task, unit, side, id).

    A unit above the limit is cut into blocks by id; every pair of blocks is a unit of its own.
    """
    weights = rows.groupBy(*unit).agg(F.sum("n").alias("w"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("w") / limit)).cast("int")
    sized = rows.join(weights.select(*unit, blocks.alias("k")), unit)
    own = F.pmod(F.xxhash64("id"), F.col("k")).cast("int")
    partner = F.when(F.col("k") == 1, F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), F.col("k") - 1))
    dealt = sized.withColumn("own", own).select(*unit, "id", "n", "own", F.explode(partner).alias("other"))
    name = F.xxhash64(*unit, F.least("own", "other"), F.greatest("own", "other"))
    return dealt.select(name.alias("unit"), F.col("own").alias("side"), "id", "n")


def near_duplicates(df: DataFrame, percent: int = 85, words: int = WORDS, id_col: str = "doc_id",
                    text_col: str = "text", group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    docs = narrow(df, id_col, text_col)
    sketch = cut_lineage(docs.mapInArrow(
        tidy(_sketch(words, *banding(percent))), "id bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>"))
    classes = cut_lineage(sketch.filter("n > 0").groupBy("f1", "f2", "n").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    reps = sketch.join(classes.select("rep", "f1", "f2", "n"), ["f1", "f2", "n"]).filter("id = rep") \
        .select("id", "n", F.explode("bands").alias("key"))
    buckets = reps.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")) \
        .filter("least < most").select("key", "least")
    tied = cut_lineage(reps.join(buckets, "key").select("key", "least", "id", "n"))
    groups = connected(tied.select(F.col("least").alias("a"), F.col("id").alias("b")))
    members = cut_lineage(groups.join(classes.select(F.col("rep").alias("id"), "n"), "id")
                          .groupBy("id", "root").agg(F.max("n").alias("n")))
    heavy = members.groupBy("root").agg(F.sum("n").alias("w")).filter(F.col("w") > group_shingles)
    light = members.join(heavy.select("root"), "root", "left_anti")
    hot = members.join(heavy.select("root"), "root", "left_semi")
    hot_buckets = tied.select("key", "id", "n").distinct().join(hot.select("id"), "id", "left_semi")
    dealt = _units(light.select("root", "id", "n"), ["root"], group_shingles).unionByName(
        _units(hot_buckets, ["key"], group_shingles // 2))
    suspects, weight = members.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    tasks = max(int(weight) // (group_shingles // 4), 1) + 7
    chosen = members.select(F.col("id").alias("suspect"))
    few = suspects <= BROADCAST_ROWS
    sets = docs.join(F.broadcast(chosen) if few else chosen,
                     F.coalesce("doc_id", F.lit(NO_ID)) == F.col("suspect"), "left_semi").mapInArrow(
        tidy(_sets(words)), "id bigint, shingles binary")
    placed = dealt.select(F.pmod("unit", F.lit(tasks)).alias("task"), "unit", "side", "id")
    links = cut_lineage(sets.join(placed, "id").groupBy("task").applyInArrow(
        _confirm(percent), "a bigint, b bigint"))
    roots = connected(links)
    final = classes.join(roots.groupBy("id").agg(F.min("root").alias("root")),
                         F.col("rep") == F.col("id"), "left").filter(
        "copies > 1 or root is not null").select(
        "f1", "f2", F.col("n").alias("m"), F.coalesce("root", "rep").alias("component"))
    same = [sketch[c] == final[d] for c, d in (("f1", "f1"), ("f2", "f2"), ("n", "m"))]
    own = F.coalesce("component", "id")
    shown = lambda c: F.when(c != NO_ID, c)
    return sketch.join(final, same, "left").select(
        shown(F.col("id")).alias("doc_id"), sketch["n"].alias("n_shingles"),
        shown(own).alias("component_id"), (F.col("id") == own).alias("kept"))
