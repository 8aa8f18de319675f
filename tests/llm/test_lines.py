"""Line dedup: the perfect hash, both ways to probe, brute force and edge rows."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from gapline.llm import lines

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, limit):
    docs = Counter()
    for _, t in rows:
        docs.update({x.strip(BLANKS).translate(LOWER) for x in (t or "").split("\n")})
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if not (k := x.strip(BLANKS).translate(LOWER)) or docs[k] < limit]
        out.append((i, "\n".join(kept), len(parts), len(parts) - len(kept)))
    return sorted(out, key=str)


ROWS = [
    (1, "Same line\nown 1"), (2, "  same LINE\t\nown 2\nsame line"), (3, "SAME LINE"),
    (4, None), (5, ""), (6, "\n\n"), (7, "Éte\nète\n"), (8, "éte"), (9, "éte \r"),
    (9, "éte \r"), (None, "same line\nx"), (10, "y" * 200_000 + "\nsame line"),
]


@pytest.mark.parametrize("index_bytes", [1 << 20, 0])
@pytest.mark.parametrize("shard", [1, 100])
def test_both_ways_match_brute_force(spark, index_bytes, shard):
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in ROWS],
                               "doc_id bigint, text string, shard string, n int").repartition(3)
    got = lines.drop_frequent_lines(df, 3, index_bytes=index_bytes, keys_per_shard=shard).collect()
    assert sorted(map(tuple, got), key=str) == brute(ROWS, 3)
    assert lines.drop_frequent_lines(df.filter("n > 1"), 3, index_bytes=index_bytes).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64))
    h = lines.PerfectHash(keys)
    assert sorted(h.find(keys).tolist()) == list(range(len(keys)))
    assert sum(len(x) * 64 for x in h.levels) < 5 * len(keys)
    shard = lines.Shard(keys, keys[::-1].copy(), np.arange(1, len(keys) + 1))
    assert shard.probe(keys, keys[::-1]).tolist() == list(range(1, len(keys) + 1))
    assert not shard.probe(keys, keys + np.uint64(1)).any()


def test_keys_with_equal_first_halves_both_count():
    import pyarrow as pa
    group = pa.table({"shard": [0, 0, 0], "h1": [5, 5, 6], "h2": [1, 2, 3], "n": [10, 20, 30]})
    import pickle
    shards = pickle.loads(lines._build(group).column("index")[0].as_py())
    one = np.array([5, 5, 6, 5], np.uint64)
    assert lines.probe_all(shards, one, np.array([1, 2, 3, 4], np.uint64)).tolist() == [10, 20, 30, 0]


def test_large_table_keeps_other_lines(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: hashlib.sha256(r.kept_text.encode()).hexdigest()
           for r in lines.drop_frequent_lines(docs, 2, index_bytes=0).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t, _, _ in brute(rows, 2)}
