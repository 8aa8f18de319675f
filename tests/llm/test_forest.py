"""Hash-prefix forest: equals brute force where it goes up to all rows, recall and exact scores elsewhere."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapline.llm import forest
from gapline.llm.vectors import Block

SCHEMA = "vec_id bigint, embedding array<double>, label int, query_id int, score string"


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))


def taking_part(rows):
    kept = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            seen = (len(v), np.asarray(v, np.float64).tobytes())
            kept[i] = min(kept.get(i, seen), seen)
    return {i: np.frombuffer(b).tolist() for i, (_, b) in kept.items()}


def searched(spark, rows, **settings):
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA).repartition(4)
    out = forest.nearest(df, F.col("vec_id") % 5 == 0, **settings).collect()
    found = {}
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(found[r.query_id])
    return found


def same_as_brute(found, rows, k=5):
    kept = taking_part(rows)
    queries = [i for i in kept if i % 5 == 0 and any(len(kept[j]) == len(kept[i]) for j in kept if j != i)]
    assert sorted(found) == sorted(queries)
    for q in queries:
        want = sorted((-cosine(kept[q], v), i) for i, v in kept.items() if i != q and len(v) == len(kept[q]))[:k]
        assert [i for i, _ in found[q]] == [i for _, i in want]
        assert np.allclose([s for _, s in found[q]], [-s for s, _ in want], rtol=0, atol=1e-12)


def test_odd_rows_ties_and_other_dimensions(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(70)]
    rows += [(100 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(12)]
    rows += [(200, None), (205, [0.0] * 6), (210, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (215, [float("inf")] * 6), (220, []),
             (None, [1.0] * 6), (225, [1.0, 2.0]), (230, [2.0, 1.0]), (235, [3.0]), (3, rows[3][1]), (4, [9.0] * 6),
             (240, [1e300, 1e299, 0.0, 0.0, 0.0, 0.0]), (245, [1e-300, 0.0, 0.0, 0.0, 0.0, 2e-300])]
    found = searched(spark, rows, block_rows=30)
    big = [(i, [x * 1e-300 for x in v] if v and v[0] == 1e300 else [x * 1e300 for x in v] if v and v[0] == 1e-300 else v)
           for i, v in rows]
    same_as_brute(found, big)
    assert searched(spark, []) == {}
    assert searched(spark, [(5, [1.0, 2.0])]) == {}
    same_as_brute(searched(spark, rows[:3]), rows[:3])


def test_recall_over_blocks_and_a_cluster(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 64))
    x[:1000] = x[0] + 0.1 * rng.normal(size=(1000, 64))        # a third of all rows lie close together
    x = x[rng.permutation(3000)]
    found = searched(spark, list(enumerate(x.tolist())), share=0.2, least=0, block_rows=1500)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hits = n = 0
    for q in range(0, 3000, 25):
        s = unit @ unit[q]
        s[q] = -2
        want = set(np.argsort(-s)[:5].tolist())
        hits, n = hits + len(want & {i for i, _ in found[q]}), n + 5
        for i, score in found[q]:
            assert abs(score - s[i]) < 1e-12
    assert hits / n >= 0.9


def test_ascent_is_synchronous_and_finds_enough():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 16))
    tree = forest.Forest(Block(np.arange(800), np.zeros(800, np.int64), x, b""), 0.05, 20)
    keys = forest.strings(x[:40])
    low, high = tree.ranges(keys)
    for i in range(40):
        at = set(tree.candidates(low[:, :, i], high[:, :, i]).tolist())
        assert i in at and len(at) >= 40
        depth = np.array([[_common(keys[t, i], k) for k in forest.strings(x)[t]] for t in range(2)]) if i < 2 else None
        if depth is not None:
            deepest = max(d for d in range(forest.SYMBOLS + 1)
                          if len({j for t in range(forest.TREES) for j in tree.order[t, low[t, d, i]:high[t, d, i]]}) >= 40)
            assert set(np.flatnonzero((depth >= deepest).any(axis=0)).tolist()) <= at


def _common(a, b):
    a, b = (int(x).to_bytes(forest.SYMBOLS, "big") for x in (a, b))
    return next((d for d in range(forest.SYMBOLS) if a[d] != b[d]), forest.SYMBOLS)


@pytest.mark.parametrize("dim", [1, 3, 200])
def test_strings_of_any_dimension_follow_the_direction(dim):
    x = np.random.default_rng(dim).normal(size=(50, dim))
    assert (forest.strings(x) == forest.strings(x * 4)).all()
    assert (forest.strings(x) == forest.strings(x[:7])[:, :1]).any()
