"""Hard negatives: brute force over plain, skewed, signed and odd vectors; ranges never lose a row."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gapline.llm import negatives
from gapline.llm.vectors import Block

SCHEMA = "vec_id bigint, embedding array<float>, label int, score double, number int, block string"


def brute(rows, positives=5, negatives=3):
    kept = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = np.asarray(v, np.float32)
        seen = (len(v), v.tobytes(), label)
        kept[i] = min(kept.get(i, seen), seen)
    ints = {i: ([math.floor(256 * float(x)) for x in np.frombuffer(b, np.float32)], label) for i, (_, b, label) in kept.items()}
    out = []
    for a, (va, la) in ints.items():
        if a % 5:
            continue
        scores = sorted((-sum(x * y for x, y in zip(va, v)), i, label) for i, (v, label) in ints.items()
                        if i != a and len(v) == len(va))
        same = [(i, -s) for s, i, label in scores if label == la][:positives]
        for p, ps in same:
            band = [(i, -s) for s, i, label in scores if label != la and 50 * ps <= -100 * s <= 95 * ps]
            out += [(a, p, r + 1, n, ps, ns) for r, (n, ns) in enumerate(band[:negatives])]
    return sorted(out)


def mined(spark, rows, **settings):
    df = spark.createDataFrame([(i, v, label, 0.0, 1, "x") for i, v, label in rows], SCHEMA).repartition(5)
    out = negatives.hard_negatives(df, F.col("vec_id") % 5 == 0, **settings)
    assert dict(out.dtypes)["rank"] == "int"
    return sorted(tuple(r) for r in out.collect())


def cluster(seed, n, dim, spread, labels=3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(4, dim))
    x = middles[rng.integers(0, 4, n)] + spread * rng.normal(size=(n, dim))
    x *= rng.lognormal(0, 0.7, (n, 1))
    return [(i, v.tolist(), int(label)) for i, (v, label) in enumerate(zip(x, rng.integers(0, labels, n)))]


@pytest.mark.parametrize("spread", [0.1, 2.0])
def test_brute_force_over_many_buckets(spark, spread):
    rows = cluster(1, 180, 6, spread)
    assert mined(spark, rows, block_rows=40) == brute(rows)


def test_odd_rows_ties_and_other_dimensions(spark, monkeypatch):
    rows = cluster(2, 60, 4, 0.5) + [(100 + i, [1.0, 0.0, 0.0, 0.0], i % 2) for i in range(30)]
    rows += [(200, None, 1), (205, [1.0, None, 0.0, 0.0], 1), (210, [float("nan"), 0.0, 0.0, 1.0], 0),
             (215, [float("inf"), 0.0, 0.0, 1.0], 0), (220, [1.0, 1.0, 1.0, 1.0], None), (225, [], 1),
             (None, [1.0, 0.0, 0.0, 0.0], 1), (230, [0.0, 0.0, 0.0, 0.0], 0), (235, [0.0, 0.0, 0.0, 0.0], 1),
             (240, [1.0, 2.0], 0), (245, [2.0, 1.0], 0), (250, [1.5, 1.0], 1), (255, [-1.0, -1.0, 0.0, 0.0], 2),
             (5, rows[5][1], rows[5][2]), (10, [9.0, 9.0, 9.0, 9.0], 1)]
    assert mined(spark, rows, block_rows=16) == brute(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(5, None, 1)]) == []


def test_one_label_holds_most_rows_and_few_rows(spark):
    rows = [(i, v, 0 if i % 10 else 1) for i, v, _ in cluster(3, 90, 3, 1.0)]
    assert mined(spark, rows, block_rows=25) == brute(rows)
    assert mined(spark, rows[:4]) == brute(rows[:4])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10 ** 6), st.floats(0.05, 3.0), st.integers(2, 9))
def test_ranges_lose_no_row_that_reaches_the_score(seed, spread, dim):
    block = Block(np.arange(200), np.zeros(200, np.int64),
                  np.array([v for _, v, _ in cluster(seed, 200, dim, spread)]), b"")
    bucket = negatives.Bucket(block, 256)
    query = bucket.rows[7]
    exact = negatives.products(bucket.rows, query[None])[:, 0]
    for least in np.sort(exact)[[-1, -5, -50]]:
        at = bucket.candidates(query, np.sqrt((query * query).sum()), float(least))
        at = np.arange(200) if at is None else at
        assert set(np.flatnonzero(exact >= least)) <= set(at.tolist())


def test_ranges_prune_a_cluster():
    rows = np.array([v for _, v, _ in cluster(5, 2000, 8, 0.05)])
    bucket = negatives.Bucket(Block(np.arange(2000), np.zeros(2000, np.int64), rows / np.linalg.norm(rows, axis=1)[:, None], b""), 256)
    query = bucket.rows[0]
    length = np.sqrt((query * query).sum())
    assert len(bucket.candidates(query, length, 0.99 * length * bucket.longest)) < 1000


def test_products_are_exact_or_refused():
    big = np.array([[2.0 ** 30, 3.0]])
    assert negatives.products(big, big)[0, 0] == 2 ** 60 + 9
    with pytest.raises(ValueError):
        negatives.products(big * 4, big * 4)
