"""MinHash: brute force on all pairs, hot groups by every way of dealing them, edge rows, sketches."""

import random

import numpy as np
import pyarrow as pa
import pytest

from gapline.llm import minhash as m

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = (text or "").translate(LOWER).encode().split()
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return set(zip(w, w[1:], w[2:], w[3:], w[4:]))


def brute(rows, percent=85):
    """The component of every id."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in sets}


def texts(seed, n=150):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(4))
    base = [[word() for _ in range(rnd.choice([3, 8, 40, 120]))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = list(base[0] if rnd.random() < 0.5 else rnd.choice(base))
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = word()
        rows.append((i, rnd.choice([" ", "\n", "\t "]).join(w).title() if i % 3 else " ".join(w)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "only four words here"), (904, "Only FOUR words here"),
             (905, "word " * 30_000), (906, "word " * 20_000), (-3, "only four words"), (907, "É é é é é"),
             (908, "é é é é é")]
    return rows


@pytest.mark.parametrize("seed,limit", [(1, m.GROUP_SHINGLES), (2, 300), (3, 3_000)])
def test_brute_force(spark, seed, limit):
    rows = texts(seed)
    df = spark.createDataFrame([(i, t, 1, "n") for i, t in rows],
                               "doc_id bigint, text string, key int, n string").repartition(4)
    got = {r.doc_id: r for r in m.near_duplicates(df, 85, group_shingles=limit).collect()}
    want = brute(rows)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(shingles(t)) for i, t in rows}
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_null_and_repeated_ids(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(None, text), (5, text), (7, "z y x w v"), (7, "z y x w v")],
                               "doc_id bigint, text string")
    got = sorted((tuple(r) for r in m.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 4, None, True), (5, 4, None, False), (7, 1, 7, True), (7, 1, 7, True)], key=str)
    assert m.near_duplicates(df.filter("doc_id > 9")).count() == 0


def test_minimum_and_maximum_match_as_often_as_sets_do():
    rnd = np.random.default_rng(1)
    pool = rnd.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    values = []
    for s in (a, b):
        product = s[None, :] * m.MULTIPLIERS[:, None]
        values.append(np.concatenate([product.min(1), product.max(1)]))
    assert abs((values[0] == values[1]).mean() - 0.6) < 0.1


def test_links_of_counts_all_pairs():
    rnd = random.Random(4)
    sets = [np.unique(np.array([rnd.randrange(60) for _ in range(rnd.randint(1, 25))], np.uint64)) for _ in range(80)]
    root = m.links_of(sets, None, 50)
    want = list(range(80))
    changed = True
    while changed:
        changed = False
        for i in range(80):
            for j in range(i):
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                if 100 * len(a & b) >= 50 * len(a | b) and want[i] != want[j]:
                    want[i] = want[j] = min(want[i], want[j])
                    changed = True
    assert root.tolist() == want
    h, edges = m.shingle_sets(pa.array(["", "a b", "A\nB", "c"]))
    assert edges.tolist() == [0, 0, 1, 2, 3] and h[0] == h[1]


def test_words_that_fool_a_hash_are_not_linked(spark):
    from test_bpe import thue_morse

    one, two = thue_morse()
    rows = [(1, one), (2, two), (3, f"{one} x {two} y z"), (4, f"{two} x {one} y z")]
    got = m.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, i) for i, _ in rows]


def test_bands_follow_the_similarity():
    assert m.banding(85) == (36, 7) and m.banding(80) == (46, 6)
    for percent in (50, 70, 90, 100):
        bands, rows = m.banding(percent)
        assert (1 - min(percent / 100, 0.999) ** rows) ** bands <= 1.01e-6 or bands == 200
