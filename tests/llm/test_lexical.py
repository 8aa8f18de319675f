"""Ranked lexical search: brute force over odd texts, classes and hot classes; terms of any cut."""

import math
import random
import re
from collections import Counter

import pytest

from gapline.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LOW = -1 << 63


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(items, docs, top):
    held = {}
    for i, t in items:
        held.setdefault(LOW if i is None else i, set()).update(words(t))
    bags = [(LOW if d is None else d, words(t)) for d, t in docs]
    n_docs, terms = sum(1 for _, w in bags if w), sum(len(w) for _, w in bags)
    df = Counter(t for _, w in bags for t in set(w))
    out = []
    for i, asked in held.items():
        scores = []
        for d, w in bags:
            tf, score = Counter(w), 0
            for t in asked & set(w):
                m = 50 + 50 * len(w) * n_docs // terms
                score += math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * df[t] + 1))) * (
                    1_000_000_000 * tf[t] // (1000 * tf[t] + 20 * m))
            if score > 0:
                scores.append((-score, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:top])]
    return sorted(out)


def searched(spark, items, docs, top, **settings):
    left = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id int")
    right = spark.createDataFrame([(d, t, "x", 2.0, 3) for d, t in docs],
                                  "doc_id bigint, text string, item_id string, score double, rank int").repartition(5)
    out = lexical.search(left, right, top=top, **settings)
    assert dict(out.dtypes)["rank"] == "int"
    return sorted((LOW if r.item_id is None else r.item_id, r["rank"], LOW if r.doc_id is None else r.doc_id, r.score)
                  for r in out.collect())


def corpus(seed, n):
    rng = random.Random(seed)
    made = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 2))) for _ in range(40)]
    return [(i, " ".join(rng.choice(made) for _ in range(rng.randint(0, 30)))) for i in range(n)], made


@pytest.mark.parametrize("item_bytes", [1 << 20, 20_000])
def test_brute_force(spark, item_bytes):
    docs, made = corpus(1, 150)
    docs += [(200, None), (201, ""), (202, " .,!\x00\x7f"), (None, "AB é ab"), (203, "É é Ünï ab"), (7, docs[7][1]),
             (7, "other " + made[0]), (204, "x" * 50_000 + " " + made[1]), (205, (made[2] + " ") * 60_000)]
    items = [(1, " ".join(made[:5])), (2, made[3].upper() + "," + made[3]), (3, None), (4, ""), (5, "unknown"),
             (None, made[0] + " é"), (1, made[6]), (6, "É"), (7, "x" * 50_000)]
    assert searched(spark, items, docs, 7, item_bytes=item_bytes) == brute(items, docs, 7)


def test_equal_bags_are_one_class_and_expand_in_order(spark):
    docs, made = corpus(2, 60)
    docs += [(1000 - i, f"{made[0]} {made[1]} zz{i % 3}") for i in range(300)]       # equal bags, other texts
    items = [(1, f"{made[0]} {made[1]}"), (2, made[5])]
    want = brute(items, docs, 20)
    assert searched(spark, items, docs, 20) == want
    assert searched(spark, items, docs, 20, hot_rows=50) == want


def test_empty_tables(spark):
    assert searched(spark, [], [(1, "a")], 5) == []
    assert searched(spark, [(1, "a")], [], 5) == []
    assert searched(spark, [(1, "a")], [(1, None)], 5) == []


def test_terms_at_any_cut(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 16)
    rng = random.Random(3)
    for _ in range(2000):
        text = "".join(rng.choice("aB9 .é\x7f ~\n" + "x" * rng.randint(0, 8)) for _ in range(rng.randint(0, 90)))
        assert [w.decode() for part in lexical.terms(text.encode()) for w in part] == words(text)


def test_counts_above_two_bytes():
    import numpy as np

    for pairs in ([[1, 2], [3, 4]], [[1, 70_000]], [[70_000, 1]], []):
        p = np.array(pairs, np.int64).reshape(-1, 2)
        assert lexical._unpacked(lexical._packed(p)).T.tolist() == p.tolist()
