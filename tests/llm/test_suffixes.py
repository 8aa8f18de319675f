"""Suffix-array dedup: brute force over all strings, ties, hot passages, edges, both ways to join."""

import hashlib
import random

import numpy as np
import pytest

from gapline.llm import suffixes as s


def brute(rows, length=50):
    """Bytes covered by a string that also starts in a document with a smaller id."""
    raw = [(-1 << 63 if i is None else i, (t or "").encode()) for i, t in rows]
    least: dict[bytes, int] = {}
    for i, t in raw:
        for p in range(len(t) - length + 1):
            g = t[p:p + length]
            least[g] = min(least.get(g, i), i)
    out = []
    for i, t in raw:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if least[t[p:p + length]] < i:
                gone[p:p + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(t) else 0
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df, **more):
    return sorted((-1 << 63 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans,
                   hashlib.sha256(bytes(r.kept)).hexdigest()) for r in s.remove_repeats(df, **more).collect())


def texts(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7)))
    base = [" ".join(word() for _ in range(rnd.randint(5, 120))) for _ in range(12)]
    passage = " ".join(word() for _ in range(30))
    rows = []
    for i in range(60):
        t = rnd.choice(base)
        kind = rnd.random()
        if kind < 0.3:
            t = t[:rnd.randint(0, len(t))] + word() + t[rnd.randint(0, len(t)):]
        elif kind < 0.6:
            t = word() + passage[rnd.randint(0, 20):] + word() + t[:rnd.randint(0, 80)]
        elif kind < 0.7:
            t = t + "ab" * rnd.randint(0, 200)
        rows.append((i, t))
    rows += [(100, None), (101, ""), (102, "x" * 49), (103, "x" * 50), (104, "x" * 51), (105, "y" * 5000),
             (106, "y" * 4000 + "z"), (None, "x" * 60), (107, "x" * 49 + "\n"), (50, passage + "tail"),
             (50, passage + "tail"), (-5, base[0])]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,entries,few", [(1, 1_000_000, 1_000_000), (2, 300, 1_000_000), (3, 300, 0)])
def test_brute_force(spark, seed, entries, few):
    rows = texts(seed)
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows],
                               "doc_id bigint, text string, keys string, tag int").repartition(5)
    assert got(df, owner_entries=entries, broadcast_rows=few) == brute(rows)
    assert got(df.filter("tag > 1")) == []


def test_other_lengths(spark):
    rows = texts(4)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert got(df, length=24) == brute(rows, 24)
    with pytest.raises(ValueError):
        s.remove_repeats(df, length=10)


def test_longest_previous_by_brute_force():
    rnd = np.random.default_rng(3)
    windows = rnd.integers(0, 2, (300, 12)).astype(np.uint8)
    docs = rnd.integers(0, 9, 300)
    order, lcp = s.suffix_order(windows)
    assert [bytes(w) for w in windows[order]] == sorted(bytes(w) for w in windows)
    found = s.longest_previous(docs[order], lcp, 5)
    for k, i in enumerate(order):
        best = 0
        for j in range(300):
            if docs[j] < docs[i]:
                same = np.append(windows[i] == windows[j], False)
                best = max(best, int(np.argmin(same)))
        assert found[k] == (best if best >= 5 else 0)
