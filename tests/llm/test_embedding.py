"""Edit embedding: a plain walk, edited texts by brute force, likeness of near and far texts, bands."""

import hashlib
import random

import numpy as np
import pytest

from gapline.llm import embedding as e


def plain_walk(text):
    """The fingerprint by one character at a time."""
    keys, noise = e._keys(1 << 12), e._noise()
    i, read = 0, []
    while i < len(text):
        c = int(noise[ord(text[i])])
        read.append(((c * 0x9E3779B1) & 0xFFFFFFFF) >> 28)
        i += ((c * int(keys[len(read) - 1])) & 0xFFFFFFFF) >> 31
    steps = e.steps_of(len(text))
    return f"{len(text):08x}:" + "".join("%x" % read[s] if s < len(read) else "-" for s in steps)


TEXTS = ["", "a", "ab\0c", "é" * 50, "the quick brown fox " * 40, "z" * 3000, "mixed éß 漢字 \U0001F600" * 9]


def test_matches_plain_walk():
    assert e.embed(TEXTS) == [plain_walk(t) for t in TEXTS]
    assert e.embed([]) == []


def test_steps_nest():
    for n, m in ((10, 11), (100, 130), (400, 5000), (1000, 1001)):
        a, b = e.steps_of(n), e.steps_of(m)
        assert (b[b < 3 * n] == a[:int((b < 3 * n).sum())]).all()


def test_likeness_follows_edits():
    rnd = random.Random(1)
    text = "".join(rnd.choice("abcdefghij ") for _ in range(4000))
    few = text[:1000] + "x" + text[1001:2500] + text[2503:]
    a, b, c = e.embed([text, few, "".join(rnd.choice("abcdefghij ") for _ in range(4000))])
    assert e.likeness(a, a) == 1
    assert e.likeness(a, b) > 0.8 > 0.25 > e.likeness(a, c)
    assert e.likeness(a, b) == e.likeness(b, a)


ROWS = [(5, "five " * 30), (None, "null id"), (1, None), (2, ""), (9, "last doc é" * 10), (3, "x"),
        (7, "repeated b"), (7, "repeated a"), (8, "y" * 50_000), (6, "漢字" * 77)]


@pytest.mark.parametrize("size", [3_000, 1 << 24])
def test_edited_texts(spark, size):
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in ROWS],
                               "doc_id bigint, text string, tail int, bucket string").repartition(4)
    rows = sorted(((-1 if i is None else i, t or "") for i, t in ROWS))
    want = []
    for k, (i, t) in enumerate(rows):
        u = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[:len(t) - q] + u[:q]
        p, s, x = e.embed([t, edited, u])
        want.append((None if i < 0 else i, len(t), hashlib.sha256(edited.encode()).hexdigest(), p, s,
                     e.likeness(p, s), e.likeness(p, x)))
    got = [tuple(r) for r in e.edited_fingerprints(df, bucket_bytes=size).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert e.edited_fingerprints(df.filter("tail > 1"), bucket_bytes=size).count() == 0


def test_one_row_is_its_own_next(spark):
    df = spark.createDataFrame([(4, "abcdefgh")], "doc_id bigint, text string")
    row = e.edited_fingerprints(df).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and row.near_next == 1


def test_near_links(spark):
    rnd = random.Random(2)
    base = ["".join(rnd.choice("abcdefghij ") for _ in range(600 + 90 * k)) for k in range(8)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(100 + k, t[:200] + "#" + t[200:]) for k, t in enumerate(base)] + [(200, base[0]), (300, "")]
    prints = e.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = {(r.doc_id, r.near_id) for r in e.near_links(prints, 0.6).collect()}
    assert got == {(100 + k, k) for k in range(8)} | {(200, 0)}
    assert np.unique([len(f) for f in e.embed(base)]).tolist() == [9 + e.SAMPLES]


def brute_near(rows, least):
    """near_id of every row: the smallest id among its own and those of all texts that are near."""
    prints = e.embed([t for _, t in rows])
    return sorted((i, min([i] + [j for (j, _), g in zip(rows, prints) if j < i and e.likeness(f, g) >= least]))
                  for (i, _), f in zip(rows, prints))


@pytest.mark.parametrize("block", [2, 1024])
def test_near_ids_where_the_smallest_of_a_bucket_is_unrelated(spark, monkeypatch, block):
    """All texts share every bucket; an unrelated text is the smallest of each."""
    monkeypatch.setattr(e, "band_keys", lambda f, least: [7] if int(f[:8], 16) else [])
    monkeypatch.setattr(e, "BLOCK_ROWS", block)
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcdefghij ") for _ in range(400 + 50 * k)) for k in range(5)]
    rows = [(1, "unrelated " * 60)] + [(10 + k, t) for k, t in enumerate(base)]
    rows += [(20 + 10 * c + k, t[:99 + c] + "#" + t[99 + c:]) for c in range(2) for k, t in enumerate(base)]
    rows += [(50, base[1]), (60, ""), (61, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = brute_near(rows, 0.7)
    assert sum(j < i for i, j in want) > 8
    got = e.edited_fingerprints(df, bucket_bytes=2_000, least=0.7)
    assert sorted((r.doc_id, r.near_id) for r in got.collect()) == want
    links = {(r.doc_id, r.near_id) for r in e.near_links(e.fingerprints(df), 0.7).collect()}
    assert links == {x for x in want if x[0] != x[1]}


def test_near_ids_through_the_keys(spark):
    rnd = random.Random(4)
    base = ["".join(rnd.choice("abcdefghij ") for _ in range(300 + 37 * k)) for k in range(40)]
    rows = [(100 + k, t) for k, t in enumerate(base)]
    rows += [(200 + k, t[:90] + "#" + t[90:]) for k, t in enumerate(base)]
    df = spark.createDataFrame([*rows, (None, base[3])], "doc_id bigint, text string").repartition(3)
    got = {(r.doc_id, r.near_id) for r in e.edited_fingerprints(df, least=e.NEAR).collect()}
    want = set(brute_near(rows, e.NEAR)) - {(103, 103), (203, 103)} | {(103, None), (203, None), (None, None)}
    assert got == want


def test_packed_fingerprints():
    prints = e.embed([*TEXTS, "x" * 100_000])
    blobs = e._packed(prints)
    assert e._texts_of(blobs) == prints and {len(b) for b in blobs} == {164}
    assert all((a == b).all() for a, b in zip(e._unpacked(blobs), e._digits(prints)))
