"""Exact duplicates: brute force, many senders and owners, coded numbers, edge rows."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from gapline.llm import exact, golomb


@given(st.sets(st.integers(0, (1 << 63) - 1), max_size=60))
def test_coded_numbers_come_back(values):
    v = np.array(sorted(values), np.uint64)
    assert golomb.decode(golomb.encode(v)).tolist() == v.tolist()


def test_coding_is_near_the_bound():
    v = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 50_000).astype(np.uint64))
    assert 8 * len(golomb.encode(v)) < len(v) * (np.log2((1 << 48) / len(v)) + 2.5)


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append(
            (-len(t or ""), -1 << 63 if i is None else i))
    out = []
    for key, g in groups.items():
        keep = min(g)[1]
        out += [(i, keep, len(g), i == keep, hashlib.sha256(key.encode()).hexdigest()) for _, i in g]
    return sorted(out)


ROWS = [(i, f"text {i % 7}" + " " * (i % 5)) for i in range(200)] + [
    (300, None), (301, ""), (302, " \t\n\x0b\x0c\r"), (303, " "), (None, "text 1"), (304, "y" * 100_000),
    (305, "y" * 100_000 + "\n"), (306, "alone"), (307, "twice"), (307, "twice")]


@pytest.mark.parametrize("per_owner", [5, 1_000_000])
def test_brute_force(spark, per_owner):
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in ROWS],
                               "doc_id bigint, text string, sender string, mark int").repartition(6)
    low = -1 << 63
    got = [(low if r.doc_id is None else r.doc_id, low if r.keep_id is None else r.keep_id, r.group_size, r.kept,
            bytes(r.digest).hex()) for r in exact.exact_duplicates(df, rows_per_owner=per_owner).collect()]
    assert sorted(got) == brute(ROWS)
    assert exact.exact_duplicates(df.filter("mark > 1")).count() == 0
