"""Packing: best fit one by one, bounds against brute force, exact pieces, edge rows."""

import zlib
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gapline.llm import packing

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def one_by_one(lengths, size):
    bins = []
    for x in sorted(lengths, reverse=True):
        fit = [b for b in bins if b[0] >= x]
        if fit:
            b = min(fit, key=lambda b: b[0])
            b[0] -= x
        else:
            bins.append([size - x])
    return len(bins)


@pytest.mark.parametrize("seed", range(12))
def test_counts_as_best_fit_one_by_one(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(5, 200))
    lengths = rng.integers(1, size + 1, int(rng.integers(1, 400)))
    bins, offsets, used = packing.best_fit_decreasing(lengths, size)
    assert used == one_by_one(lengths, size) >= packing.lower_bound(lengths, size)
    check_places(bins, offsets, lengths, size)


def check_places(bins, offsets, lengths, size):
    for b in np.unique(bins):
        own = np.flatnonzero(bins == b)
        own = own[np.argsort(offsets[own])]
        assert (offsets[own] == np.cumsum(lengths[own]) - lengths[own]).all()
        assert lengths[own].sum() <= size


def least_bins(lengths, size):
    best = len(lengths)
    for places in product(range(len(lengths)), repeat=len(lengths)):
        if all(sum(x for x, p in zip(lengths, places) if p == b) <= size for b in set(places)):
            best = min(best, len(set(places)))
    return best


@pytest.mark.parametrize("seed", range(8))
def test_bound_holds(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 11, 6)
    assert packing.lower_bound(lengths, 10) <= least_bins(lengths.tolist(), 10)


def test_bound_sees_large_pieces():
    assert packing.lower_bound(np.full(10, 600), 1024) == 10
    assert packing.lower_bound(np.full(9, 342), 1024) == 5


def brute_pieces(rows, size, end):
    t = Tokenizer.from_file(PATH)
    out = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [end]
        first = len(ids) % size or size
        edges = [0, *range(first, len(ids) + 1, size)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            out.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return sorted(out, key=str)


def test_documents_and_rounds(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame(
        [(None, None), (-1, ""), (-2, "word " * 1023), (-3, "word " * 1022), (-4, "x" * 50_000),
         (-4, "x" * 50_000)], "doc_id bigint, text string")
    docs = docs.select("doc_id", "text").unionByName(extra).repartition(3)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    cut = packing.pieces(docs, PATH, 256, 2)
    got = packing.pack(cut, 256, group_pieces=40, least_groups=20).toPandas()
    named = [tuple(None if x != x else int(x) for x in r)
             for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(named, key=str) == brute_pieces(rows, 256, 2)
    check_places(got.sequence_id.to_numpy(), got.offset.to_numpy(), got.length.to_numpy(), 256)
    assert got.sequence_id.nunique() <= 1.01 * packing.lower_bound(got.length.to_numpy(), 256) + 2
    assert packing.pack(cut.filter("length < 0"), 256).count() == 0
