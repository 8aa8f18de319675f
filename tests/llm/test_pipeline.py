"""The pipeline against a brute-force version of its stages, stage by stage, and its edge rows."""

import random
import re

import pytest
from test_minhash import brute as brute_near
from test_packing import brute_pieces

import corpus_pipeline as cp

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def brute_exact(rows):
    best = {}
    for r in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", r[1])
        rank = (-len(r[1]), -(1 << 63) if r[0] is None else r[0])
        if key not in best or rank < best[key][0]:
            best[key] = (rank, r)
    return [r for _, r in best.values()]


def brute_cut(rows, length=50):
    """Texts with repeated strings cut out, as kept by the definition of the operator."""
    raw = {r[0]: r[1].encode() for r in rows}
    least = {}
    for i in sorted(raw):
        for p in range(len(raw[i]) - length + 1):
            least.setdefault(raw[i][p:p + length], i)
    out = []
    for i, text, *rest in rows:
        t, gone = raw[i], set()
        for p in range(len(t) - length + 1):
            if least[t[p:p + length]] < i:
                gone.update(range(p, p + length))
        kept = bytes(b for k, b in enumerate(t) if k not in gone).decode("utf-8", "ignore")
        if kept or not gone:
            out.append((i, kept, *rest[:-1], len(kept) if gone else rest[-1]))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    """Real documents, cut to size, with copies and passages planted."""
    rnd = random.Random(5)
    base = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    base = [(r[0], r[1][:1500], r[2], r[3], len(r[1][:1500])) for r in base]
    words = base[3][1].split()[:70]
    for k in range(6):
        i, t, *rest = base[10 + k]
        copy = t.replace(" ", "  ", 2) if k % 2 else t[:-4] + "other words here"
        base.append((10_000 + k, copy, *rest[:-1], len(copy)))
        mixed = base[20 + k][1][:200] + " " + " ".join(words) + " " + str(rnd.random())
        base.append((20_000 + k, mixed, *rest[:-1], len(mixed)))
    base += [(30_000, None, "en", "s", None), (30_001, "", None, None, 0), (30_002, "12 34 !", "en", None, 7)]
    return base


def test_stages_against_brute_force(spark, docs):
    df = spark.createDataFrame(docs, COLUMNS).repartition(3)
    one = rows_of(cp.identify(spark, df, ""))
    assert {r[0] for r in docs} - {r[0] for r in one} == {30_000, 30_001, 30_002} | {
        r[0] for r in docs if r[1] and not any(c.isalpha() for c in r[1])}
    two = cp.exact_copies(spark, spark.createDataFrame(one, COLUMNS), "")
    assert rows_of(two) == sorted(brute_exact(one), key=str)
    rows = rows_of(two)
    three = rows_of(cp.near_copies(spark, spark.createDataFrame(rows, COLUMNS), ""))
    component = brute_near([(r[0], r[1]) for r in rows], cp.NEAR_PERCENT)
    assert three == [r for r in rows if component[r[0]] == r[0]]
    four = rows_of(cp.repeats(spark, spark.createDataFrame(three, COLUMNS), ""))
    assert four == sorted(brute_cut(three), key=str)
    five = cp.pack(spark, spark.createDataFrame(four, COLUMNS), "").toPandas()
    named = [tuple(int(x) for x in r) for r in
             five[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(named, key=str) == brute_pieces([(r[0], r[1]) for r in four], 1024, 2)


def test_rows_that_repeat_an_id(spark):
    rows = [(1, "one two three four five six", "en", "a", 1), (1, "one two three four five six", "en", "a", 1),
            (None, "seven eight nine ten eleven", "en", "b", 2), (2, "one two three  four five six", "en", "c", 3)]
    df = spark.createDataFrame(rows, COLUMNS)
    got = rows_of(cp.exact_copies(spark, df, ""))
    assert got == sorted([rows[2], rows[3]], key=str)
    again = spark.createDataFrame([rows[0], rows[0], rows[2]], COLUMNS)
    assert rows_of(cp.near_copies(spark, again, "")) == sorted([rows[0], rows[2]], key=str)


TEXTS = {"copy": "one two three four five six seven eight nine ten " * 4,
         "alone": "zeta eta theta iota kappa lambda mu nu xi omicron " * 4,
         "first": "alpha beta gamma delta epsilon digamma stigma heta san qoppa " * 4}


@pytest.mark.parametrize("other", [2, None])
@pytest.mark.parametrize("stage", [cp.exact_copies, cp.near_copies, cp.repeats])
def test_different_texts_under_one_id_are_judged_by_row(spark, stage, other):
    rows = [(1, TEXTS["copy"]), (other, TEXTS["copy"]), (other, TEXTS["alone"]), (other, TEXTS["first"]), (3, TEXTS["copy"])]
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows],
                               "doc_id bigint, text string, _id int, _text int, _row int, _rest int").repartition(3)
    out = stage(spark, df, "")
    assert out.columns == df.columns
    got = [tuple(r) for r in out.collect()]
    assert sorted(t for _, t, *_ in got) == sorted(TEXTS.values())
    assert all(r[2:] == (1, 2, 3, 4) for r in got)
    assert [i for i, t, *_ in got if t == TEXTS["copy"]] == [None if other is None else 1]


def test_empty(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for name, stage in cp.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0
        if name != "pack":
            assert out.columns == docs.columns
