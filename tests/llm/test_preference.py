"""Preference pairs: common prefix, masks that fit the text, order of turns, edge rows."""

from gapline.llm import preference as p

U, A, B = ("user", "hi"), ("assistant", "one"), ("assistant", "two é")
SCHEMA = ("pair int, chosen array<struct<role:string,text:string>>, "
          "rejected array<struct<role:string,text:string>>, prompt_id int")


def shown(turns):
    return "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in turns)


def brute(c, r):
    c, r = ([(a or "", b or "") for a, b in x or []] for x in (c, r))
    n = 0
    while n < min(len(c), len(r)) and c[n] == r[n]:
        n += 1
    return n, shown(c[:n]), shown(c[n:]), shown(r[n:])


CASES = [([U, A], [U, B]), ([U, A], [U, A]), ([U, A], [U, A, U, B]), ([U, A, U], [U]), ([A], [B]),
         ([], [U]), (None, None), ([(None, "x"), (None, None)], [("", "x"), ("user", "")]),
         ([U] * 300 + [A], [U] * 300 + [B]), ([("user", "x" * 200_000)], [("user", "x" * 200_000 + "y")])]


def test_pairs(spark):
    df = spark.createDataFrame([(i, c, r, 1) for i, (c, r) in enumerate(CASES)], SCHEMA)
    rows = {r.pair: r for r in p.format_pairs(df).collect()}
    for i, (c, r) in enumerate(CASES):
        got = rows[i]
        assert (got.n_prompt_turns, got.prompt, got.chosen, got.rejected) == brute(c, r)
        for text, runs in ((got.chosen, got.chosen_mask), (got.rejected, got.rejected_mask)):
            assert sum(m.length for m in runs) == len(text)
            at = 0
            for m in runs:
                if m.train:
                    assert text[at:at + m.length].endswith("<|im_end|>\n")
                    assert text[:at].endswith("<|im_start|>assistant\n")
                at += m.length
    assert p.format_pairs(df.filter("pair < 0")).count() == 0


def test_turns_in_order(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, None, "system", None), (1, 2, None, "z"),
            (None, 1, "user", "q"), (2, 10, "user", "x"), (2, 9, "user", "y")]
    df = spark.createDataFrame([(*r, "z") for r in rows],
                               "conv_id int, turn int, role string, text string, turns string")
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in p.conversations(df.repartition(3)).collect()}
    assert got == {1: [("system", ""), ("user", "a"), ("", "z"), ("assistant", "b")],
                   None: [("user", "q")], 2: [("user", "y"), ("user", "x")]}


def test_cut_answer(spark):
    df = spark.createDataFrame([(1, [U, ("assistant", "abcde"), U], [], 0), (2, [U], [], 0)], SCHEMA)
    got = {r.pair: [tuple(t) for t in r.t] for r in
           df.select("pair", p.cut_last_answer(df.chosen).alias("t")).collect()}
    assert got == {1: [U, ("assistant", "ab")], 2: [("user", "h")]}


def test_other_columns_may_have_any_name(spark):
    turns = "array<struct<role:string,text:string>>"
    df = spark.createDataFrame(
        [([("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", "c")], 7, 8, 9, "old", 1)],
        f"chosen {turns}, rejected {turns}, _n int, _c int, `a.b` int, prompt string, n int")
    out = p.format_pairs(df)
    assert out.columns == ["_n", "_c", "a.b", "n", *p.RESULT]
    row = out.first()
    assert tuple(row)[:5] == (7, 8, 9, 1, 1) and row["prompt"].startswith("<|im_start|>user")
