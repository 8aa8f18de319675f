"""BPE: ids of the tokenizers library on words, scripts, special strings and real texts; round trips."""

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import numpy as np

from gapline.llm import bpe

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
OTHER = Tokenizer.from_file(PATH)
TEXTS = ["", "a", "aaaaaaa", "  x  y ", "\x1c \x1d a\x85b​　 q", "\n's x'", "'d", "don't ''s a'reb", "it's't 's 'll'veé",
         "<|endoftext|>", "a <|endoftext|> b  <|endoftext|>'s", "x<|endoftext|", "漢字 \U0001F600\U0001F600",
         "é", "\0\0 \0", "   ", "\r\n\t\r\n", "1234567 890", "y" * 70_000]


def same(texts):
    vocab = bpe.vocabulary(PATH)
    ids, edges = vocab.encode(texts)
    want = OTHER.encode_batch(texts, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:])] == [w.ids for w in want]
    assert vocab.decode(ids).tobytes() == "".join(texts).encode()


def test_same_ids_as_the_library():
    same(TEXTS)
    same(["a" + chr(c) + "b 1" + chr(c) + " ," + chr(c) * 2 for c in range(0x3000) if not 0xD800 <= c < 0xE000])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab'sredtvml \n\t1,.é<|>"), st.characters(
    exclude_categories=("Cs",))), max_size=40), max_size=5))
def test_same_ids_on_random_texts(texts):
    same(texts)


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    for _ in range(3):
        same(["one two three four five six", "two six"])


def test_one_text_with_more_words_than_slots(monkeypatch):
    monkeypatch.setattr(bpe, "SLOTS_BITS", 4)
    vocab = bpe.vocabulary(PATH)
    vocab.forget()
    try:
        same(["one two", " ".join(f"w{i} {i * i}" for i in range(300)), "two w299"])
        assert vocab.bits > 4 and 2 * vocab.known <= len(vocab.slots)
    finally:
        monkeypatch.undo()
        vocab.forget()


def test_query_columns(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(99, None), (None, "x y"), (0, "again")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, ids int").repartition(3)
    got = bpe.encode(df, PATH, ("ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256"))
    want = []
    for i, t in rows:
        ids = OTHER.encode(t or "", add_special_tokens=False).ids
        back = OTHER.decode(ids, skip_special_tokens=False)
        want.append((i, ids, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), back,
                     hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    back = {r.doc_id: r.decoded for r in bpe.decode(got.filter("doc_id > 0"), PATH).collect()}
    assert back == {i: t or "" for i, t in rows if i}
    assert bpe.encode(df.filter("ids > 1"), PATH).count() == 0


@pytest.mark.parametrize("word", ["hello", " world", "ééé", "aaaa", "abababab"])
def test_merge_rounds(word):
    ids, sizes = bpe.vocabulary(PATH).merge_words([word.encode()])
    assert ids.tolist() == OTHER.encode(word, add_special_tokens=False).ids and sizes.tolist() == [len(ids)]


def thue_morse(bits=12):
    word = [0]
    for _ in range(bits):
        word += [1 - x for x in word]
    return "".join("ab"[x] for x in word), "".join("ba"[x] for x in word)


def test_words_that_fool_a_hash_keep_their_own_ids(monkeypatch):
    import public_tokenizers
    import tokenizers

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    vocab, library = bpe.Vocabulary(path), tokenizers.Tokenizer.from_file(path)
    one, two = thue_morse()
    texts = [one, two, f"{one} {two}", "the quick brown fox <|endoftext|> é 中文", "the the lazy dog 123", ""]

    def check():
        ids, edges = vocab.encode(texts)
        for t, a, b in zip(texts, edges, edges[1:]):
            assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids

    check()
    honest = bpe.Wrapping.hashes
    monkeypatch.setattr(bpe.Wrapping, "hashes", lambda self, a, b: (honest(self, a, b) % np.uint64(7)) << np.uint64(60))
    vocab.forget()
    check()
    check()
