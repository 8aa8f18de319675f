"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

Texts are cut into words with array operations over character classes. A word is looked up by a 64-bit hash and
compared with the known word character by character; one that differs is encoded by itself. The words of many documents that a task has not met before lie
in one flat array of symbols. Each round looks every neighbouring pair up in the sorted pair
keys of the vocabulary by binary search, takes the lowest rank of each word, and merges all
places of that pair at once. A word leaves when none of its pairs has a rank. Texts then become
gathers from the encoded words.

Ids equal those of the tokenizers library without added special tokens: the strings of special
tokens inside a text become their own ids, as that library does.

Null or empty text: no ids, decoded text empty. Every row gives one row; repeated rows repeat.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.llm.common import Wrapping, character_noise, narrow, slices, tidy

KEPT_WORDS = 250_000      # words a task remembers before it starts afresh
SLOTS_BITS = 20           # hash slots at the start; they double when words fill half of them
NO_RANK = np.int64(1 << 60)

# The letters that follow an apostrophe as one word in byte-level BPE.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
SPACE, LETTER, DIGIT, OTHER, SPECIAL = range(5)

COLUMNS = {
    "ids": "array<int>", "decoded": "string", "n_tokens": "bigint",
    "ids_sha256": "string", "decoded_sha256": "string",
}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: itself if visible."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


class Vocabulary:
    """Sorted pair keys with their ranks and products, and the bytes of every id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*ids.values(), *self.special.values()])
        letters = byte_letters()
        self.first = np.array([ids[c] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(1 << 62))
        self.ranks = np.append(order.astype(np.int64), NO_RANK)
        self.products = np.append(np.array([ids[a + b] for a, b in pairs], np.int64)[order], 0)
        of = {c: b for b, c in enumerate(letters)}
        spelled = [b""] * self.size
        for token, i in ids.items():
            spelled[i] = bytes(of[c] for c in token)
        for token, i in self.special.items():
            spelled[i] = token.encode()
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.lengths = np.array([len(x) for x in spelled], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.cut = regex.compile("|".join(
            regex.escape(t) for t in sorted(self.special, key=len, reverse=True))
        ) if self.special else None
        self.decimal = [str(i) for i in range(self.size)]
        self.classes = character_classes()
        self.forget()

    def forget(self) -> None:
        self.known = 0
        self.empty_slots(SLOTS_BITS)
        self.store = np.zeros(0, np.int64)      # ids of all known words, one after the other
        self.sizes = np.zeros(0, np.int64)
        self.letters = np.zeros(0, np.uint32)   # characters of all known words, one after the other
        self.spans = np.zeros(0, np.int64)

    def empty_slots(self, bits: int) -> None:
        self.bits = bits
        self.slots = np.zeros(1 << bits, np.uint64)             # word hashes, 0 when free
        self.number = np.zeros(1 << bits, np.int32)

    def make_room(self, more: int) -> None:
        """Slots for `more` words beside the known ones, at most half of them taken."""
        bits = max(self.bits, (2 * (self.known + more) - 1).bit_length())
        if bits > self.bits:
            taken = self.slots != 0
            hashes, numbers = self.slots[taken], self.number[taken]
            self.empty_slots(bits)
            self.insert(hashes, numbers)

    def insert(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Put words that are not there yet into free slots."""
        mask, slots = (1 << self.bits) - 1, self.slots
        _, slot = self.find(hashes)
        for h, at, number in zip(hashes.tolist(), slot.tolist(), numbers.tolist()):
            while slots[at]:
                at = (at + 1) & mask
            slots[at] = h
            self.number[at] = number

    def word_starts(self, points: np.ndarray, breaks: np.ndarray,
                    special: list[tuple[int, int]]) -> np.ndarray:
        """Positions where words start. `breaks` are the starts of texts, without empty ones."""
        n = len(points)
        kind = self.classes[points]
        first = np.zeros(n + 1, bool)                           # a text or special token starts
        first[breaks] = True
        first[n] = True
        for a, b in special:
            first[[a, b]] = True
            kind[a:b] = SPECIAL
        start = first.copy()
        start[1:n] |= kind[1:] != kind[:-1]
        space = kind == SPACE
        # The last of several spaces before a visible character stands apart from the others,
        # and a plain space opens the word that follows it.
        before_word = np.zeros(n, bool)
        before_word[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
        start[:n] |= before_word
        opens = np.flatnonzero(before_word & (points == 0x20))
        start[opens + 1] = False
        # Apostrophe endings, where the apostrophe itself starts a word.
        marks = np.flatnonzero((points == 0x27) & start[:n])
        if len(marks):
            end_of = np.append(points, 0)
            for ending in ENDINGS:
                at = marks[marks + len(ending) < n]
                good = np.ones(len(at), bool)
                for k, c in enumerate(ending, 1):
                    good &= (end_of[at + k] == ord(c)) & ~first[at + k]
                at = at[good]
                start[at + 1] = False
                after = at + len(ending) + 1
                start[after[after < n]] = True
        return np.flatnonzero(start[:n])

    def merge_words(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one word after the other, and how many each has."""
        lengths = np.array([len(w) for w in words], np.int64)
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        which = np.arange(len(words))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(which):
            starts = np.cumsum(lengths) - lengths
            keys = symbols[:-1] * self.size + symbols[1:]
            at = np.append(np.searchsorted(self.keys, keys), 0)
            ranks = np.full(len(symbols), NO_RANK)
            ranks[:-1] = np.where(self.keys[at[:-1]] == keys, self.ranks[at[:-1]], NO_RANK)
            ranks[starts + lengths - 1] = NO_RANK          # a word's last symbol has no pair
            least = np.minimum.reduceat(ranks, starts)
            open_ = least < NO_RANK
            if not open_.all():                            # words that are done leave
                stay = np.repeat(open_, lengths)
                done.append((which[~open_], lengths[~open_], symbols[~stay]))
                symbols, ranks, at = symbols[stay], ranks[stay], at[stay]
                which, lengths, least = which[open_], lengths[open_], least[open_]
                if not len(which):
                    break
            hit = ranks == np.repeat(least, lengths)
            if (hit[1:] & hit[:-1]).any():                 # runs like "aaa": every other place
                run = np.arange(len(hit))
                begin = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), run, 0))
                hit &= (run - begin) % 2 == 0
            symbols = np.where(hit, self.products[at], symbols)
            keep = np.append(True, ~hit[:-1])
            edges = np.cumsum(lengths) - lengths
            lengths = np.add.reduceat(keep.astype(np.int64), edges)
            symbols = symbols[keep]
        if not done:
            return np.zeros(0, np.int64), lengths
        order = np.argsort(np.concatenate([d[0] for d in done]), kind="stable")
        sizes = np.concatenate([d[1] for d in done])
        flat = np.concatenate([d[2] for d in done])
        starts = np.cumsum(sizes) - sizes
        return gather(flat, starts[order], sizes[order]), sizes[order]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers, -1 where unknown, and the slot where each search ended."""
        mask = np.int64((1 << self.bits) - 1)
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        number = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        while len(left):
            there = self.slots[slot[left]]
            same = there == hashes[left]
            number[left[same]] = self.number[slot[left[same]]]
            left = left[~same & (there != 0)]
            slot[left] = (slot[left] + 1) & mask
        return number, slot

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one word after the other, and how many each has."""
        plain = [i for i, w in enumerate(words) if w not in self.special]
        ids, sizes = self.merge_words([words[i].encode() for i in plain])
        if len(plain) < len(words):
            spans = dict(zip(plain, np.split(ids, np.cumsum(sizes)[:-1])))
            spans = [spans[i] if i in spans else np.array([self.special[w]])
                     for i, w in enumerate(words)]
            ids, sizes = np.concatenate(spans), np.array([len(x) for x in spans])
        return ids, sizes

    def learn(self, words: list[str], hashes: np.ndarray) -> None:
        """Encode words, each given once, and keep them."""
        ids, sizes = self.ids_of(words)
        self.make_room(len(words))
        self.insert(hashes, np.arange(self.known, self.known + len(words)))
        self.known += len(words)
        self.store = np.concatenate([self.store, ids])
        self.sizes = np.append(self.sizes, sizes)
        self.letters = np.append(self.letters, np.frombuffer("".join(words).encode("utf-32-le"), np.uint32))
        self.spans = np.append(self.spans, [len(w) for w in words])

    def differing(self, points: np.ndarray, lengths: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Places of words that only share the hash of the known word they were taken for."""
        wrong = self.spans[number] != lengths
        if not wrong.any():
            at = np.cumsum(self.spans) - self.spans
            other = gather(self.letters, at[number], lengths) != points
            if not other.any():
                return np.zeros(0, np.int64)
            wrong = np.logical_or.reduceat(other, np.cumsum(lengths) - lengths)
            return np.flatnonzero(wrong)
        at, starts = np.cumsum(self.spans) - self.spans, np.cumsum(lengths) - lengths
        for i in np.flatnonzero(~wrong).tolist():
            k = number[i]
            wrong[i] = (self.letters[at[k]:at[k] + lengths[i]] != points[starts[i]:starts[i] + lengths[i]]).any()
        return np.flatnonzero(wrong)

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and the n + 1 edges of the texts in them."""
        whole = "".join(texts)
        ends = np.append(0, np.cumsum(np.array([len(t) for t in texts], np.int64)))
        if not whole:
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        if self.known > KEPT_WORDS:
            self.forget()
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        special: list[tuple[int, int]] = []
        if self.cut is not None and any(t in whole for t in self.special):
            special = [(int(e) + m.start(), int(e) + m.end()) for e, t in zip(ends, texts)
                       for m in self.cut.finditer(t)]
        starts = self.word_starts(points, ends[:-1][np.diff(ends) > 0], special)
        lengths = np.diff(np.append(starts, len(points)))
        hashes = Wrapping(points, character_noise()).hashes(starts, starts + lengths) | np.uint64(1)
        number, _ = self.find(hashes)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            new, at = np.unique(hashes[missing], return_index=True)
            at = missing[at]
            self.learn([whole[a:b] for a, b in zip(starts[at].tolist(),
                                                   (starts[at] + lengths[at]).tolist())], new)
            number[missing], _ = self.find(hashes[missing])
        sizes = self.sizes[number]
        word_at = np.cumsum(self.sizes) - self.sizes
        ids = gather(self.store, word_at[number], sizes)
        others = self.differing(points, lengths, number)
        if len(others):
            spans = np.split(ids, np.cumsum(sizes)[:-1])
            for i in others.tolist():
                spans[i], _ = self.ids_of([whole[starts[i]:starts[i] + lengths[i]]])
            ids, sizes = np.concatenate(spans), np.array([len(x) for x in spans])
        done = np.append(0, np.cumsum(sizes))
        return ids, done[np.searchsorted(starts, ends)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a flat array of ids."""
        return gather(self.bytes, self.starts[ids], self.lengths[ids])


def gather(store: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """store[start:start + length] of every pair, one after the other."""
    total = int(lengths.sum())
    if not total:
        return store[:0]
    before = np.cumsum(lengths) - lengths
    return store[np.repeat(starts - before, lengths) + np.arange(total)]


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """Space, letter, digit or other for every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000])
    every = "".join(map(chr, points.tolist()))
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            out[points[m.start():m.end()]] = kind
    return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _columns(vocab: Vocabulary, texts: list[str], wanted: Sequence[str]) -> list[pa.Array]:
    ids, edges = vocab.encode(texts)
    out: dict[str, pa.Array] = {"n_tokens": pa.array(np.diff(edges))}
    if "ids" in wanted:
        out["ids"] = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)),
                                              pa.array(ids.astype(np.int32)))
    if "ids_sha256" in wanted:
        spelled = list(map(vocab.decimal.__getitem__, ids.tolist()))
        at = edges.tolist()
        out["ids_sha256"] = pa.array(
            [hashlib.sha256(",".join(spelled[a:b]).encode()).hexdigest()
             for a, b in zip(at, at[1:])], pa.string())
    if "decoded" in wanted or "decoded_sha256" in wanted:
        raw = vocab.decode(ids).tobytes()
        ends = np.append(0, np.cumsum(vocab.lengths[ids]))[edges].tolist()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]
        if "decoded" in wanted:
            out["decoded"] = pa.array(texts, pa.string())
        if "decoded_sha256" in wanted:
            out["decoded_sha256"] = pa.array(
                [hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())
    return [out[c] for c in wanted]


def encode(df: DataFrame, path: str, wanted: Sequence[str] = ("ids", "n_tokens"),
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and the wanted of COLUMNS.

    `decoded` and the digests are made from the ids, not from the text, so comparing them to
    the text proves the round trip. Work is one narrow pass over the texts without a shuffle.
    """
    wanted = list(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for part in slices(batches, size=1 << 19):
            texts = part.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *_columns(vocab, texts, wanted)], names=["doc_id", *wanted])
        vocab.forget()

    schema = ", ".join(["doc_id bigint", *(f"{c} {COLUMNS[c]}" for c in wanted)])
    return narrow(df, id_col, text_col).mapInArrow(tidy(run), schema)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) from an array column of ids; null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            rows = [vocab.decode(np.array(r or [], np.int64)).tobytes().decode("utf-8", "replace")
                    for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.string())],
                                             names=["doc_id", "decoded"])

    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).alias("ids")
                     ).mapInArrow(run, "doc_id bigint, decoded string")
