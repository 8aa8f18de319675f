"""Ranked lexical search that scores each bag of item words once.

1. The terms of the items are the vocabulary; other terms of a document change nothing but its length. One pass
   over the whole texts gives each document its length and its counts of vocabulary terms, packed as bytes, in the shared
   folder. Partial sums of it give the corpus numbers: documents, terms, and documents per vocabulary term.
2. A document's score depends on its counts and its length class m only. Documents of equal (counts, m) are a class:
   dealt by a hash of both and told apart by their bytes. A window keeps the `top` smallest ids of a class, in the map
   side first, so a task sends at most `top` rows of a class. Classes above HOT_ROWS are merged in HOT_PARTS parts first.
3. Each class is scored once against all items. A task expands the members of a class by ascending doc_id and keeps its
   best `top` documents of each item; windows over parts of the tasks, then over all, keep the best of all.

Scores are whole numbers: sums of w * ((10**9 * tf) div (1000 * tf + 20 * m)) over the distinct terms of an item, with
w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))) and m = 100 - 50 + ((50 * n * N) div L).

Items are the stated queries. They are taken in groups of about ITEM_BYTES of text, a pass over the corpus each, so
the vocabulary that a task holds is bounded however many there are.

Null text has no terms. Rows of one item_id are one item with the terms of all. Every row of documents is a document:
repeated rows count again and rank side by side, in no matter which order; a null id is the smallest. Items without
terms, and empty tables, give no rows. A document of any length is read whole, PIECE bytes at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapline.llm.common import NO_ID, id_array, ids_of, narrow
from gapline.operators.scale import cut_lineage

ITEM_BYTES = 32 << 20      # text of the items of one pass
PIECE = 1 << 20            # bytes of a text that are split at once
CELLS = 1 << 22            # scores that a task makes at once
HOT_ROWS = 1_000_000       # documents of a class that one window merges
HOT_PARTS = 256
MERGE_PARTS = 64           # parts in which an item's best rows are merged first
DOCS, TERMS = -1, -2       # places of N and L among the term numbers

# Lower-case letters for A-Z, blanks for all other ASCII but digits; bytes from 0x80 on are parts of terms.
_LETTERS = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(128)) + bytes(range(128, 256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of about PIECE bytes."""
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        part = text[at:end].translate(_LETTERS)
        while end < len(text) and b" " not in part[-64:]:       # a term must not be cut
            more = text[end:end + PIECE].translate(_LETTERS)
            stop = more.find(b" ")
            part += more if stop < 0 else more[:stop]
            end += len(more) if stop < 0 else stop
            if stop >= 0:
                break
        else:
            if end < len(text):
                keep = part.rfind(b" ")
                end -= len(part) - keep
                part = part[:keep]
        yield part.split()
        at = max(end, at + 1)


def _counted(vocabulary: dict[bytes, int]):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("bag", pa.binary())])

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            lengths, bags = [], []
            for text in texts:
                n, met = 0, Counter()
                for words in terms(text.as_py()):
                    n += len(words)
                    met.update(map(vocabulary.get, words))
                met.pop(None, None)
                pairs = np.array(sorted(met.items()), np.int64).reshape(-1, 2)
                lengths.append(n)
                bags.append(_packed(pairs))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(bags, pa.binary())],
                                             schema=schema)
    return run


def _packed(pairs: np.ndarray) -> bytes:
    """(term, count) pairs as bytes: a kind, then all terms, then all counts, as narrow as they go."""
    if not len(pairs):
        return b""
    kind = 2 if pairs.max() < 1 << 16 else 8
    return bytes([kind]) + pairs.T.astype(np.uint16 if kind == 2 else np.int64).tobytes()


def _unpacked(bag: bytes) -> np.ndarray:
    """(2, terms) numbers: terms and counts."""
    flat = np.frombuffer(bag, np.uint16 if bag[:1] == b"\x02" else np.int64, offset=1 if bag else 0)
    return flat.reshape(2, -1).astype(np.int64)


def _totals(size: int):
    """Per task: documents that hold a term, documents with terms, and all terms."""
    def run(batches):
        held, docs, count = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            n = batch.column(0).to_numpy()
            docs, count = docs + int((n > 0).sum()), count + int(n.sum())
            found = [_unpacked(b)[0] for b in batch.column(1).to_pylist() if b]
            if found:
                held += np.bincount(np.concatenate(found), minlength=size)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"place": np.concatenate([at, [DOCS, TERMS]]),
                                          "count": np.concatenate([held[at], [docs, count]])})
    return run


class _Items:
    """Items of one pass: for each vocabulary term the items that hold it."""

    def __init__(self, rows: list):
        held: dict[int, set[bytes]] = {}
        for row in rows:
            bag = held.setdefault(NO_ID if row.item_id is None else row.item_id, set())
            for words in terms(row.text.encode()):
                bag.update(words)
        self.ids = np.array(sorted(i for i in held if held[i]), np.int64)
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for bag in held.values() for w in bag}))}
        pairs = np.array([(self.vocabulary[w], k) for k, i in enumerate(self.ids.tolist()) for w in sorted(held[i])],
                         np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        self.items = pairs[:, 1]
        self.edges = np.searchsorted(pairs[:, 0], np.arange(len(self.vocabulary) + 1))


class _Best:
    """The best documents of every item so far."""

    def __init__(self, n_items: int, top: int):
        self.top, self.parts, self.held = top, [], 0
        self.least = np.zeros(n_items, np.int64)           # a score below cannot be among the best; 0 never counts
        self.full = np.zeros(n_items, bool)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        self.parts.append((item, score, doc))
        self.held += len(item)
        if self.held > max(1 << 18, 4 * self.top * len(self.least)):
            self.prune()

    def prune(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return (np.zeros(0, np.int64),) * 3
        item, score, doc = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        last = place == self.top - 1
        self.least[item[last]] = score[last]
        kept = place < self.top
        self.parts, self.held = [(item[kept], score[kept], doc[kept])], int(kept.sum())
        return self.parts[0]


def _scored(items: _Items, weights: np.ndarray, top: int):
    rows_at_once = max(1, CELLS // max(len(items.ids), 1))
    sums_fit = np.float64 if float(weights.sum()) * 1e6 < 2 ** 53 else None

    def scores(bags: list[bytes], m: np.ndarray) -> np.ndarray:
        """(classes, items)."""
        sheets = [_unpacked(b) for b in bags]
        row = np.repeat(np.arange(len(bags)), [s.shape[1] for s in sheets])
        term, tf = np.concatenate(sheets, axis=1)
        value = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
        out = np.zeros(len(bags) * len(items.ids), np.int64)
        holders = items.edges[term + 1] - items.edges[term]
        cut = np.searchsorted(np.cumsum(holders), np.arange(CELLS, holders.sum() + CELLS, CELLS), "right")
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(term)]):
            if a < b:
                size = holders[a:b]
                start = np.repeat(items.edges[term[a:b]] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
                cell = np.repeat(row[a:b], size) * len(items.ids) + items.items[start + np.arange(size.sum())]
                if sums_fit is None:
                    np.add.at(out, cell, np.repeat(value[a:b], size))
                else:                                       # whole numbers below 2**53 add exactly in doubles
                    out += np.bincount(cell, np.repeat(value[a:b], size), len(out)).astype(np.int64)
        return out.reshape(len(bags), -1)

    def run(batches):
        best = _Best(len(items.ids), top)
        for batch in batches:
            m, bags, members = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
            for a in range(0, batch.num_rows, rows_at_once):
                part = slice(a, a + rows_at_once)
                s = scores(bags[part].to_pylist(), m[part])
                row, item = np.nonzero((s > 0) & (s >= best.least))
                docs = members[part]
                ids = docs.flatten().fill_null(NO_ID).to_numpy(zero_copy_only=False)
                edges = docs.offsets.to_numpy().astype(np.int64)
                edges -= edges[0]
                size = (edges[1:] - edges[:-1])[row]
                first = np.repeat(edges[row] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) if len(row) else row
                best.add(np.repeat(item, size), np.repeat(s[row, item], size), ids[first + np.arange(size.sum())])
        item, score, doc = best.prune()
        yield pa.RecordBatch.from_arrays([id_array(items.ids[item]), pa.array(score), id_array(doc)],
                                         ["item_id", "score", "doc_id"])
    return run


def _classes(counted: DataFrame, docs: int, count: int, top: int, hot_rows: int) -> DataFrame:
    """(m, bag, members): one row per class with its `top` smallest ids, ascending."""
    m = F.expr(f"50 + ((50L * n * {docs}L) div {max(count, 1)}L)")
    keyed = counted.filter(F.length("bag") > 0).select("doc_id", m.alias("m"), "bag").withColumn(
        "mark", F.xxhash64("bag", "m"))
    key = ["mark", "m", "bag"]

    def first(df: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(F.col("doc_id").asc_nulls_first())
        return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)

    hot = [r.mark for r in keyed.groupBy("mark").count().filter(F.col("count") > hot_rows).select("mark").collect()]
    kept = first(keyed.filter(~F.col("mark").isin(hot)) if hot else keyed, *key)
    if hot:
        parted = keyed.filter(F.col("mark").isin(hot)).withColumn(
            "part", F.pmod(F.spark_partition_id(), F.lit(HOT_PARTS)))
        kept = kept.unionByName(first(first(parted, *key, "part").drop("part", "place"), *key))
    pair = F.struct("place", "doc_id")
    return kept.groupBy(*key).agg(F.sort_array(F.collect_list(pair)).alias("members")).select(
        "m", "bag", F.col("members.doc_id").alias("members"))


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = [F.desc("score"), F.col("doc_id").asc_nulls_first()]
    part = Window.partitionBy("item_id", "part").orderBy(*order)
    whole = Window.partitionBy("item_id").orderBy(*order)
    some = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGE_PARTS)))
    some = some.withColumn("place", F.row_number().over(part)).filter(F.col("place") <= top)
    return some.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= top).select(
        "item_id", "rank", "doc_id", "score")


def search(items: DataFrame, docs: DataFrame, top: int = 50, item_bytes: int = ITEM_BYTES,
           hot_rows: int = HOT_ROWS) -> DataFrame:
    """item_id, rank, doc_id, score of the `top` best documents of each item."""
    asked = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = total // item_bytes + 1
    texts, out = narrow(docs), None
    for k in range(passes):
        chosen = _Items(asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).collect())
        found = _ranked(_one_pass(chosen, texts, top, hot_rows), top)
        out = found if out is None else out.unionByName(found)
    return out


def _one_pass(items: _Items, texts: DataFrame, top: int, hot_rows: int) -> DataFrame:
    size = len(items.vocabulary)
    counted = cut_lineage(texts.mapInArrow(_counted(items.vocabulary), "doc_id bigint, n bigint, bag binary"))
    sums = counted.select("n", "bag").mapInArrow(_totals(size), "place bigint, count bigint").groupBy("place").agg(
        F.sum("count").alias("count"))
    total = dict((r.place, r["count"]) for r in sums.collect())
    docs = total.get(DOCS, 0)
    held = np.zeros(size, np.int64)
    for place, n in total.items():
        if place >= 0:
            held[place] = n
    weights = np.floor(1000 * np.log((2.0 * docs + 2) / (2.0 * held + 1))).astype(np.int64)
    classes = _classes(counted, docs, total.get(TERMS, 0), top, hot_rows)
    return classes.mapInArrow(_scored(items, weights, top), "item_id bigint, score bigint, doc_id bigint")
