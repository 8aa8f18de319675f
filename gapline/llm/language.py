"""Hierarchical language identification: the family first, then pairs of languages inside it.

Features are hashed character n-grams (1 to 3) of the whole lower-cased text, with runs of other
characters as one blank, as square roots scaled to length one. A linear support vector machine per family
(against the rest) names the family; inside it one-versus-one machines vote for the language.

Learning reads text and language of the rows it may learn from, about ROWS_PER_LANGUAGE of each
language, chosen by a hash of the id; the bound is a parameter. Each machine learns in a task of its
own from that sample. The learned weights number features x (families + pairs), whatever the rows,
and are held by every task.

Result of `identify`, one row per input row: doc_id, held_out, lang_pred, score. `und` with score 0 where
the text is null or has no letter, and where nothing was learned. Rows with a null id are never learned
from and count as not held out. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline.llm.bpe import LETTER, character_classes
from gapline.llm.common import mix, slices, tidy
from gapline.operators.scale import cut_lineage

UNKNOWN = "und"
FEATURE_BITS = 14
ROWS_PER_LANGUAGE = 2_000
EPOCHS = 6
BATCH = 32                        # rows of one learning step
DECAY = 1e-4                      # weight of the squared norm
SHARPNESS = 4.0                   # from margin to score
ROWS_AT_ONCE = 128                # dense feature rows in memory

# Languages of the larger families; any other language is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ast", "ca", "es", "fr", "gl", "it", "la", "oc", "pt", "rm", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("am", "ar", "he", "mt"),
}


def family_of(language: str) -> str:
    for name, members in FAMILIES.items():
        if language in members:
            return name
    return language


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-cased code point of every letter, a blank for all else."""
    out = np.full(0x110000, 0x20, np.uint64)
    for c in np.flatnonzero(character_classes() == LETTER).tolist():
        low = chr(c).lower()
        out[c] = ord(low) if len(low) == 1 else c
    return out


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of the texts, and whether each has a letter."""
    size = 1 << FEATURE_BITS
    n = len(texts)
    lengths = np.array([len(t) for t in texts], np.int64)
    row = np.repeat(np.arange(n), lengths)
    c = _letters()[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
    blank = c == 0x20
    lettered = np.bincount(row[~blank], minlength=n) > 0
    keep = np.ones(len(c), bool)
    if len(c):
        keep[1:] = ~(blank[1:] & blank[:-1] & (row[1:] == row[:-1]))
    c, row = c[keep], row[keep]
    counts = np.zeros(n * size, np.int64)
    gram = np.zeros(len(c), np.uint64)
    for order in range(1, 4):
        if len(c) < order:
            break
        gram = gram[:len(c) - order + 1] * np.uint64(0x110000) + c[order - 1:]
        inside = row[:len(gram)] == row[order - 1:]
        bucket = (mix(gram + np.uint64(order << 62)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
        counts += np.bincount((row[:len(gram)] * size + bucket)[inside], minlength=n * size)
    out = np.sqrt(counts.reshape(n, size).astype(np.float32))
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1e-9), lettered


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, size=1 << 20):
        for at in range(0, part.num_rows, ROWS_AT_ONCE):
            piece = part.slice(at, ROWS_AT_ONCE)
            x, lettered = features(piece.column(0).to_pylist())
            rows = np.flatnonzero(lettered)
            keys = [np.flatnonzero(x[r]).astype(np.int32) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [piece.column(1).take(pa.array(rows)), piece.column(2).take(pa.array(rows)),
                 pa.array([k.tobytes() for k in keys], pa.binary()),
                 pa.array([x[r, k].tobytes() for r, k in zip(rows, keys)], pa.binary())],
                names=["lang", "order", "at", "value"])


def _learn(group: pa.Table) -> pa.Table:
    """One machine by stochastic subgradients of the hinge loss, weights averaged."""
    group = group.sort_by([("order", "ascending"), ("lang", "ascending")])
    y = np.where(group.column("positive").to_numpy(zero_copy_only=False), 1.0, -1.0)
    rows = [(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32))
            for a, v in zip(group.column("at").to_pylist(), group.column("value").to_pylist())]
    n, size = len(rows), 1 << FEATURE_BITS
    share = {s: max(1, int((y == s).sum())) for s in (1.0, -1.0)}
    cost = np.array([n / (2 * share[s]) for s in y])         # both sides weigh the same
    w, b = np.zeros(size), 0.0
    w_sum, b_sum, steps = np.zeros(size), 0.0, 0
    order = np.random.default_rng(7)
    for epoch in range(EPOCHS):
        places = order.permutation(n)
        for k in range(0, n, BATCH):
            own = places[k:k + BATCH]
            rate = 1.0 / (DECAY * (steps + 1000))
            inside = [i for i in own if y[i] * (rows[i][1] @ w[rows[i][0]] + b) < 1]
            w *= 1 - rate * DECAY
            for i in inside:
                w[rows[i][0]] += rate * cost[i] * y[i] / len(own) * rows[i][1]
                b += 0.01 * rate * cost[i] * y[i] / len(own)
            steps += 1
            if epoch:
                w_sum += w
                b_sum += b
    done = max(1, steps - -(-n // BATCH))
    weights = np.append(w_sum, b_sum) / done
    return pa.table([group.column("machine")[:1],
                     pa.array([weights.astype(np.float32).tobytes()], pa.binary())],
                    names=["machine", "weights"])


class Model:
    """Languages and the weights of the machines."""

    def __init__(self, languages: list[str], weights: dict[str, np.ndarray]):
        self.languages = languages
        self.families = sorted({family_of(x) for x in languages})
        self.members = {f: [x for x in languages if family_of(x) == f] for f in self.families}
        self.names = sorted(weights)
        self.matrix = (np.stack([weights[n] for n in self.names], axis=1) if weights
                       else np.zeros(((1 << FEATURE_BITS) + 1, 0), np.float32))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        x, lettered = features(texts)
        margins = x @ self.matrix[:-1] + self.matrix[-1]
        column = {n: margins[:, i] for i, n in enumerate(self.names)}
        n = len(texts)
        if len(self.families) > 1:
            by_family = np.stack([column[f"family:{f}"] for f in self.families], axis=1)
            best = np.argmax(by_family, axis=1)
            top = np.sort(by_family, axis=1)
            sure = _sigmoid(top[:, -1] - top[:, -2])
        else:
            best, sure = np.zeros(n, np.int64), np.ones(n)
        out, score = [UNKNOWN] * n, [0.0] * n
        for k, f in enumerate(self.families):
            rows = np.flatnonzero((best == k) & lettered)
            members = self.members[f]
            votes = np.zeros((len(rows), len(members)))
            share = np.zeros((len(rows), len(members)))
            for a, b in combinations(range(len(members)), 2):
                m = column[f"pair:{members[a]}:{members[b]}"][rows]
                votes[:, a] += m >= 0
                votes[:, b] += m < 0
                share[:, a] += _sigmoid(m)
                share[:, b] += _sigmoid(-m)
            share = share / max(1, len(members) - 1) if len(members) > 1 else share + 1
            winner = np.argmax(votes + share / 2, axis=1)    # ties by the mean certainty
            for i, r in enumerate(rows.tolist()):
                out[r] = members[winner[i]]
                score[r] = float(min(1.0, sure[r] * share[i, winner[i]]))
        return out, score


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(SHARPNESS * x, -30, 30)))


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Fit on rows with a language that are not held out."""
    own = df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
                    F.xxhash64(id_col).alias("order")).filter(
        F.col(id_col).isNotNull() & ~held_out(F.col(id_col))
        & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in
              own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model([], {})
    languages = sorted(counts)
    # A row is taken if its hash falls in its language's share of the hash range.
    share = F.create_map(*[F.lit(v) for x in languages
                           for v in (x, min(1.0, rows_per_language / counts[x]))])
    taken = own.filter(F.pmod("order", F.lit(1 << 30)) < share[F.col("lang")] * float(1 << 30))
    sample = cut_lineage(taken.select("text", "lang", "order").mapInArrow(
        tidy(_sparse), "lang string, order bigint, at binary, value binary"))
    families = sorted({family_of(x) for x in languages})
    machines: list[tuple[str, str, bool]] = []               # machine, language, positive
    if len(families) > 1:
        machines += [(f"family:{f}", x, family_of(x) == f) for f in families for x in languages]
    for f in families:
        for a, b in combinations([x for x in languages if family_of(x) == f], 2):
            machines += [(f"pair:{a}:{b}", a, True), (f"pair:{a}:{b}", b, False)]
    if not machines:
        return Model(languages, {})
    tasks = df.sparkSession.createDataFrame(machines, "machine string, lang string, positive boolean")
    rows = (sample.join(F.broadcast(tasks), "lang").groupBy("machine")
            .applyInArrow(_learn, "machine string, weights binary").collect())
    weights = {r["machine"]: np.frombuffer(r["weights"], np.float32) for r in rows}
    full = np.zeros((1 << FEATURE_BITS) + 1, np.float32)
    return Model(languages, {m: weights.get(m, full) for m in {m for m, _, _ in machines}})


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, size=1 << 20):
            for at in range(0, part.num_rows, ROWS_AT_ONCE):
                piece = part.slice(at, ROWS_AT_ONCE)
                lang, score = held.value.predict(piece.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(lang, pa.string()),
                     pa.array(score, pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score"])

    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text")
                     ).mapInArrow(tidy(run), "doc_id bigint, held_out boolean, lang_pred string, score double")


def keep_identified(df: DataFrame, model: Model, min_score: float, text_col: str = "text") -> DataFrame:
    """The rows of any table, all columns as they are, whose language is known with `min_score` or more."""
    held = df.sparkSession.sparkContext.broadcast(model)
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col, 1 << 20):
            for at in range(0, part.num_rows, ROWS_AT_ONCE):
                piece = part.slice(at, ROWS_AT_ONCE)
                lang, score = held.value.predict([t or "" for t in piece.column(place).to_pylist()])
                yield piece.filter(pa.array([x != UNKNOWN and s >= min_score for x, s in zip(lang, score)]))

    return df.mapInArrow(tidy(run), df.schema)
