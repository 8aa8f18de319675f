"""Forests of bagged regression trees, grown where their rows are.

MLlib grows all nodes of a level by histograms that every task holds and sends, also where a node has three
rows, and keeps a count per row and tree. Here only nodes above `LOCAL_ROWS` are split by histograms over all
tasks. The rows of a smaller node travel once, as blocks of feature codes, to one task that ends its subtree.
The nodes come to the driver as arrays if a model is asked for, and not at all for importances.

As in MLlib a feature has at most `bins` values (its quantiles over all rows, or all values if they are no more),
a tree takes each row a Poisson number of times, a node splits where the squared error falls most, and every side
keeps at least `min_leaf` rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.operators.scale import cut_lineage

LOCAL_ROWS = 1_000_000    # bagged rows of a node whose subtree one task grows, about 150 bytes each
DEALT_BYTES = 8 << 30     # blocks of rows that travel to their subtrees at a time, about
FINE = 1_000              # quantiles among which the values of a feature are looked for
LEAST_GAIN = 1e-10        # a split lowers the squared error by more, in units of the variance of all targets

# How often a tree takes a row: a Poisson number of mean 1 for each of 65,536 equal shares.
TIMES = np.repeat(np.arange(9, dtype=np.uint8), np.diff(np.round(65536 * np.cumsum(
    [0.0, *(math.exp(-1) / math.factorial(i) for i in range(8)), 1.0]).clip(0, 1)).astype(np.int64)))

NODES = "tree int, node int, feature binary, cut binary, left binary, value binary"


def _codes(rows: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bins of every feature, one row of the result per feature."""
    return np.stack([np.searchsorted(c, rows[:, f]) for f, c in enumerate(cuts)]).astype(np.uint8)


def _best_splits(weight: np.ndarray, total: np.ndarray, min_leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """(gain, last bin on the left) per node, from its rows and sums per bin (nodes x bins); -inf without a split."""
    left, part = weight.cumsum(1), total.cumsum(1)
    rows, whole = left[:, -1:], part[:, -1:]
    left, part = left[:, :-1], part[:, :-1]
    right = rows - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = part ** 2 / left + (whole - part) ** 2 / right - whole ** 2 / rows
    gain[(left < max(min_leaf, 1)) | (right < max(min_leaf, 1))] = -np.inf
    best = gain.argmax(1)
    return gain[np.arange(len(best)), best], best


def _chosen(rng: np.random.Generator, nodes: int, features: int, tries: int) -> np.ndarray:
    """Which features each node may split by (nodes x features)."""
    if tries >= features:
        return np.ones((nodes, features), bool)
    return rng.random((nodes, features)).argsort(1).argsort(1) < tries


def _take_best(found: Iterator[tuple[np.ndarray, np.ndarray]], allowed: np.ndarray):
    """(gain, feature or -1, cut) of the best split per node; equal gains go to the first feature."""
    nodes = len(allowed)
    best, feature, cut = np.full(nodes, LEAST_GAIN), np.full(nodes, -1, np.int16), np.zeros(nodes, np.uint8)
    for f, (gain, place) in enumerate(found):
        better = allowed[:, f] & (gain > best * (1 + 1e-9))
        best[better], feature[better], cut[better] = gain[better], f, place[better]
    return best, feature, cut


def grow(codes: np.ndarray, target: np.ndarray, weight: np.ndarray, *, depth: int, min_leaf: int, bins: int,
         tries: int, rng: np.random.Generator):
    """Arrays feature (-1: leaf), cut, left child (the right one follows it) and value of a subtree, and the gain
    per feature. `codes` has a row per feature."""
    features = len(codes)
    weight = weight.astype(np.float64)
    total = weight * target
    square = total * target
    kept, node = np.arange(len(target)), np.zeros(len(target), np.int64)
    names, size = np.zeros(1, np.int64), 1
    parts, gains = [], np.zeros(features)
    for level in range(depth + 1):
        n = len(names)
        rows, sums = np.bincount(node, weight, n), np.bincount(node, total, n)
        feature, cut, left = np.full(n, -1, np.int16), np.zeros(n, np.uint8), np.zeros(n, np.int32)
        parts.append((names, feature, cut, left, sums / rows))
        wide = (rows >= 2 * min_leaf) & (np.bincount(node, square, n) - sums ** 2 / rows > LEAST_GAIN)
        if level == depth or not wide.any():
            break
        place = np.cumsum(wide) - 1
        stay = wide[node]
        kept, node, weight, total, square = kept[stay], place[node[stay]], weight[stay], total[stay], square[stay]
        m, codes_now = int(wide.sum()), codes[:, kept]

        allowed = _chosen(rng, m, features, tries)

        def candidates():
            for f in range(features):
                mine = slice(None) if tries >= features else np.flatnonzero(allowed[node, f])
                key = node[mine] * bins + codes_now[f][mine]
                yield _best_splits(np.bincount(key, weight[mine], m * bins).reshape(m, bins),
                                   np.bincount(key, total[mine], m * bins).reshape(m, bins), min_leaf)

        gain, by, at = _take_best(candidates(), allowed)
        split = by >= 0
        np.add.at(gains, by[split], gain[split])
        born = size + 2 * (np.cumsum(split) - 1)
        feature[wide], cut[wide] = by, at
        left[wide] = np.where(split, born, 0)
        stay = split[node]
        kept, node, weight, total, square = kept[stay], node[stay], weight[stay], total[stay], square[stay]
        side = codes[by[node], kept] > at[node]
        node = 2 * (np.cumsum(split) - 1)[node] + side
        names = np.arange(size, size + 2 * int(split.sum()))
        size += len(names)
        if not len(names):
            break
    return (*(np.concatenate([p[i] for p in parts]) for i in range(1, 5)), gains)


@dataclass
class _Tree:
    """Nodes as lists of equal length, as `grow` gives them."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def place(self, codes: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        at = np.zeros(codes.shape[1], np.int64)
        rows = np.arange(codes.shape[1])
        while len(rows):
            here = at[rows]
            by = self.feature[here]
            rows, here, by = rows[by >= 0], here[by >= 0], by[by >= 0]
            at[rows] = self.left[here] + (codes[by, rows] > self.cut[here])
        return at

    def graft(self, parts: dict[int, _Tree]) -> _Tree:
        """The tree with subtrees in the place of leaves."""
        feature, cut, left, value = ([a.copy()] for a in (self.feature, self.cut, self.left, self.value))
        size = len(self.feature)
        for node, sub in parts.items():
            moved = np.where(sub.feature >= 0, sub.left + size - 1, 0).astype(np.int32)
            for whole, own in ((feature, sub.feature), (cut, sub.cut), (left, moved), (value, sub.value)):
                whole[0][node] = own[0]
                whole.append(own[1:])
            size += len(sub.feature) - 1
        return _Tree(*map(np.concatenate, (feature, cut, left, value)))


def tries_of(subset: str, features: int) -> int:
    """Features that a node may split by."""
    named = {"all": features, "auto": -(-features // 3), "onethird": -(-features // 3),
             "sqrt": math.ceil(math.sqrt(features)), "log2": max(1, math.ceil(math.log2(features)))}
    if subset in named:
        return named[subset]
    share = float(subset)
    return max(1, min(features, math.ceil(share * features) if "." in subset else int(share)))


def bin_cuts(values: DataFrame, features: int, bins: int) -> list[np.ndarray]:
    """Upper ends of all but the last bin of each feature of the arrays `x`."""
    columns = [f"f{f}" for f in range(features)]
    found = values.select(*[F.col("x")[f].alias(c) for f, c in enumerate(columns)]).approxQuantile(
        columns, [i / FINE for i in range(FINE + 1)], 0.1 / FINE)
    cuts = []
    for values_of in found:
        fine = np.array(values_of, np.float64)
        steps = np.unique(fine)
        if len(steps) > bins:
            steps = np.append(np.unique(fine[[i * FINE // bins for i in range(1, bins)]]), np.inf)
            cuts.append(steps[:-1])
        else:
            cuts.append((steps[:-1] + steps[1:]) / 2)
    return cuts


def _open_tree() -> _Tree:
    return _Tree(np.full(1, -1, np.int16), np.zeros(1, np.uint8), np.zeros(1, np.int32), np.zeros(1))


def _binary(values: Sequence[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


@dataclass
class Forest:
    """An estimator like MLlib's RandomForestRegressor, fitted on its feature vector and label."""

    features: str
    label: str
    trees: int
    depth: int
    min_leaf: int
    bins: int
    subset: str
    seed: int
    local_rows: int | None = None

    def fit(self, rows: DataFrame) -> ForestModel:
        """All nodes come to the driver: at most 2^(depth + 1), or twice the rows, of 15 bytes per tree."""
        grown = self._grow(rows)
        parts: dict[int, dict[int, _Tree]] = {}
        for r in grown.rows.select("tree", "node", "feature", "cut", "left", "value").collect():
            parts.setdefault(r["tree"], {})[r["node"]] = _Tree(
                np.frombuffer(r["feature"], np.int16), np.frombuffer(r["cut"], np.uint8),
                np.frombuffer(r["left"], np.int32), np.frombuffer(r["value"], np.float64))
        whole = [top.graft(parts.get(t, {})) for t, top in enumerate(grown.tops)]
        for tree in whole:
            tree.value = grown.mean + grown.deviation * tree.value
        return ForestModel(self.features, grown.cuts, whole, self._shares(grown))

    def importances(self, rows: DataFrame) -> DenseVector:
        """Importances of the features; the nodes stay with the executors."""
        return DenseVector(self._shares(self._grow(rows)))

    def _shares(self, grown: _Grown) -> np.ndarray:
        """Share of each feature in the gain of a tree, averaged over the trees that split."""
        gains = grown.gains.copy()
        k = len(grown.cuts)
        for r in grown.rows.groupBy("tree").agg(*[F.sum(F.col("gain")[f]).alias(f"g{f}") for f in range(k)]).collect():
            gains[r["tree"]] += [r[f"g{f}"] for f in range(k)]
        sums = gains.sum(1, keepdims=True)
        shares = (gains / np.where(sums > 0, sums, 1)).sum(0)
        return shares / (shares.sum() or 1.0)

    def tries(self, features: int) -> int:
        return tries_of(self.subset, features)

    def _bag(self, block: bytes, tree: int, rows: int) -> np.ndarray:
        """How often a tree takes each row of a block; the same in every pass."""
        return TIMES[np.random.default_rng([self.seed, tree, zlib.crc32(block)]).integers(0, 65536, rows, np.uint16)]

    def _grow(self, rows: DataFrame) -> _Grown:
        values = rows.select(vector_to_array(F.col(self.features)).alias("x"), F.col(self.label).alias("y"))
        seen = values.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("sd"),
                          F.max(F.size("x")).alias("k")).first()
        if not seen["n"]:
            raise ValueError("a forest needs rows to learn from")
        k, mean, deviation = seen["k"], seen["mean"], seen["sd"] or 1.0
        cuts = bin_cuts(values, k, self.bins)
        bins = max(2, max(len(c) for c in cuts) + 1)

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                y = (b.column(1).to_numpy(zero_copy_only=False) - mean) / deviation
                yield pa.RecordBatch.from_arrays([_binary([_codes(x, cuts).tobytes()]), _binary([y.tobytes()])],
                                                 ["codes", "y"])

        # A row holds a block of rows, so that a pass moves few rows between Spark and Python.
        blocks = cut_lineage(values.mapInArrow(coded, "codes binary, y binary"))
        tops, gains = self._tops(blocks, seen["n"], k, bins)
        at_once = max(1, int(DEALT_BYTES // (seen["n"] * (k + 9))))
        parts = [self._subtrees(blocks, tops, k, bins, range(a, min(a + at_once, self.trees)))
                 for a in range(0, self.trees, at_once)]
        return _Grown(reduce(DataFrame.unionByName, parts), tops, gains, cuts, mean, deviation)

    def _tops(self, blocks: DataFrame, n: int, k: int, bins: int) -> tuple[list[_Tree], np.ndarray]:
        """The nodes above `local_rows`, split level by level; their children are leaves so far."""
        limit = LOCAL_ROWS if self.local_rows is None else self.local_rows
        tops, gains = [_open_tree() for _ in range(self.trees)], np.zeros((self.trees, k))
        wanted = {t: np.zeros(1, np.int64) for t in range(self.trees)} if n > limit else {}
        shared = blocks.sparkSession.sparkContext
        for level in range(self.depth):
            if not wanted:
                break
            state = shared.broadcast(({t: tops[t] for t in wanted}, wanted))
            bag = self._bag

            def choice(tree: int, nodes: int) -> np.ndarray:
                return _chosen(np.random.default_rng([self.seed, tree, 1, level]), nodes, k, self.tries(k))

            def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                trees, nodes = state.value
                sums = {t: np.zeros((2, k, len(nodes[t]) * bins)) for t in nodes}
                allowed = {t: choice(t, len(nodes[t])) for t in nodes}
                for b in batches:
                    for block, target in zip(*(c.to_pylist() for c in b.columns)):
                        y = np.frombuffer(target)
                        codes = np.frombuffer(block, np.uint8).reshape(k, -1)
                        for t, tree in trees.items():
                            w = bag(block, t, len(y))
                            slot = np.full(len(tree.feature), -1)
                            slot[nodes[t]] = np.arange(len(nodes[t]))
                            at = slot[tree.place(codes)]
                            rows = np.flatnonzero((at >= 0) & (w > 0))
                            at, w, wy = at[rows], w[rows].astype(np.float64), (w * y)[rows]
                            for f in range(k):
                                mine = slice(None) if allowed[t].all() else np.flatnonzero(allowed[t][at, f])
                                key = at[mine] * bins + codes[f, rows[mine]]
                                sums[t][0, f] += np.bincount(key, w[mine], sums[t].shape[2])
                                sums[t][1, f] += np.bincount(key, wy[mine], sums[t].shape[2])
                for t, s in sums.items():
                    yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), _binary([s.tobytes()])],
                                                     ["tree", "sums"])

            def choose(key, batches):
                t = key[0].as_py()
                s = sum(np.frombuffer(b) for b in batches.column("sums").to_pylist())
                nodes = state.value[1][t]
                s = s.reshape(2, k, len(nodes), bins)
                gain, by, at = _take_best((_best_splits(s[0, f], s[1, f], self.min_leaf) for f in range(k)),
                                          choice(t, len(nodes)))
                left = np.array([s[0, max(f, 0), i, :c + 1].sum() for i, (f, c) in enumerate(zip(by, at))])
                whole = np.array([s[0, max(f, 0), i].sum() for i, f in enumerate(by)])
                return pa.table({"tree": pa.array([t] * len(nodes), pa.int32()), "node": pa.array(nodes),
                                 "feature": pa.array(by.astype(np.int32)), "cut": pa.array(at.astype(np.int32)),
                                 "gain": pa.array(gain), "left": pa.array(left),
                                 "right": pa.array(whole - left)})

            found = blocks.mapInArrow(count, "tree int, sums binary").groupBy("tree").applyInArrow(
                choose, "tree int, node bigint, feature int, cut int, gain double, left double, right double")
            following: dict[int, list[int]] = {}
            for r in sorted(found.collect(), key=lambda r: (r["tree"], r["node"])):
                if r["feature"] < 0:
                    continue
                top, node = tops[r["tree"]], r["node"]
                size = len(top.feature)
                top.feature[node], top.cut[node], top.left[node] = r["feature"], r["cut"], size
                for part, new in (("feature", -1), ("cut", 0), ("left", 0), ("value", 0.0)):
                    old = getattr(top, part)
                    setattr(top, part, np.append(old, [new, new]).astype(old.dtype))
                gains[r["tree"], r["feature"]] += r["gain"]
                following.setdefault(r["tree"], []).extend(
                    size + i for i, rows in enumerate((r["left"], r["right"])) if rows > limit)
            state.unpersist()
            wanted = {t: np.array(nodes) for t, nodes in following.items() if nodes}
        return tops, gains

    def _subtrees(self, blocks: DataFrame, tops: Sequence[_Tree], k: int, bins: int, trees: range) -> DataFrame:
        """A row per leaf of these upper trees: its subtree and gains, grown from all rows that reach it."""
        context = blocks.sparkSession.sparkContext
        state = context.broadcast(list(tops))
        bag = self._bag

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for block, target in zip(*(c.to_pylist() for c in b.columns)):
                    y = np.frombuffer(target)
                    codes = np.frombuffer(block, np.uint8).reshape(k, -1)
                    for t in trees:
                        w = bag(block, t, len(y))
                        at = state.value[t].place(codes)
                        order = np.argsort(at, kind="stable")
                        order = order[w[order] > 0]
                        names, first = np.unique(at[order], return_index=True)
                        parts = np.split(order, first[1:]) if len(names) else []
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([t] * len(parts), pa.int32()), pa.array(names.astype(np.int32)),
                             _binary([codes[:, p].tobytes() for p in parts]), _binary([y[p].tobytes() for p in parts]),
                             _binary([w[p].astype(np.uint8).tobytes() for p in parts])],
                            ["tree", "node", "codes", "y", "weight"])

        def finish(key, table):
            t, node = (v.as_py() for v in key)
            column = lambda name, kind: [np.frombuffer(v, kind) for v in table.column(name).to_pylist()]
            top, depth, above = state.value[t], self.depth, node
            while above:          # the levels that are spent already
                depth, above = depth - 1, int(np.flatnonzero((top.feature >= 0) & (
                    (top.left == above) | (top.left + 1 == above)))[0])
            feature, cut, left, value, gains = grow(
                np.concatenate([c.reshape(k, -1) for c in column("codes", np.uint8)], 1),
                np.concatenate(column("y", np.float64)), np.concatenate(column("weight", np.uint8)),
                depth=depth, min_leaf=self.min_leaf, bins=bins, tries=self.tries(k),
                rng=np.random.default_rng([self.seed, t, 2, node]))
            return pa.table({"tree": pa.array([t], pa.int32()), "node": pa.array([node], pa.int32()),
                             "feature": _binary([feature.tobytes()]), "cut": _binary([cut.tobytes()]),
                             "left": _binary([left.astype(np.int32).tobytes()]), "value": _binary([value.tobytes()]),
                             "gain": pa.array([gains.tolist()], pa.list_(pa.float64()))})

        nodes = sum(int((tops[t].feature < 0).sum()) for t in trees)
        tasks = max(1, min(nodes, max(3 * context.defaultParallelism, nodes // 16)))
        dealt = blocks.mapInArrow(deal, "tree int, node int, codes binary, y binary, weight binary")
        grown = dealt.repartition(tasks, "tree", "node").groupBy("tree", "node").applyInArrow(
            finish, f"{NODES}, gain array<double>")
        return cut_lineage(grown)


@dataclass
class _Grown:
    rows: DataFrame
    tops: list[_Tree]
    gains: np.ndarray
    cuts: list[np.ndarray]
    mean: float
    deviation: float


class ForestModel(Model, MLWritable, MLReadable):
    """The mean of the trees, predicted from the feature vector."""

    averaged = True

    def __init__(self, features: str = "features", cuts: Sequence[np.ndarray] = (), trees: Sequence[_Tree] = (),
                 importances: Sequence[float] = ()):
        super().__init__()
        self.features, self.cuts, self.trees = features, list(cuts), list(trees)
        self.featureImportances = DenseVector(importances)
        self._shared = None

    @property
    def getNumTrees(self) -> int:
        return len(self.trees)

    def _transform(self, df: DataFrame) -> DataFrame:
        if self._shared is None:
            self._shared = df.sparkSession.sparkContext.broadcast((self.cuts, self.trees))
        shared, averaged = self._shared, self.averaged

        @F.pandas_udf("double")
        def mean(vectors: pd.Series) -> pd.Series:
            cuts, trees = shared.value
            if not len(vectors):
                return pd.Series([], dtype="float64")
            codes = _codes(np.stack(vectors.to_numpy()), cuts)
            out = np.zeros(len(vectors))
            for tree in trees:
                out += tree.value[tree.place(codes)]
            return pd.Series(out / len(trees) if averaged else out)

        return df.withColumn("prediction", mean(vector_to_array(F.col(self.features))))

    def copy(self, extra=None) -> ForestModel:
        return type(self)(self.features, self.cuts, self.trees, self.featureImportances.toArray())

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader(cls)


class _ForestWriter(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m, spark = self.model, SparkSession.active()
        DefaultParamsWriter.saveMetadata(m, path, spark, paramMap={"features": m.features})
        spark.createDataFrame([(i, *(bytes(a.tobytes()) for a in (t.feature, t.cut, t.left, t.value)))
                               for i, t in enumerate(m.trees)],
                              "tree int, feature binary, cut binary, left binary, value binary").write.parquet(
            f"{path}/trees")
        spark.createDataFrame([(i, c.tolist(), float(m.featureImportances[i])) for i, c in enumerate(m.cuts)],
                              "feature int, cuts array<double>, importance double").write.parquet(f"{path}/features")


class _ForestReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> ForestModel:
        spark = SparkSession.active()
        info = DefaultParamsReader.loadMetadata(path, spark)
        rows = spark.read.parquet(f"{path}/features").orderBy("feature").collect()
        trees = [_Tree(np.frombuffer(r["feature"], np.int16), np.frombuffer(r["cut"], np.uint8),
                       np.frombuffer(r["left"], np.int32), np.frombuffer(r["value"], np.float64))
                 for r in spark.read.parquet(f"{path}/trees").orderBy("tree").collect()]
        model = self.cls(info["paramMap"]["features"], [np.array(r["cuts"], np.float64) for r in rows], trees,
                         [r["importance"] for r in rows])
        return model._resetUid(info["uid"])
