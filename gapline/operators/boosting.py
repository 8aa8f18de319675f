"""Boosted regression trees, all rounds in one Spark job.

MLlib takes a job per level of every round. Here tasks hold their rows as feature codes for all rounds. A table of up
to `TASK_ROWS` rows is one task's; of a larger one the tasks of a barrier stage exchange, for every level, row counts and
sums per node, feature and bin, and each takes the same splits from them. Rows stay in their tasks; what travels is
bounded by nodes, features and bins, for the smaller child of every split (the other's are the rest). Spark answers an
exchange after a second, which pays only for rows that take a task longer than that for a level. So tasks exchange by
files in the checkpoint folder where that is a mounted one, and a task then takes no more than `FILE_ROWS` rows.

The rules are MLlib's: the first tree learns the target, later ones the negative gradient and count `step`;
a feature has at most `BINS` values; of rows held back the error ends the rounds.
"""

from __future__ import annotations

import base64
import os
import re
import shutil
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, SparkContext, TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.operators.scale import checkpoint_folder
from gapline.operators.trees import (ForestModel, _best_splits, _binary, _chosen, _codes, _take_best, _Tree, bin_cuts,
                                     tries_of)

BINS = 32
TASK_ROWS = 1_000_000     # rows that one task learns from, about 100 bytes each
FILE_ROWS = 100_000       # the same where tasks exchange by files
PATIENCE = 10.0           # seconds until a file that another task has written must be seen
MESSAGE_BYTES = 1 << 20   # of a task, exchanged at a time

# Adds up arrays of the tasks; the same result in each.
Together = Callable[[np.ndarray], np.ndarray]


def _draws(names: np.ndarray, seed: int) -> np.ndarray:
    """A number from 0 to 1 per row, the same whichever task holds it."""
    with np.errstate(over="ignore"):
        x = names ^ (np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(np.float64) / 2.0 ** 53


def _counts(codes: np.ndarray, rows: np.ndarray, node: np.ndarray, target: np.ndarray, nodes: int,
            bins: int) -> np.ndarray:
    """Rows and sums of the target: 2 x nodes x features x bins."""
    base, mine = node * bins, target[rows]
    out = np.empty((2, nodes, len(codes), bins))
    for f in range(len(codes)):
        key = base + codes[f][rows]
        out[0, :, f] = np.bincount(key, minlength=nodes * bins).reshape(nodes, bins)
        out[1, :, f] = np.bincount(key, mine, nodes * bins).reshape(nodes, bins)
    return out


def grow_together(codes: np.ndarray, target: np.ndarray, bag: np.ndarray, together: Together, *, depth: int, bins: int,
                  tries: int, rng: np.random.Generator) -> tuple[_Tree, np.ndarray, np.ndarray]:
    """A tree from the rows in the bag of all tasks, its gain per feature, and the node of every own row."""
    features = len(codes)
    at, gains = np.zeros(len(target), np.int64), np.zeros(features)
    by_node, cut_node, left_node, values = [np.full(1, -1, np.int16)], [np.zeros(1, np.uint8)], [np.zeros(1, np.int32)], []
    kept, slot = np.arange(len(target)), np.zeros(len(target), np.int64)
    names, size, above, small = np.zeros(1, np.int64), 1, None, None
    for level in range(depth):
        m = len(names)
        if above is None:
            sums = together(_counts(codes, kept[bag], slot[bag], target, 1, bins))
            rows = sums[0, 0, 0].sum()
            values.append(np.array([sums[1, 0, 0].sum() / rows if rows else 0.0]))
        else:
            counted = bag[kept] & (small[slot >> 1] == (slot & 1))
            found = together(_counts(codes, kept[counted], slot[counted] >> 1, target, m // 2, bins))
            sums = np.empty((2, m, features, bins))
            pair = 2 * np.arange(m // 2)
            sums[:, pair + small], sums[:, pair + 1 - small] = found, above - found
        gain, by, cut = _take_best((_best_splits(sums[0, :, f], sums[1, :, f], 1) for f in range(features)),
                                   _chosen(rng, m, features, tries))
        split = np.flatnonzero(by >= 0)
        if not len(split):
            break
        np.add.at(gains, by[split], gain[split])
        own = sums[:, split, by[split]]                                   # 2 x splits x bins
        low = np.where(np.arange(bins) <= cut[split, None], own, 0.0).sum(2)
        high = own.sum(2) - low
        born = size + 2 * np.arange(len(split))
        for parts, name, new in ((by_node, names[split], by[split]), (cut_node, names[split], cut[split]),
                                 (left_node, names[split], born)):
            whole = np.concatenate(parts)
            whole[name] = new
            parts[:] = [whole, np.full(2 * len(split), -1 if parts is by_node else 0, whole.dtype)]
        values.append(np.stack([low[1] / low[0], high[1] / high[0]], 1).ravel())
        above, small = sums[:, split], (low[0] > high[0]).astype(np.int64)
        place = np.full(m, -1)
        place[split] = np.arange(len(split))
        stay = by[slot] >= 0
        kept, slot = kept[stay], slot[stay]
        slot = 2 * place[slot] + (codes[by[slot], kept] > cut[slot])
        names = np.arange(size, size + 2 * len(split))
        at[kept] = names[slot]
        size += len(names)
    return _Tree(*(np.concatenate(p) for p in (by_node, cut_node, left_node)), np.concatenate(values)), gains, at


def boost(codes: np.ndarray, target: np.ndarray, names: np.ndarray, held: np.ndarray, together: Together, *, loss: str,
          rounds: int, depth: int, step: float, share: float, tries: int, bins: int, seed: int, tolerance: float,
          unit: float) -> tuple[list[_Tree], list[np.ndarray]]:
    """Trees, values times their step, and gains per tree. `names` are 64-bit hashes of the rows; `unit` is what 1
    of the target stands for, as the tolerance counts errors below 0.01 as 0.01."""
    guess = np.zeros(len(target))
    trees, gains = [], []
    best, best_trees = np.inf, 0
    for r in range(rounds):
        left = target - guess
        goal = target if r == 0 else 2 * left if loss == "squared" else np.where(left < 0, -1.0, 1.0)
        bag = ~held & (_draws(names, seed + r) < share)
        tree, gain, at = grow_together(codes, goal, bag, together, depth=depth, bins=bins, tries=tries,
                                       rng=np.random.default_rng([seed, r]))
        if r:
            tree.value = tree.value * step
        trees.append(tree)
        gains.append(gain)
        guess += tree.value[at]
        off = (target - guess)[held]
        n, total = together(np.array([len(off), (off ** 2).sum() if loss == "squared" else np.abs(off).sum()]))
        if not n:                      # nothing is held back: all rounds run
            best_trees = r + 1
            continue
        error = total / n * (unit ** 2 if loss == "squared" else unit)
        if r and best - error < tolerance * max(error, 0.01):
            break
        if error < best:
            best, best_trees = error, r + 1
    return trees[:best_trees], gains[:best_trees]


def _all_gather() -> Together:
    """The sum over the tasks of this barrier stage, in the order of their numbers."""
    context = BarrierTaskContext.get()

    def add(own: np.ndarray) -> np.ndarray:
        flat, out = own.ravel(), np.empty(own.size)
        for a in range(0, len(flat), MESSAGE_BYTES // 8):
            part = base64.b64encode(flat[a:a + MESSAGE_BYTES // 8].tobytes()).decode("ascii")
            out[a:a + MESSAGE_BYTES // 8] = sum(np.frombuffer(base64.b64decode(p)) for p in context.allGather(part))
        return out.reshape(own.shape)
    return add


def _by_files(folder: str | None) -> Together:
    """As `_all_gather`, by files in a folder that all tasks see; Spark's own exchange where one does not see it."""
    if folder is None:
        return _all_gather()
    context = BarrierTaskContext.get()
    own_number, tasks = context.partitionId(), len(context.getTaskInfos())
    # A folder of this attempt's own.
    place = os.path.join(folder, context.allGather(uuid.uuid4().hex)[0])
    name = lambda step, task: os.path.join(place, f"{step}-{task}")

    def put(step: int, content: bytes) -> None:
        with open(name(step, own_number) + ".part", "wb") as out:
            out.write(content)
        os.rename(name(step, own_number) + ".part", name(step, own_number))

    def get(step: int, task: int, until: float = np.inf) -> bytes:
        while True:
            try:
                with open(name(step, task), "rb") as file:
                    return file.read()
            except FileNotFoundError:
                if time.monotonic() > until:
                    raise
                time.sleep(0.001)

    seen = "yes"
    try:
        os.makedirs(place, exist_ok=True)
        put(0, b"")
    except OSError:
        seen = "no"
    context.barrier()
    try:
        until = time.monotonic() + PATIENCE
        for task in range(tasks if seen == "yes" else 0):
            get(0, task, until)
    except OSError:
        seen = "no"
    if any(answer != "yes" for answer in context.allGather(seen)):
        return _all_gather()
    step = 0

    def add(own: np.ndarray) -> np.ndarray:
        nonlocal step
        step += 1
        put(step, own.tobytes())
        out = sum(own.ravel() if task == own_number else np.frombuffer(get(step, task)) for task in range(tasks))
        # All tasks have written this step, so they have read the one before.
        os.remove(name(step - 1, own_number))
        return out.reshape(own.shape)
    return add


def _mounted_folder(context: SparkContext) -> str | None:
    """The session's checkpoint folder as a path, where it is one of a mounted file system."""
    found = urlparse(context.getCheckpointDir() or "")
    return unquote(found.path) if found.scheme == "file" else None


def slots(context: SparkContext) -> int:
    """Tasks that run at a time; a barrier stage may not have more."""
    conf = context.getConf()
    cores = context.defaultParallelism
    if conf.get("spark.default.parallelism"):
        threads = re.fullmatch(r"local(?:\[([\d*]+)(?:,.*)?\])?", context.master)
        workers = re.fullmatch(r"local-cluster\[\s*(\d+)\s*,\s*(\d+).*\]", context.master)
        if threads:
            real = {"*": os.cpu_count(), None: 1}.get(threads[1]) or int(threads[1])
        elif workers:
            real = int(workers[1]) * int(workers[2])
        else:
            real = int(conf.get("spark.executor.instances", "1")) * int(conf.get("spark.executor.cores", "1"))
        cores = min(cores, real)
    return max(1, cores // int(conf.get("spark.task.cpus", "1")))


class BoostedModel(ForestModel):
    """The sum of the trees, predicted from the feature vector."""

    averaged = False


@dataclass
class Booster:
    """An estimator like MLlib's GBTRegressor. Rows where the column `held` is true end the rounds by their error."""

    features: str
    label: str
    loss: str
    rounds: int
    depth: int
    step: float
    share: float
    subset: str
    seed: int
    tolerance: float = 0.0
    held: str | None = None
    task_rows: int | None = None

    def fit(self, rows: DataFrame) -> BoostedModel:
        """Nodes come to the driver: at most 2^(depth + 1) of 15 bytes per tree."""
        if self.loss not in ("squared", "absolute"):
            raise ValueError(f"loss is squared or absolute, not {self.loss}")
        vector = vector_to_array(F.col(self.features))
        values = rows.select(vector.alias("x"), F.col(self.label).alias("y"),
                             (F.lit(False) if self.held is None else F.col(self.held)).alias("held"))
        learned = values.filter("not held")
        seen = learned.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("sd"),
                           F.max(F.size("x")).alias("k")).first()
        if not seen["n"]:
            raise ValueError("a booster needs rows to learn from")
        k, mean = seen["k"], seen["mean"]
        # A sign is no multiple of the target's spread, so the absolute loss keeps the target's unit.
        unit = (seen["sd"] or 1.0) if self.loss == "squared" else 1.0
        cuts = bin_cuts(learned, k, BINS)
        given = {"loss": self.loss, "rounds": self.rounds, "depth": self.depth, "step": self.step, "share": self.share,
                 "tries": tries_of(self.subset, k), "bins": max(2, max(len(c) for c in cuts) + 1), "seed": self.seed,
                 "tolerance": self.tolerance, "unit": unit}
        context = rows.sparkSession.sparkContext
        checkpoint_folder(rows.sparkSession)
        shared = _mounted_folder(context)
        # Barrier stages need executors that stay; without need for one there is none.
        fixed = context.getConf().get("spark.dynamicAllocation.enabled", "false") != "true"
        most = self.task_rows or (FILE_ROWS if shared and fixed else TASK_ROWS)
        tasks = min(slots(context), -(-seen["n"] // most))
        folder = shared and os.path.join(shared, f"boosting-{uuid.uuid4().hex}")

        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes, columns = [np.zeros((k, 0), np.uint8)], [(np.zeros(0), np.zeros(0, bool), np.zeros(0, np.int64))]
            for b in batches:
                codes.append(_codes(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k), cuts)
                             if b.num_rows else codes[0])
                columns.append(tuple(c.to_numpy(zero_copy_only=False) for c in b.columns[1:]))
            codes = np.concatenate(codes, 1)
            y, held, names = (np.concatenate(c) for c in zip(*columns))
            trees, gains = boost(codes, (y - mean) / unit, names.astype(np.int64).view(np.uint64), held.astype(bool),
                                 _by_files(folder) if tasks > 1 else lambda a: a, **given)
            if not TaskContext.get().partitionId():
                for i, (t, g) in enumerate(zip(trees, gains)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i], pa.int32()), *(_binary([a.tobytes()]) for a in (
                            t.feature.astype(np.int16), t.cut.astype(np.uint8), t.left.astype(np.int32), t.value, g))],
                        ["tree", "feature", "cut", "left", "value", "gain"])

        # The name of a row decides in which rounds it takes part.
        dealt = values.withColumn("name", F.xxhash64("x", "y")).repartition(tasks)
        try:
            found = sorted(dealt.mapInArrow(
                train, "tree int, feature binary, cut binary, left binary, value binary, gain binary",
                barrier=tasks > 1).collect(), key=lambda r: r["tree"])
        finally:
            if folder:
                shutil.rmtree(folder, ignore_errors=True)
        trees = [_Tree(np.frombuffer(r["feature"], np.int16), np.frombuffer(r["cut"], np.uint8),
                       np.frombuffer(r["left"], np.int32), np.frombuffer(r["value"]) * unit) for r in found]
        trees[0].value = trees[0].value + mean
        gains = np.array([np.frombuffer(r["gain"]) for r in found])
        sums = gains.sum(1, keepdims=True)
        shares = (gains / np.where(sums > 0, sums, 1)).sum(0)
        return BoostedModel(self.features, cuts, trees, shares / (shares.sum() or 1.0))
