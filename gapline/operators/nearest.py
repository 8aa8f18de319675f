"""Exact nearest rows by squared distance, and the oversampling built on it.

A bounded number of rows serve as pivots. Each base row belongs to the cell of its nearest pivot, and a cell is
cut into rings of equal size by the distance to it. A query first looks into the ring it falls in. Its k-th
distance there then rules out whole cells (every row of a cell is nearer to that pivot than to the query's own,
so the cell lies behind the plane between the two) and rings (distances to the pivot differ by no more than the
distance of the rows). Neighboring cells and rings form bands; a query travels once to each band it must look
into, so what moves is queries times bands, not queries times rings. Bands and their chunks of queries are bounded, and
a task returns k rows per query, never the pairs it looked at. Only the pivots are known to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil, isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gapline.operators.scale import HOT_ROWS, cut_lineage, lookup_join, row_numbers, with_totals
from gapline.operators.split import SEED, seeded_hash

BUCKET_ROWS = 2_000    # rows of one ring and of one query chunk
BAND_ROWS = 50_000     # rows of one band and of its query chunks: what meets in one task
MAX_PIVOTS = 256       # cells of a group; more rows make more rings
BLOCK = 64             # queries measured at once inside a task
QUERY_BLOCK = 1_024    # queries of a band measured at once
BASE_BLOCK = 4_096     # base rows measured at once
SLACK = 1e-11          # share of the squared lengths by which a matrix product may miss a squared distance
CELL = ["_g", "cell"]
RING = [*CELL, "ring"]


def _pivots(points: DataFrame, total: int, bucket_rows: int) -> np.ndarray:
    """At most MAX_PIVOTS different vectors, chosen by hash."""
    wanted = min(MAX_PIVOTS, total // bucket_rows + 1)
    rows = points.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(wanted).collect()
    return np.unique(np.array([r["vec"] for r in rows], dtype="float64"), axis=0)


def _to_pivots(vectors: pd.Series, pivots: np.ndarray) -> Iterator[np.ndarray]:
    """Distances to all pivots, a block of rows at a time."""
    for start in range(0, len(vectors), BLOCK):
        part = np.stack(vectors.iloc[start:start + BLOCK].to_numpy())
        yield np.sqrt(((part[:, None, :] - pivots[None]) ** 2).sum(axis=2))


def _own_cell(pivots: np.ndarray):
    @F.pandas_udf("struct<cell int, d double>")
    def own(vectors: pd.Series) -> pd.DataFrame:
        parts = [(d.argmin(axis=1), d.min(axis=1)) for d in _to_pivots(vectors, pivots)]
        return pd.DataFrame({"cell": np.concatenate([c for c, _ in parts] or [[]]).astype("int32"),
                             "d": np.concatenate([d for _, d in parts] or [[]]).astype("float64")})
    return own


def _bounds(d: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Least distance of each query (its distances to all pivots) to the rows of each cell."""
    gap = d ** 2 - (d ** 2).min(axis=1, keepdims=True)
    between = apart[d.argmin(axis=1)]
    return np.divide(gap, 2 * between, out=np.zeros_like(gap), where=between > 0)


def _between(pivots: np.ndarray) -> np.ndarray:
    return np.concatenate(list(_to_pivots(pd.Series(list(pivots)), pivots)))


def _cells_in_reach(pivots: np.ndarray):
    """Distances to the pivots by cell, null where the cell is out of reach."""
    apart = _between(pivots)

    @F.pandas_udf("array<double>")
    def cells(vectors: pd.Series, reach: pd.Series) -> pd.Series:
        out, at = [], 0
        for d in _to_pivots(vectors, pivots):
            seen = _bounds(d, apart) <= reach.iloc[at:at + len(d)].to_numpy()[:, None]
            out += [[float(x) if s else None for x, s in zip(row, some)] for row, some in zip(d, seen)]
            at += len(d)
        return pd.Series(out, dtype=object)
    return cells


def nearest(queries: DataFrame, base: DataFrame, *, id_col: str, vector: str, k: int = 1,
            exclude_self: bool = False, bucket_rows: int = BUCKET_ROWS, group: str | None = None,
            hot_rows: int = HOT_ROWS) -> DataFrame:
    """(query, neighbor, distance, place): the k base rows of least squared distance per query.

    Equal distances go by id. Both tables hold `id_col` (a whole number or text) and `vector`
    (array<double>). With `group` a query meets the rows of its own group alone; rows with a null
    group take no part. A query whose first ring holds fewer than k rows visits its whole group.
    """
    kind = "string" if isinstance(base.schema[id_col].dataType, StringType) else "bigint"
    of = F.col(group).cast("string") if group else F.lit("")
    keep = k + 1 if exclude_self else k
    # Of identical vectors only the smallest ids can be among the k; the limit is applied on
    # both sides of the shuffle, so a vector copied a million times stays cheap.
    copies = Window.partitionBy("_g", "vec").orderBy("nid")
    points = cut_lineage(
        base.select(of.alias("_g"), F.col(id_col).cast(kind).alias("nid"),
                    F.col(vector).cast("array<double>").alias("vec")).filter(F.col("_g").isNotNull())
        .withColumn("_copy", F.row_number().over(copies)).filter(F.col("_copy") <= keep).drop("_copy"))
    total = points.count()
    pivots = _pivots(points, total, bucket_rows)
    if not len(pivots):
        return queries.sparkSession.createDataFrame(
            [], f"query {kind}, neighbor {kind}, distance double, place int")
    own = _own_cell(pivots)
    key = F.concat_ws(":", F.col("cell").cast("string"), "_g")
    placed = points.withColumn("_own", own("vec")).select("*", "_own.*").drop("_own").withColumn("_key", key)
    numbered = row_numbers(placed, ["d", "nid"], "_key", "_no", hot_rows)
    points = cut_lineage(numbered.select(
        *CELL, F.floor((F.col("_no") - 1) / bucket_rows).cast("int").alias("ring"), "nid", "vec", "d"))
    rings = points.groupBy(*RING).agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count(F.lit(1)).alias("_n"))
    edges = rings.groupBy(*CELL).agg(F.array_sort(F.collect_list("lo")).alias("_lo"),
                                     F.array_sort(F.collect_list("hi")).alias("_hi"))
    asked = cut_lineage(
        queries.select(of.alias("_g"), F.col(id_col).cast(kind).alias("qid"),
                       F.col(vector).cast("array<double>").alias("vec")).filter(F.col("_g").isNotNull())
        .withColumn("_own", own("vec")).select("*", "_own.*").drop("_own"))
    below = F.size(F.filter("_hi", lambda h: h < F.col("d")))
    first = cut_lineage(asked.join(edges, CELL, "left").select(
        *CELL, "qid", "vec", F.least(below, F.size("_hi") - 1).alias("ring")))
    near = _measure(first.filter(F.col("ring").isNotNull()), points, k, exclude_self, bucket_rows, kind)
    radius = near.groupBy("qid").agg(F.max("distance").alias("_d"), F.count(F.lit(1)).alias("_k"))
    # A little slack keeps rounding from hiding a neighbor that sits exactly on the border.
    reach = F.coalesce(F.when(F.col("_k") >= k, F.sqrt("_d") * (1 + 1e-9) + 1e-9), F.lit(float("inf")))
    wide = first.join(radius, "qid", "left").select("_g", "qid", "vec", reach.alias("_reach"))
    # Enough bands to keep the cores busy, fewer than would copy the queries often.
    cores = points.sparkSession.sparkContext.defaultParallelism
    band_rows = max(bucket_rows, min(BAND_ROWS, ceil(total / (isqrt(4 * cores) + 1))))
    earlier = Window.partitionBy("_g").orderBy("cell", "ring").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut_lineage(rings.withColumn(
        "band", F.floor(F.coalesce(F.sum("_n").over(earlier), F.lit(0)) / band_rows).cast("int")))
    spans = placed.groupBy(*CELL, "band").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).groupBy("_g").agg(
        F.collect_list(F.struct("cell", "lo", "hi", "band")).alias("_spans"))
    reached = lookup_join(wide.withColumn("_d", _cells_in_reach(pivots)("vec", "_reach")), spans, "_g", "inner")

    def meets(s):
        d = F.get("_d", s["cell"])
        return (s["lo"] <= d + F.col("_reach")) & (s["hi"] >= d - F.col("_reach"))

    bands = F.array_distinct(F.transform(F.filter("_spans", meets), lambda s: s["band"]))
    asked = cut_lineage(reached.select("_g", "qid", "vec", "_reach", bands.alias("_bands")))
    in_bands = lookup_join(points, placed.select(*RING, "band"), RING, "inner")
    found = _search_bands(asked, in_bands, k, exclude_self, band_rows, pivots, kind)
    # At most k rows per visited band and query, limited before the shuffle as well.
    place = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "nid"))
    return found.withColumn("place", place).filter(F.col("place") <= k).select(
        F.col("qid").alias("query"), F.col("nid").alias("neighbor"), "distance", "place")


def _measure(asked: DataFrame, points: DataFrame, k: int, exclude_self: bool,
             chunk_rows: int, kind: str) -> DataFrame:
    """Best k per query among the points of its ring."""
    # One row per ring that is asked for; it is broadcast only where it turns out small.
    load = asked.groupBy(*RING).agg(
        F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("_chunks"))
    left = asked.join(load, RING).select(
        *RING, F.pmod(F.xxhash64("qid"), F.col("_chunks")).cast("int").alias("chunk"), "qid", "vec")
    right = points.join(load, RING).select(
        *RING, F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("chunk"), "nid", "vec")

    def best(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame({"qid": pd.Series(dtype=q["qid"].dtype), "nid": pd.Series(dtype=b["nid"].dtype),
                                "distance": pd.Series(dtype="float64")})
        return pd.concat(list(_blocks(q, b, k, exclude_self)) or [nothing])

    return left.groupBy(*RING, "chunk").cogroup(right.groupBy(*RING, "chunk")).applyInPandas(
        best, f"qid {kind}, nid {kind}, distance double")


def _blocks(q: pd.DataFrame, b: pd.DataFrame, k: int,
            exclude_self: bool) -> Iterator[pd.DataFrame]:
    if q.empty or b.empty:
        return
    ids = b["nid"].to_numpy()
    by_id = np.argsort(ids, kind="stable")
    ids, base = ids[by_id], np.stack(b["vec"].to_numpy())[by_id]
    vectors, names = np.stack(q["vec"].to_numpy()), q["qid"].to_numpy()
    for start in range(0, len(names), BLOCK):
        part, part_names = vectors[start:start + BLOCK], names[start:start + BLOCK]
        d = np.concatenate([((part[:, None, :] - base[None, at:at + BASE_BLOCK, :]) ** 2).sum(axis=2)
                            for at in range(0, len(base), BASE_BLOCK)], axis=1)
        if exclude_self:
            d[part_names[:, None] == ids[None, :]] = np.inf
        # The base is in id order, so a stable sort leaves ties by id.
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        best = np.take_along_axis(d, order, axis=1)
        real = np.isfinite(best)
        yield pd.DataFrame({"qid": np.repeat(part_names, real.sum(axis=1)),
                            "nid": ids[order][real], "distance": best[real]})


def _search_bands(asked: DataFrame, points: DataFrame, k: int, exclude_self: bool, band_rows: int,
                  pivots: np.ndarray, kind: str) -> DataFrame:
    """Best k per query in each of its bands, crowded bands in chunks of queries."""
    visits = asked.select("_g", "qid", "vec", "_reach", F.explode("_bands").alias("band"))
    load = cut_lineage(visits.groupBy("_g", "band").agg(
        F.ceil(F.count(F.lit(1)) / band_rows).cast("int").alias("_chunks")))
    left = lookup_join(visits, load, ["_g", "band"], "inner").select(
        "_g", "band", F.pmod(F.xxhash64("qid"), F.col("_chunks")).cast("int").alias("chunk"), "qid", "vec", "_reach")
    right = lookup_join(points, load, ["_g", "band"], "inner").select(
        "_g", "band", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("chunk"), "cell", "nid", "vec", "d")
    apart, key = _between(pivots), ["_g", "band", "chunk"]

    def best(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame({"qid": pd.Series(dtype=q["qid"].dtype), "nid": pd.Series(dtype=b["nid"].dtype),
                                "distance": pd.Series(dtype="float64")})
        return pd.concat(list(_band(q, b, k, exclude_self, pivots, apart)) or [nothing])

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(
        best, f"qid {kind}, nid {kind}, distance double")


def _band(q: pd.DataFrame, b: pd.DataFrame, k: int, exclude_self: bool, pivots: np.ndarray,
          apart: np.ndarray) -> Iterator[pd.DataFrame]:
    """A matrix product tells which rows may be among the k; their distances are then taken one by one."""
    if q.empty or b.empty:
        return
    b = b.sort_values(["cell", "d"])
    ids, far, base = b["nid"].to_numpy(), b["d"].to_numpy(), np.stack(b["vec"].to_numpy())
    cells, starts = np.unique(b["cell"].to_numpy(), return_index=True)
    ends = [*starts[1:], len(b)]
    squares = (base ** 2).sum(axis=1)
    product = np.column_stack([-2 * base, squares, np.ones(len(base))]).T.copy()
    most = squares.max()
    for start in range(0, len(q), QUERY_BLOCK):
        some = q.iloc[start:start + QUERY_BLOCK]
        names, reach, part = some["qid"].to_numpy(), some["_reach"].to_numpy().copy(), np.stack(some["vec"].to_numpy())
        d = np.concatenate(list(_to_pivots(some["vec"], pivots)))
        bounds = _bounds(d, apart)
        own = (part ** 2).sum(axis=1)
        asked = np.column_stack([part, np.ones(len(part)), own])
        slack = SLACK * (own + most)
        held = np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0, "float64")
        # The nearest cells first: what they hold shortens the reach for the others.
        for c in np.argsort(bounds[:, cells].sum(axis=0), kind="stable"):
            cell = cells[c]
            rows = np.flatnonzero(bounds[:, cell] <= reach)
            if not len(rows):
                continue
            inside = far[starts[c]:ends[c]]
            low = starts[c] + np.searchsorted(inside, (d[rows, cell] - reach[rows]).min())
            high = starts[c] + np.searchsorted(inside, (d[rows, cell] + reach[rows]).max(), "right")
            for at in range(low, high, BASE_BLOCK):
                to = min(at + BASE_BLOCK, high)
                near = asked[rows] @ product[:, at:to]
                if exclude_self:
                    self = np.flatnonzero(np.isin(names[rows], ids[at:to]))
                    near[self] = np.where(names[rows][self][:, None] == ids[None, at:to], np.inf, near[self])
                limit = reach[rows] ** 2
                free = np.isinf(limit)
                if free.any() and to - at >= k:
                    limit[free] = np.partition(near[free], k - 1, axis=1)[:, k - 1] + slack[rows][free]
                # Not greater: what is no number is left to the distance itself.
                x, y = np.nonzero(~(near > (limit + slack[rows])[:, None]))
                x, y = rows[x], y + at
                away = ((part[x] - base[y]) ** 2).sum(axis=1)
                real = np.isfinite(away) & ~(exclude_self & (names[x] == ids[y]))
                x, y, away = (np.concatenate([old, new[real]]) for old, new in zip(held, (x, y, away)))
                order = np.lexsort((ids[y], away, x))
                x, y, away = x[order], y[order], away[order]
                first = np.searchsorted(x, x)
                kept = np.arange(len(x)) - first < k
                held = x, y, away = x[kept], y[kept], away[kept]
                last = np.flatnonzero(np.arange(len(x)) - np.searchsorted(x, x) == k - 1)
                reach[x[last]] = np.minimum(reach[x[last]], np.sqrt(away[last]) * (1 + 1e-9) + 1e-9)
        x, y, away = held
        yield pd.DataFrame({"qid": names[x], "nid": ids[y], "distance": away})


def oversample(df: DataFrame, stratum: str, features: Sequence[str], id_col: str, k: int = 5,
               seed: int = SEED, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Synthetic rows that bring every stratum to the size of the largest.

    Each is a point between a row and one of its k nearest rows of the same stratum, on
    features taken as they are (scale them first). All strata go through one plan. The only row of a
    stratum is repeated; rows without a stratum take no part. Columns: stratum, features, source_id.
    """
    vec = F.array(*[F.col(c).cast("double") for c in features])
    rows = df.filter(F.col(stratum).isNotNull()).select(
        stratum, F.col(id_col).alias("_id"), vec.alias("_vec"))
    # The neighbor search reads its points several times: compute them once.
    rows = cut_lineage(rows)
    sizes = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("_size"))
    missing = with_totals(sizes, sizes.agg(F.max("_size").alias("_goal"))).select(
        stratum, "_size", (F.col("_goal") - F.col("_size")).alias("_missing")).filter("_missing > 0")
    ranked = row_numbers(rows.join(missing, stratum).withColumn("_hash", seeded_hash(["_id"], seed)),
                         ["_hash", "_id"], stratum, "_no", hot_rows)
    # Every row serves equally often; the first ones in hash order fill up the remainder.
    copies = F.floor(F.col("_missing") / F.col("_size")).cast("int") + (
        F.col("_no") <= F.col("_missing") % F.col("_size")).cast("int")
    serving = cut_lineage(ranked.withColumn("_copies", copies).filter(F.col("_copies") > 0).select(
        stratum, "_id", "_vec", "_size", "_copies"))
    near = nearest(serving, rows.join(missing.select(stratum), stratum, "left_semi"), id_col="_id", vector="_vec",
                   k=k, exclude_self=True, group=stratum, hot_rows=hot_rows)
    draw = seeded_hash(["_id", "_copy"], seed)
    digits = [F.conv(F.substring(draw, at, 8), 16, 10).cast("bigint") for at in (1, 9)]
    choices = F.greatest(F.least(F.lit(k), F.col("_size") - 1), F.lit(1))
    wanted = serving.select("*", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).withColumns({
        "_place": (digits[0] % choices + 1).cast("int"), "_share": digits[1] / 4294967296.0})
    ends = rows.select(F.col("_id").alias("_nid"), F.col("_vec").alias("_end"))
    joined = wanted.join(near, (F.col("_id") == F.col("query")) & (F.col("_place") == F.col("place")), "left")
    joined = joined.join(ends, F.col("neighbor") == F.col("_nid"), "left").withColumn(
        "_step", F.zip_with("_vec", F.coalesce("_end", "_vec"), lambda a, b: b - a))
    return joined.select(stratum, *[
        (F.col("_vec")[i] + F.col("_share") * F.col("_step")[i]).alias(c)
        for i, c in enumerate(features)], F.col("_id").alias("source_id"))


def append_rows(df: DataFrame, extra: DataFrame) -> DataFrame:
    """Originals and synthetic rows, told apart by `synthetic`."""
    common = [c for c in df.columns if c in extra.columns]
    return df.select(*common, F.lit(False).alias("synthetic")).unionByName(
        extra.select(*common, F.lit(True).alias("synthetic")))
