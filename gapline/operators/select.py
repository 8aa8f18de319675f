"""Feature screening: each step reads a one-row aggregate and returns column lists."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.operators.stats import (fill_medians, inflation, moments, null_profile, numeric_columns, profile,
                                     target_correlations)


def feature_pool(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    hidden = set(exclude)
    return [c for c in df.columns if c not in hidden]


def whitelist(names: Sequence[str], pool: Sequence[str], target: str) -> list[str]:
    """Names of the list that survived, in the order of the list."""
    alive = set(pool)
    return [c for c in names if c in alive and c != target]


def dropped_features(df: DataFrame, before: Sequence[str], after: Sequence[str]) -> DataFrame:
    gone = sorted(set(before) - set(after))
    return df.sparkSession.createDataFrame([(c,) for c in gone], "column string")


def fill_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Median fill of the columns that have nulls, others untouched."""
    holes = [r["column"] for r in null_profile(df, columns).filter(F.col("nulls") > 0).collect()]
    return fill_medians(df, holes) if holes else df


@dataclass
class Screening:
    """What each screening step removed, and what is left."""

    pool: list[str]
    constant: list[str] = field(default_factory=list)
    forced: list[str] = field(default_factory=list)
    collinear: list[str] = field(default_factory=list)
    vif: dict[str, float] = field(default_factory=dict)
    final: list[str] = field(default_factory=list)


def vif_candidates(df: DataFrame, features: Sequence[str], target: str, limit: int = 30,
                   keep: int = 25) -> list[str]:
    """All features, or past `limit` of them the `keep` most correlated with the target."""
    if len(features) <= limit:
        return list(features)
    ranked = target_correlations(df, features, target).limit(keep)
    best = {r["column"] for r in ranked.collect()}
    return [c for c in features if c in best]


def screen(df: DataFrame, target: str, exclude: Sequence[str] = (), forced: Sequence[str] = (),
           names: Sequence[str] | None = None, max_vif: float = 10.0, centered: bool = False,
           limit: int = 30, keep: int = 25) -> tuple[DataFrame, Screening]:
    """Constant columns, forced drops, median fill, one VIF pass, then the whitelist.

    Returns the filled table and the record of the steps.
    """
    pool = [c for c in feature_pool(df, exclude) if c != target]
    result = Screening(pool=pool)
    seen = profile(df, pool) if pool else {}
    result.constant = [c for c in pool if seen[c][1]]
    result.forced = [c for c in forced if c in pool and c not in result.constant]
    alive = [c for c in pool if c not in {*result.constant, *result.forced}]
    holes = [c for c in alive if seen[c][0]]
    filled = fill_medians(df, holes) if holes else df
    numeric = set(numeric_columns(filled))
    tested = vif_candidates(filled, [c for c in alive if c in numeric], target, limit, keep)
    found = moments(filled, tested).without_flat() if tested else None
    result.vif = inflation(found.gram(centered), found.columns) if found is not None and found.columns else {}
    result.collinear = [c for c, v in result.vif.items() if v > max_vif]
    alive = [c for c in alive if c not in result.collinear]
    result.final = whitelist(names, alive, target) if names is not None else alive
    return filled, result
