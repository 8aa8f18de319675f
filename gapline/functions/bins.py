"""Bins, flags, clips and tiers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Device mean gap bins in days, accuracy tiers in percent.
MTBF_DAY_EDGES = (0, 15, 23, 30, 40, 999)
ACCURACY_TIERS = ((80, "excellent"), (70, "good"), (65, "pass"))


def right_closed_bin(c: Column, edges: Sequence[float] = MTBF_DAY_EDGES) -> Column:
    """Index i of the bin (edges[i], edges[i+1]] holding the value, null outside all bins."""
    steps = list(zip(edges[:-1], edges[1:]))
    first = F.when((c > steps[0][0]) & (c <= steps[0][1]), 0)
    return reduce(lambda acc, s: acc.when((c > s[1][0]) & (c <= s[1][1]), s[0]),
                  list(enumerate(steps))[1:], first)


def flag(c: Column, value) -> Column:
    """1 where the column equals the value, 0 elsewhere and for null."""
    return F.coalesce((c == F.lit(value)).cast("int"), F.lit(0))


def one_hot(c: Column, names: dict[str, int]) -> dict[str, Column]:
    return {name: flag(c, code) for name, code in names.items()}


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Clip non-null values; null stays null (`greatest`/`least` alone would skip it)."""
    out = c
    if low is not None:
        out = F.when(out < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(high)).otherwise(out)
    return out


def tier(accuracy: Column, tiers: Sequence[tuple[float, str]] = ACCURACY_TIERS) -> Column:
    """Highest tier reached by an accuracy in percent, 'below' under all of them."""
    first, *rest = tiers
    out = F.when(accuracy >= first[0], first[1])
    for bound, name in rest:
        out = out.when(accuracy >= bound, name)
    return out.otherwise("below")


def hash_bucket(c: Column, buckets: int) -> Column:
    """Bucket of a category from the leading digits of its MD5, the same in every engine.

    Null is the empty text.
    """
    digits = F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit(""))), 1, 8), 16, 10)
    return F.pmod(digits.cast("bigint"), F.lit(buckets)).cast("int")
