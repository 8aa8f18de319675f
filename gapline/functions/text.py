"""Text repair expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as blank text, and the edges removed by strip.
BLANK = r"^\s*$"
EDGES = r"^\s+|\s+$"


def is_missing(c: Column) -> Column:
    """True for null and for text made of whitespace only (tabs included)."""
    return c.isNull() | c.cast("string").rlike(BLANK)


def blank_to_null(c: Column) -> Column:
    return F.when(~c.rlike(BLANK), c)


def strip(c: Column) -> Column:
    """Remove whitespace of every kind at both ends; `trim` would leave tabs."""
    return F.regexp_replace(c, EDGES, "")
