"""Cleaning of work orders under explicit, counted rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapline.functions.text import is_missing
from gapline.functions.times import parse_time
from gapline.sources.schema import CORE_COLUMNS, DEFAULTS, PERIOD, TIME_COLUMNS

# Rules in the order they are applied; a row counts under the first it breaks.
RULES = ("missing_core", "inverted_times", "outside_period", "unparsed_core", "negative_repair")

MAP_BITS = 1 << 15    # bits of one map of `bitmap_construct_agg`
REPEAT_BITS = 29      # all maps together take 64 MB at most

JUDGEMENT = ("copies", "unparsed_times", "drop_reason")   # what `judge_rows` adds


def strip_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def standardize_columns(df: DataFrame, mapping: Mapping[str, str],
                        keep_unmapped: bool = False) -> DataFrame:
    """Strip the names, rename mapped columns, and drop (or keep) the others."""
    df = strip_column_names(df)
    kept = [c for c in df.columns if keep_unmapped or c in mapping]
    return df.select(*[F.col(c).alias(mapping.get(c, c)) for c in kept])


def schema_drift(df: DataFrame, mapping: Mapping[str, str],
                 core: Sequence[str] = CORE_COLUMNS,
                 times: Sequence[str] = TIME_COLUMNS) -> DataFrame:
    """Columns nobody mapped, and core or time columns that are absent: (issue, column, rows).

    `rows` is what the issue costs: the values lost with an unmapped column, or all rows.
    """
    df = strip_column_names(df)
    renamed = {mapping[c] for c in df.columns if c in mapping}
    issues = [("unmapped", c, F.count(c)) for c in df.columns if c not in mapping]
    issues += [("missing_core", c, F.count(F.lit(1))) for c in core if c not in renamed]
    issues += [("missing_time", c, F.count(F.lit(1))) for c in times if c not in renamed]
    found = [F.struct(F.lit(i).alias("issue"), F.lit(c).alias("column"), n.alias("rows"))
             for i, c, n in issues]
    if not found:
        return df.sparkSession.createDataFrame([], "issue string, column string, rows bigint")
    return df.agg(F.array(*found).alias("_found")).select(F.inline("_found"))


def counted_rows(df: DataFrame, bits: int = REPEAT_BITS) -> DataFrame:
    """Distinct rows with their number of `copies`.

    A first pass counts 64-bit hashes of the rows. Those that occur more than once set a bit each, in a map of
    2^`bits` bits at most, which is broadcast. Rows without a set bit have no equal and stay where they are; all
    others are grouped by their whole columns, so hashes that meet by chance cost time but no row. The table is
    read twice and must give the same rows both times.
    """
    if any(f.dataType.typeName() in ("map", "variant") for f in df.schema) or not df.columns:
        return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies"))
    place = F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), 64 - bits)
    repeated = df.groupBy(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("_hash")).agg(
        F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    place_of = F.shiftrightunsigned("_hash", 64 - bits)
    # A map holds 32,768 bits; positions inside it count from 0.
    maps = repeated.groupBy(F.shiftright(place_of, 15).alias("_part")).agg(
        F.bitmap_construct_agg(place_of.bitwiseAND(F.lit(MAP_BITS - 1))).alias("_map"))
    marked = df.withColumn("_place", place).join(
        F.broadcast(maps), F.shiftright("_place", 15) == F.col("_part"), "left")
    inside = F.col("_place").bitwiseAND(F.lit(MAP_BITS - 1))
    byte = F.conv(F.hex(F.substring("_map", F.floor(inside / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    bit = F.when(F.col("_map").isNotNull(), F.getbit(byte, F.pmod(inside, F.lit(8)).cast("int")) == 1)
    marked = marked.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(bit, F.lit(False)).alias("_again"))
    once = marked.filter(~F.col("_again")).drop("_again").withColumn("copies", F.lit(1).cast("bigint"))
    again = marked.filter("_again").drop("_again").groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(
        F.count(F.lit(1)).alias("copies"))
    return once.unionByName(again)


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Full-row duplicates; only rows whose hash repeats are shuffled."""
    return counted_rows(df).drop("copies")


def missing_core(columns: Sequence[str]) -> Column:
    """True when any core column is null or blank."""
    out = F.lit(False)
    for c in columns:
        out = out | is_missing(F.col(c))
    return out


def drop_missing_core(df: DataFrame, columns: Sequence[str] = CORE_COLUMNS) -> DataFrame:
    return df.filter(~missing_core([c for c in columns if c in df.columns]))


def fill_defaults(df: DataFrame, defaults: Mapping[str, str] = DEFAULTS) -> DataFrame:
    """Constant per column for nulls; blank text is left as it is."""
    return df.fillna({c: v for c, v in defaults.items() if c in df.columns})


def parse_times(df: DataFrame, columns: Sequence[str] = TIME_COLUMNS,
                formats: Sequence[str] = ()) -> DataFrame:
    """Text columns to timestamps; columns that already are timestamps only lose their zone."""
    kinds = {f.name: f.dataType for f in df.schema}

    def parsed(c: str) -> Column:
        if isinstance(kinds[c], T.StringType):
            return parse_time(F.col(c), formats)
        return F.col(c).cast("timestamp_ntz")

    return df.withColumns({c: parsed(c) for c in columns if c in kinds})


def time_columns_ready(df: DataFrame, columns: Sequence[str]) -> bool:
    """All of the columns exist and hold timestamps."""
    kinds = {f.name: f.dataType for f in df.schema}
    stamps = (T.TimestampNTZType, T.TimestampType)
    return all(c in kinds and isinstance(kinds[c], stamps) for c in columns)


def inverted(fault: Column, end: Column) -> Column:
    """Repair ends before the fault; an unknown time is not an inversion."""
    return F.coalesce(end < fault, F.lit(False))


def outside_period(fault: Column, period: tuple[str, str] = PERIOD,
                   end_inclusive_day: bool = False) -> Column:
    """Outside [start, end]. The end date means its midnight unless the day is included."""
    start = F.to_timestamp_ntz(F.lit(period[0]))
    end = F.to_timestamp_ntz(F.lit(period[1]))
    late = fault >= end + F.expr("interval 1 day") if end_inclusive_day else fault > end
    return F.coalesce((fault < start) | late, F.lit(False))


def negative_repair(hours: Column) -> Column:
    """Known and negative; unknown durations stay."""
    return F.coalesce(hours < 0, F.lit(False))


def drop_inverted(df: DataFrame, fault: str = "current_faildate",
                  end: str = "repair_end_time") -> DataFrame:
    return df.filter(~inverted(F.col(fault), F.col(end)))


def keep_period(df: DataFrame, period: tuple[str, str] = PERIOD, fault: str = "current_faildate",
                end_inclusive_day: bool = False) -> DataFrame:
    return df.filter(~outside_period(F.col(fault), period, end_inclusive_day))


def drop_unparsed_core(df: DataFrame, columns: Sequence[str] = CORE_COLUMNS) -> DataFrame:
    return df.dropna("any", subset=[c for c in columns if c in df.columns])


def drop_negative_repair(df: DataFrame, hours: str = "repair_duration_hours") -> DataFrame:
    return df.filter(~negative_repair(F.col(hours)))


@dataclass(frozen=True)
class Rules:
    """Columns and limits of the cleaning rules."""

    core: Sequence[str] = CORE_COLUMNS
    times: Sequence[str] = TIME_COLUMNS
    defaults: Mapping[str, str] = field(default_factory=lambda: DEFAULTS)
    fault: str = "current_faildate"
    end: str = "repair_end_time"
    hours: str = "repair_duration_hours"
    period: tuple[str, str] = PERIOD
    end_inclusive_day: bool = False
    formats: Sequence[str] = ()

    def checks(self, columns: Sequence[str]) -> dict[str, Column]:
        """One condition per rule over parsed rows; `_blank` marks a missing core text."""
        unparsed = F.lit(False)
        for c in self.core:
            unparsed = unparsed | F.col(c).isNull()
        hours = negative_repair(F.col(self.hours)) if self.hours in columns else F.lit(False)
        return {
            "missing_core": F.col("_blank"),
            "inverted_times": inverted(F.col(self.fault), F.col(self.end)),
            "outside_period": outside_period(F.col(self.fault), self.period,
                                             self.end_inclusive_day),
            "unparsed_core": unparsed,
            "negative_repair": hours,
        }

    def parsed(self, df: DataFrame) -> DataFrame:
        """Filled and parsed rows, with `_blank` and `unparsed_times`: columns whose text was no time."""
        blank = missing_core([c for c in self.core if c in df.columns])
        filled = fill_defaults(df.withColumn("_blank", blank), self.defaults)
        texts = [c for c in self.times if c in df.columns and isinstance(df.schema[c].dataType, T.StringType)]
        kept = {f"_text_{i}": ~is_missing(F.col(c)) for i, c in enumerate(texts)}
        parsed = parse_times(filled.withColumns(kept), self.times, self.formats)
        lost = [F.when(F.col(f"_text_{i}") & F.col(c).isNull(), F.lit(c)) for i, c in enumerate(texts)]
        names = F.array_compact(F.array(*lost)) if lost else F.array().cast("array<string>")
        return parsed.withColumn("unparsed_times", names).drop(*kept)


def clean_rows(df: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Distinct rows that break no rule, filled and parsed."""
    # The filters move below this aggregate, which then sees only the rows that stay.
    rows = rules.parsed(df.dropDuplicates())
    for broken in rules.checks(df.columns).values():
        rows = rows.filter(~broken)
    return rows.drop("_blank", "unparsed_times")


def judge_rows(df: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Distinct rows, filled and parsed, with `copies`, `unparsed_times` and `drop_reason` (null: the row stays).

    The duplicates are counted by the same step that removes them, and every rule is a
    column, so the same rows give both the cleaned table and its audit.
    """
    distinct = counted_rows(df)
    checks = rules.checks(df.columns)
    reason = F.coalesce(*[F.when(checks[rule], rule) for rule in RULES])
    return rules.parsed(distinct).withColumn("drop_reason", reason).drop("_blank")


def kept_rows(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("drop_reason").isNull()).drop(*JUDGEMENT)


def judgement_counts() -> list[Column]:
    """What the audit and the summary need, as aggregates over judged rows (or metrics observed of them)."""
    return [F.coalesce(F.sum("copies"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct"),
            *[F.count_if(F.col("drop_reason") == r).alias(r) for r in RULES]]


def audit_of(counts: DataFrame) -> DataFrame:
    """(step, rows_before, dropped, rows_after) from one row of `judgement_counts`, in the order the rules apply."""
    steps, before = [], F.col("total")
    for i, step in enumerate(("duplicate", *RULES)):
        dropped = F.col(step) if i else F.col("total") - F.col("distinct")
        after = before - dropped
        steps.append(F.struct(F.lit(i).alias("step_no"), F.lit(step).alias("step"), before.alias("rows_before"),
                              dropped.alias("dropped"), after.alias("rows_after")))
        before = after
    return counts.select(F.inline(F.array(*steps)))


def summary_of(counts: DataFrame, width: int) -> DataFrame:
    """Rows in, out and dropped, the kept share in percent (0 for an empty table), columns out."""
    rows_in, rows_out = F.col("total"), F.col("distinct")
    for rule in RULES:
        rows_out = rows_out - F.col(rule)
    return counts.select(
        rows_in.alias("rows_in"), rows_out.alias("rows_out"), (rows_in - rows_out).alias("dropped"),
        F.coalesce(F.try_divide(rows_out * 100.0, rows_in), F.lit(0.0)).alias("kept_percent"),
        F.lit(width).alias("columns_out"))


def cleaning_audit(judged: DataFrame) -> DataFrame:
    return audit_of(judged.agg(*judgement_counts()))


def unparsed_times(judged: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(column, unparsed, dropped): texts of each time column that are no time, over rows without copies, and how
    many of them the rules drop with their row."""
    names = [c for c in rules.times if c in judged.columns]
    found = F.array_contains
    counts = judged.agg(*[F.count_if(found("unparsed_times", c)).alias(f"n{i}") for i, c in enumerate(names)],
                        *[F.count_if(found("unparsed_times", c) & F.col("drop_reason").isNotNull()).alias(f"d{i}")
                          for i, c in enumerate(names)])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("unparsed"), F.col(f"d{i}").alias("dropped"))
            for i, c in enumerate(names)]
    return counts.select(F.inline(F.array(*rows)))


def cleaning_summary(judged: DataFrame) -> DataFrame:
    return summary_of(judged.agg(*judgement_counts()), len([c for c in judged.columns if c not in JUDGEMENT]))
