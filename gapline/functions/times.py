"""Timestamp parsing, calendar parts and durations. Times are zone-free (`timestamp_ntz`)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gapline.functions.text import strip

# The year-first spelling a time mostly has, and the one times are written in.
TIME_SHAPE = r"^\s*\d{4}[-/]\d{1,2}[-/]\d{1,2}([ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d{1,6})?)?)?\s*$"
OUTPUT_FORMAT = "yyyy-MM-dd HH:mm:ss"
MICROS_PER_HOUR = 3.6e9
MICROS_PER_DAY = 8.64e10

# English month names, known by their first three letters.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
MONTH_NAME = (r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|"
              r"sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?")

# The shapes beside TIME_SHAPE in lower case, each known by how it starts, and how it is written year-first.
COMPACT = r"^\d{8}"
NUMBERS = r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{4}"
DAY_NAME = r"^(\d{1,2})[- ]*" + MONTH_NAME + r"[-, ]+(\d{4})"
NAME_DAY = "^" + MONTH_NAME + r"[- ]*(\d{1,2})[-, ]+(\d{4})"
CLOCK = (r"(?:[ t]\s*(?:(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:[.,](\d{1,9}))?)?\s*([ap]m)?|(\d{1,2})\s*([ap]m))"
         r"\s*(?:z|utc|gmt|([+-]\d{2}):?(\d{2})?)?)?")
YEAR_FIRST = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + CLOCK + "$"
PARTS = ("year", "month", "day", "hour", "minute", "second", "fraction", "half", "only_hour", "only_half",
         "zone_hours", "zone_minutes")


def parse_time(c: Column, formats: Sequence[str] = ()) -> Column:
    """Date or time text to a timestamp; text that is neither becomes null, not an error.

    Each value is told by its shape once and parsed on its own, so a column may mix spellings: year first with
    `-`, `/` or `.`, compact (20240105, with or without a clock), month first (day first where the first number is
    above 12), English month names; a clock with or without seconds, up to 9 digits of a fraction (kept to
    microseconds), AM and PM; Z, UTC, GMT or an offset. A time with a zone becomes its time in UTC. Other spellings can be named
    in `formats`; they are tried in order afterwards. Shapes are tested first, because a failed parse costs an
    exception per value.
    """
    # The cast itself ignores whitespace at both ends.
    known = F.when(c.rlike(TIME_SHAPE), F.translate(c, "/", "-").try_cast("timestamp_ntz")).otherwise(
        _once(F.lower(strip(c)), lambda t: _once(_year_first(t), _from_parts)))
    others = [F.try_to_timestamp(strip(c), F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(known, *others)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _year_first(t: Column) -> Column:
    """The text of another shape with its date written year-first; null where no shape fits."""
    spaced = F.regexp_replace(t, r"^(\d{4})(\d{2})(\d{2})[ t]?", "$1-$2-$3 ")
    packed = F.regexp_replace(spaced, r"^(\S+) (\d{2})(\d{2})(\d{2})", "$1 $2:$3:$4")
    compact = F.rtrim(F.regexp_replace(packed, r"^(\S+) (\d{2})(\d{2})(?![\d:])", "$1 $2:$3"))

    def named(pattern: str, name_group: int, to: str) -> Column:
        place = F.instr(F.lit(MONTHS), F.substring(F.regexp_extract(t, pattern, name_group), 1, 3))
        month = F.floor((place + 2) / 3).cast("string")
        return F.replace(F.regexp_replace(t, pattern, to), F.lit("@"), month)

    split = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})"
    return (
        F.when(t.rlike(r"^\d{4}[-/.]"), t).when(t.rlike(COMPACT), compact)
        .when(t.rlike(NUMBERS), F.when(t.rlike(r"^(1[3-9]|[2-9]\d)"), F.regexp_replace(t, split, "$3-$2-$1"))
              .otherwise(F.regexp_replace(t, split, "$3-$1-$2")))
        .when(t.rlike(DAY_NAME), named(DAY_NAME, 2, "$3-@-$1"))
        .when(t.rlike(NAME_DAY), named(NAME_DAY, 1, "$3-@-$2")))


def _from_parts(t: Column) -> Column:
    """Year-first lower-case text to a timestamp; one match cuts it into its parts."""
    joined = "|".join(f"${i + 1}" for i in range(len(PARTS)))
    cut = F.split(F.when(t.rlike(YEAR_FIRST), F.regexp_replace(t, YEAR_FIRST, joined)), r"\|")
    return _once(cut, lambda parts: _made({n: F.get(parts, F.lit(i)) for i, n in enumerate(PARTS)}))


def _made(part: dict[str, Column]) -> Column:
    def number(*names: str) -> Column:
        text = F.concat(*[part[n] for n in names])
        return F.when(text == "", 0).otherwise(text.try_cast("int"))

    half, hour = F.concat(part["half"], part["only_half"]), number("hour", "only_hour")
    hour = F.when((half == "") | (hour > 12), F.when(half == "", hour)).otherwise(
        hour % 12 + F.when(half == "pm", 12).otherwise(0))
    second = F.concat(part["second"], F.lit("."), F.rpad(F.substring(part["fraction"], 1, 6), 6, "0"))
    second = F.when(part["second"] == "", F.lit(0)).otherwise(second.try_cast("decimal(8,6)"))
    minutes = number("zone_hours") * 60 + F.when(part["zone_hours"].startswith("-"), -1).otherwise(1) * number("zone_minutes")
    local = F.try_make_timestamp_ntz(number("year"), number("month"), number("day"), hour, number("minute"),
                                     F.when(second < 60, second))
    return F.timestamp_add("MINUTE", -minutes, local)


def format_time(c: Column) -> Column:
    return F.date_format(c, OUTPUT_FORMAT)


def hours_between(start: Column, end: Column) -> Column:
    """Signed hours with microsecond resolution."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(MICROS_PER_HOUR)


def days_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(MICROS_PER_DAY)


def whole_days_between(start: Column, end: Column) -> Column:
    return F.floor(days_between(start, end)).cast("bigint")


def calendar(t: Column) -> dict[str, Column]:
    """Hour, Monday-based weekday, month, quarter, weekend flag and day period."""
    weekday = F.weekday(t)
    return {
        "hour": F.hour(t),
        "weekday": weekday,
        "month": F.month(t),
        "quarter": F.quarter(t),
        "weekend": (weekday >= 5).cast("int"),
        "day_period": day_period(F.hour(t)),
    }


def day_period(hour: Column) -> Column:
    """0 morning peak [7, 9), 1 daytime [9, 17), 2 evening peak [17, 20), 3 the rest."""
    return (
        F.when(hour.between(7, 8), 0).when(hour.between(9, 16), 1)
        .when(hour.between(17, 19), 2).otherwise(3)
    )


def response_hours(fault: Column, repair_start: Column) -> Column:
    """Hours from fault to repair start; negative becomes 0, unknown stays unknown."""
    hours = hours_between(fault, repair_start)
    return F.when(hours < 0, F.lit(0.0)).otherwise(hours)
