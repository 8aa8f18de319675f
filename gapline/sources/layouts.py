"""Header-first reading: the columns of every file are found first, then all files are read by column name.

Files may order their columns differently, lack some and bring others. Files with the same columns form a layout; each
layout is read under its own columns, and its rows are projected by name, absent columns as null. One pass over the file
heads finds the layouts, none of the rows passes through the driver.

CSV files may hold quoted line breaks and are still read by many tasks a file. A first pass counts the quotes of each
split of a file. Files whose every line is a record go to Spark's own reader; of the others a running parity over the splits says which of them start inside a quoted field. In a second pass the
tasks join the lines of their splits to records; the record that is open at the end of a split and what the next splits
hold of it are put together afterwards, at most two pieces a split. Line breaks inside a field stay as they are,
carriage returns included. A quote inside a field must be doubled and its field quoted, as CSV writers do; a header
must not hold line breaks.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapline.functions.times import OUTPUT_FORMAT
from gapline.operators.scale import cut_lineage, lookup_join

MOST_LAYOUTS = 200        # different column sets; more are rather different tables
FOOTERS_AT_ONCE = 16
WHOLE, HEAD, TAIL = 0, 1, 2
LAYOUT = "_layout"

_SPLITS = "file string, start bigint, quotes bigint, header string, rough boolean"
_RECORDS = "file string, start bigint, layout int, kind int, record string"


def _names(columns: Sequence[str]) -> tuple[str, ...]:
    return tuple(c.lstrip("﻿").strip() for c in columns)


def project(row: Column | None, have: Mapping[str, T.DataType], wanted: T.StructType) -> list[Column]:
    """The wanted columns of a row by name: cast where the type differs, null where absent."""
    def column(f: T.StructField) -> Column:
        if f.name not in have:
            return F.lit(None).cast(f.dataType).alias(f.name)
        value = F.col(f"`{f.name}`") if row is None else row.getField(f.name)
        return (value if have[f.name] == f.dataType else value.try_cast(f.dataType)).alias(f.name)

    return [column(f) for f in wanted]


def _merged(layouts: Sequence[T.StructType], schema: T.StructType | None) -> T.StructType:
    """The wanted columns, then those that only files have, in the order they are met."""
    fields = {f.name: f for f in schema} if schema is not None else {}
    for layout in layouts:
        for f in layout:
            held = fields.get(f.name)
            if held is None:
                fields[f.name] = T.StructField(f.name, f.dataType)
            elif (schema is None or f.name not in schema.names) and held.dataType != f.dataType:
                fields[f.name] = T.StructField(f.name, T.StringType())
    return T.StructType(list(fields.values()))


# --- CSV ---------------------------------------------------------------------------------

def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array, int]]:
    """Rows of one split at a time: (file, start, lines, row of the batch)."""
    key = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["file", "start"])
    ends = pc.run_end_encode(batch.column(1)).run_ends.to_pylist()
    files = pc.run_end_encode(batch.column(0)).run_ends.to_pylist()
    at = 0
    for end in sorted({*ends, *files}):
        first = key[at].as_py()
        yield first["file"], first["start"], batch.column(batch.schema.get_field_index("value"))[at:end], at
        at = end


def _quotes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = None
    for batch in batches:
        rows = []
        for file, start, lines, _ in _runs(batch):
            header = lines[0].as_py() if start == 0 and (file, start) != seen else None
            quotes = pc.count_substring(lines, '"')
            # Lines that are no records of their own, or that Spark's reader would split or skip.
            rough = pc.any(pc.or_(pc.equal(pc.bit_wise_and(quotes, 1), 1), pc.match_substring_regex(
                lines, r"\r|^[\x00-\x20]+$"))).as_py()
            rows.append({"file": file, "start": start, "header": header, "quotes": pc.sum(quotes).as_py() or 0,
                         "rough": bool(rough) or header is not None and not header.strip()})
            seen = file, start
        yield pa.RecordBatch.from_pylist(rows, pa.schema([
            ("file", pa.string()), ("start", pa.int64()), ("quotes", pa.int64()), ("header", pa.string()),
            ("rough", pa.bool_())]))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with `inside` (their split starts in a quoted field) to records, head and tail pieces."""
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("layout", pa.int32()), ("kind", pa.int32()),
                        ("record", pa.string())])
    seen, held, odd, head = None, [], 0, False

    def rows(layout, kinds, records):
        n = len(records)
        return pa.RecordBatch.from_arrays(
            [pa.array([seen[0]] * n, pa.string()), pa.array([seen[1]] * n, pa.int64()), pa.array([layout] * n, pa.int32()),
             pa.array(kinds, pa.int32()), records.cast(pa.string())], schema=schema)

    def rest(layout):
        text = pa.array(["\n".join(t for part in held for t in part.to_pylist())])
        return rows(layout, [HEAD if head else TAIL], text)

    layout = 0
    for batch in batches:
        for file, start, lines, row in _runs(batch):
            if (file, start) != seen:
                if held:
                    yield rest(layout)
                seen, held = (file, start), []
                layout = batch.column(3)[row].as_py()
                odd = batch.column(4)[row].as_py()
                head = bool(odd)
                if start == 0:                              # the header
                    lines = lines[1:]
            open_after = [(odd := odd ^ (q & 1)) for q in pc.count_substring(lines, '"').to_pylist()]
            ends = [i + 1 for i, o in enumerate(open_after) if not o]
            if not ends:
                held.append(lines)
                continue
            done = ends[-1]
            if held:                                        # the first record began in an earlier batch
                first = pa.concat_arrays([*held, lines[:ends[0]]])
                whole, edges = pa.concat_arrays([first, lines[ends[0]:done]]), [0, len(first)]
                edges += [len(first) + e - ends[0] for e in ends[1:]]
            else:
                whole, edges = lines[:done], [0, *ends]
            kinds = [HEAD if head else WHOLE] + [WHOLE] * (len(ends) - 1)
            head = False
            yield rows(layout, kinds, pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), whole), "\n"))
            held = [lines[done:]] if done < len(lines) else []
    if held:
        yield rest(layout)


def _csv_splits(spark: SparkSession, path: str) -> tuple[DataFrame, list[tuple[str, ...]]]:
    """(file, start, layout, inside, rough) of every split, and the columns of each layout; `rough` tells the files
    that hold a line which is no record."""
    counted = _lines(spark, path).mapInArrow(_quotes, _SPLITS).groupBy("file", "start").agg(
        F.sum("quotes").alias("quotes"), F.max("header").alias("header"), F.bool_or("rough").alias("rough"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    splits = cut_lineage(counted.select(
        "file", "start", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).cast("int").alias("inside"),
        F.max("header").over(whole).alias("header"), F.bool_or("rough").over(whole).alias("rough")))
    headers = [r.header for r in splits.select("header").distinct().orderBy("header").limit(MOST_LAYOUTS + 1).collect()]
    if len(headers) > MOST_LAYOUTS:
        raise ValueError(f"more than {MOST_LAYOUTS} different headers in {path}")
    if any(h.count('"') % 2 for h in headers):
        raise ValueError(f"a header with a line break in {path}")
    parsed = [_header(h) for h in headers]
    layouts = sorted(set(parsed))
    place = F.create_map(*[F.lit(x) for h, names in zip(headers, parsed) for x in (h, layouts.index(names))]) if headers else None
    number = F.lit(0) if place is None else place[F.col("header")]
    return splits.select("file", "start", number.cast("int").alias("layout"), "inside", "rough"), layouts


def _header(line: str) -> tuple[str, ...]:
    """Column names of a header line; a repeated or empty name gets its place as a suffix."""
    names = _names(next(csv.reader([line.rstrip("\r")]), [""]))
    return tuple(n if n and n not in names[:i] else f"{n}_{i}" for i, n in enumerate(names))


def csv_records(spark: SparkSession, path: str) -> tuple[DataFrame, list[tuple[str, ...]]]:
    """(layout, record): every record of the files as one text, and the columns of each layout."""
    splits, layouts = _csv_splits(spark, path)
    return _records_of(spark, path, splits), layouts


def _records_of(spark: SparkSession, path: str, splits: DataFrame) -> DataFrame:
    """(layout, record) of the files whose splits are given."""
    placed = lookup_join(_lines(spark, path), splits.drop("rough"), ["file", "start"], "inner").select(
        "file", "start", "value", "layout", "inside")
    found = placed.mapInArrow(_records, _RECORDS)
    pieces = cut_lineage(found.filter(F.col("kind") != WHOLE))
    opened = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    chained = pieces.withColumn("chain", F.sum((F.col("kind") == TAIL).cast("int")).over(opened))
    joined = chained.groupBy("file", "layout", "chain").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "kind", "record"))),
                                 lambda p: p["record"]), "\n").alias("record"))
    records = found.filter(F.col("kind") == WHOLE).select("layout", "record").unionByName(joined.select("layout", "record"))
    return records.withColumn("record", F.regexp_replace("record", "\r$", "")).filter("record <> ''")


def _plain_files(splits: DataFrame, own: Sequence[T.StructType]) -> dict[int, list[str]]:
    """Files by layout in which every line is a record, and whose path and column names Spark takes as they are."""
    unlike = {i for i, x in enumerate(own) if len({n.lower() for n in x.names}) < len(x.names)}
    found: dict[int, list[str]] = {}
    for r in splits.filter("not rough").select("file", "layout").distinct().orderBy("file").collect():
        if r.layout not in unlike and unquote(r.file) == r.file and not set(r.file) & set("*?[]{}\\,"):
            found.setdefault(r.layout, []).append(r.file)
    return found


def _read_csv(spark: SparkSession, path: str, schema: T.StructType | None) -> tuple[DataFrame, list[T.StructType]]:
    splits, layouts = _csv_splits(spark, path)
    wanted_types = {f.name: f.dataType for f in schema} if schema is not None else {}
    own = [T.StructType([T.StructField(n, wanted_types.get(n, T.StringType())) for n in names]) for names in layouts]
    merged = _merged(own, schema)
    if not own:
        return spark.createDataFrame([], T.StructType([*merged, T.StructField(LAYOUT, T.IntegerType())])), own
    options = {"multiLine": "true", "escape": '"', "timestampNTZFormat": OUTPUT_FORMAT, "maxCharsPerColumn": "-1",
               "maxColumns": "100000"}
    plain, parts = _plain_files(splits, own), []
    for i, files in plain.items():
        rows = spark.read.schema(own[i]).options(**{**options, "multiLine": "false"}).option("header", True).option(
            "lineSep", "\n").option("recursiveFileLookup", True).csv(files)
        parts.append(rows.select(*project(None, {f.name: f.dataType for f in own[i]}, merged), F.lit(i).alias(LAYOUT)))
    taken = [f for files in plain.values() for f in files]
    rough = splits
    if taken:
        names = spark.createDataFrame([(f,) for f in taken], "file string")
        rough = cut_lineage(splits.join(names, "file", "left_anti"))
    if not taken or not rough.isEmpty():
        row = F.lit(None)
        for i, columns in enumerate(own):
            parsed = F.from_csv("record", _ddl(columns), options)
            made = F.struct(*project(parsed, {f.name: f.dataType for f in columns}, merged))
            row = F.when(F.col("layout") == i, made).otherwise(row)
        records = _records_of(spark, path, rough)
        parts.append(records.select(row.alias("row"), F.col("layout").alias(LAYOUT)).select("row.*", LAYOUT))
    return reduce(DataFrame.unionByName, parts), own


def _ddl(columns: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in columns)


# --- Parquet and other formats with their own schema -------------------------------------

def file_layouts(spark: SparkSession, path: str, fmt: str) -> list[tuple[T.StructType, list[str]]]:
    """Files under a path by their columns, from their footers."""
    files = sorted(spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
        "pathGlobFilter", f"*.{fmt}").load(path).inputFiles())

    def columns(file: str) -> T.StructType:
        return spark.read.format(fmt).load(file).schema

    with ThreadPoolExecutor(FOOTERS_AT_ONCE) as pool:
        schemas = list(pool.map(columns, files))
    found: dict[str, tuple[T.StructType, list[str]]] = {}
    for file, columns_of in zip(files, schemas):
        found.setdefault(columns_of.json(), (columns_of, []))[1].append(file)
    if len(found) > MOST_LAYOUTS:
        raise ValueError(f"more than {MOST_LAYOUTS} different column sets in {path}")
    return list(found.values())


def _read_typed(spark: SparkSession, path: str, schema: T.StructType | None,
                fmt: str) -> tuple[DataFrame, list[T.StructType]]:
    layouts = file_layouts(spark, path, fmt)
    own = [T.StructType([T.StructField(n, f.dataType) for n, f in zip(_names(columns.names), columns)])
           for columns, _ in layouts]
    merged, out = _merged(own, schema), None
    for i, ((columns, files), named) in enumerate(zip(layouts, own)):
        rows = spark.read.schema(columns).format(fmt).load(files).toDF(*named.names)
        rows = rows.select(*project(None, {f.name: f.dataType for f in named}, merged), F.lit(i).alias(LAYOUT))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = spark.createDataFrame([], T.StructType([*merged, T.StructField(LAYOUT, T.IntegerType())]))
    return out, own


def read_layouts(spark: SparkSession, path: str, schema: T.StructType | None = None,
                 fmt: str = "parquet") -> tuple[DataFrame, list[T.StructType]]:
    """All files under a path by column name with the number of their layout, and the columns of each layout.

    The columns of `schema` come first; those that it lacks follow, in CSV files as text.
    """
    return _read_csv(spark, path, schema) if fmt == "csv" else _read_typed(spark, path, schema, fmt)


def read_files(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet",
               extra: bool = False) -> DataFrame:
    """All files under a path by column name: those of `schema`, and the files' own beyond it where `extra`."""
    rows, _ = read_layouts(spark, path, schema, fmt)
    return rows.drop(LAYOUT) if extra or schema is None else rows.select(*[f"`{n}`" for n in schema.names])


def source_drift(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                 required: Mapping[str, Sequence[str]] = {}) -> DataFrame:
    """What the files' columns cost: (issue, column, files' layouts, rows).

    `unmapped` columns are not in `schema`; their rows are the values lost. `required` names, per issue, columns
    that must be there; their rows are those of the files without them.
    """
    rows, layouts = read_layouts(spark, path, schema, fmt)
    issues = []
    for name in [c for c in rows.columns if c not in schema.names and c != LAYOUT]:
        issues.append(("unmapped", name, sum(name in x.names for x in layouts), F.count(F.col(f"`{name}`"))))
    for issue, names in required.items():
        for name in names:
            without = [i for i, x in enumerate(layouts) if name not in x.names]
            if without:
                issues.append((issue, name, len(without), F.count_if(F.col(LAYOUT).isin(without))))
    found = [F.struct(F.lit(issue).alias("issue"), F.lit(name).alias("column"), F.lit(n).alias("layouts"), count.alias("rows"))
             for issue, name, n, count in issues]
    if not found:
        return spark.createDataFrame([], "issue string, column string, layouts int, rows bigint")
    return rows.agg(F.array(*found).alias("found")).select(F.inline("found"))
