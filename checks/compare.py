"""Run registered queries and their SQL on the same tables and compare all rows.

    python -m checks.compare [folder] [name-part ...]
"""

from __future__ import annotations

import sys
import time
import traceback

import duckdb
import pandas as pd

from checks import registry
from checks.base import ORACLES, QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v) -> str:
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def sorted_rows(table) -> list[tuple[str, ...]]:
    """Rows of an Arrow table as text, columns by name, in one fixed order."""
    names = sorted(table.column_names)
    columns = [[_cell(v) for v in table[n].to_pylist()] for n in names]
    return sorted(zip(*columns))


def kinds(table) -> dict[str, str]:
    short = {"large_string": "string", "timestamp[us, tz=UTC]": "timestamp[us]"}
    return {f.name: short.get(str(f.type), str(f.type)) for f in table.schema}


def differences(spark_table, sql_table) -> str | None:
    a, b = kinds(spark_table), kinds(sql_table)
    if a != b:
        return f"types differ: {sorted(set(a.items()) ^ set(b.items()))}"
    left, right = sorted_rows(spark_table), sorted_rows(sql_table)
    if len(left) != len(right):
        return f"{len(left)} rows, SQL gives {len(right)}"
    bad = [(x, y) for x, y in zip(left, right) if x != y]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


def check(spark, con, folder: str, name: str) -> tuple[str | None, int, float]:
    start = time.perf_counter()
    got = QUERIES[name](spark, folder).toArrow()
    seconds = time.perf_counter() - start
    if name not in ORACLES:
        return None, got.num_rows, seconds
    return differences(got, con.sql(ORACLES[name]).to_arrow_table()), got.num_rows, seconds


def main() -> int:
    from gapline.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    registry.load()
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    ran = failed = 0
    for name in QUERIES:
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            problem, rows, seconds = check(spark, con, folder, name)
        except Exception as e:  # noqa: BLE001
            problem, rows, seconds = f"{type(e).__name__}: {str(e)[:600]}", -1, 0.0
            if len(wanted) == 1:
                traceback.print_exc()
        ran, failed = ran + 1, failed + (problem is not None)
        mark = "BAD " if problem else ("ok  " if name in ORACLES else "rows")
        print(f"{mark} {name} {rows} {seconds:.2f}s {problem or ''}", flush=True)
    print(f"{failed} of {ran} failed; {len(QUERIES)} registered, {len(ORACLES)} with SQL")
    return 1 if failed or not ran else 0


if __name__ == "__main__":
    sys.exit(main())
