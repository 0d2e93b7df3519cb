"""Compares named queries with their SQL twins: rows as sorted text per column name.

Run as a script: python tests/compare.py [folder] [key ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tracelode.sources.tables import NAMES  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def normal(value) -> str:
    if value is None:
        return "\x00"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)


def difference(spark_df, con, text: str) -> str:
    """Empty when both results are equal, else what differs first."""
    mine = spark_df.columns
    theirs = con.execute(text)
    names = [d[0] for d in theirs.description]
    if sorted(mine) != sorted(names):
        return f"columns {sorted(mine)} / {sorted(names)}"
    expected = rows_of(names, theirs.fetchall())
    found = rows_of(mine, spark_df.collect())
    if len(found) != len(expected):
        return f"rows {len(found)} / {len(expected)}"
    bad = [(a, b) for a, b in zip(found, expected) if a != b]
    return f"{len(bad)} of {len(found)} rows differ, first {bad[0]}" if bad else ""


def main() -> None:
    import __spark_entry__ as entry
    from tracelode.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", 8, spark__driver__memory="12g", spark__ui__enabled="false",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracle = entry.oracle_sql()
    for key, fn in entry.queries().items():
        if sys.argv[2:] and key not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            if key in oracle:
                result = difference(fn(spark, folder), con, oracle[key]) or "ok"
            else:
                result = f"rows only: {len(fn(spark, folder).collect())}"
        except Exception as error:  # report and go on with the next key
            result = "FAILED " + str(error)[:700]
        print(f"{key:28s} {time.time() - start:6.2f}s {result}", flush=True)


if __name__ == "__main__":
    main()
