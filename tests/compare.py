"""Run registered queries beside their SQL: ``python -m tests.compare [folder] [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    """Rows as text, columns by name, in sorted order."""
    frame = frame[sorted(frame.columns)]
    rows = frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)
    return sorted(tuple(_text(value) for value in row) for row in rows)


def _text(value: object) -> str:
    if value is None:
        return "\\N"
    if hasattr(value, "isoformat"):
        return value.isoformat()[:26]
    if isinstance(value, float):
        return repr(float(value))
    return str(value)


def check(spark, con, name: str, query, sql: str | None, folder: str) -> str:
    start = time.time()
    result = query(spark, folder)
    ours = result.toPandas()
    took = time.time() - start
    if sql is None:
        return f"rows only ({len(ours)}) {took:.1f}s"
    start = time.time()
    theirs = con.execute(sql).df()
    other = time.time() - start
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"COLUMNS {sorted(ours.columns)} / {sorted(theirs.columns)}"
    a, b = canonical(ours), canonical(theirs)
    if len(a) != len(b):
        return f"ROWS {len(a)} / {len(b)}"
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"VALUES {len(bad)} of {len(a)}: {bad[0]}"
    return f"ok {len(a)} rows, {took:.1f}s, sql {other:.1f}s"


def main() -> None:
    import __spark_entry__ as entry
    from tickloom.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = build_session(cores="8"), connect(folder)
    sql = entry.oracle_sql()
    assert set(sql) <= set(entry.queries()), set(sql) - set(entry.queries())
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            print(f"{name:28s}", check(spark, con, name, query, sql.get(name), folder), flush=True)
        except Exception as error:  # noqa: BLE001
            print(f"{name:28s} ERROR {str(error)[:700]}", flush=True)


if __name__ == "__main__":
    main()
