"""Run queries against their SQL: python -m tests.compare [sf] [names...]."""

from __future__ import annotations

import hashlib
import math
import sys
import time

import duckdb

from __spark_entry__ import oracle_sql, queries
from corpusloom.plans.queries import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value: object) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def digest(columns: list[str], rows: list[tuple]) -> tuple[list[str], int, str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("\x1f".join(plain(r[i]) for i in order) for r in rows)
    return [columns[i] for i in order], len(rows), hashlib.sha256("\x1e".join(lines).encode()).hexdigest()


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    df = queries()[name](spark, sf_dir)
    mine = digest(df.columns, [tuple(r) for r in df.collect()])
    sql = oracle_sql().get(name)
    if sql is None:
        return True, f"{mine[1]} rows (no SQL)"
    cursor = con.execute(sql)
    theirs = digest([d[0] for d in cursor.description], cursor.fetchall())
    return mine == theirs, f"{mine[1]} rows, SQL {theirs[1]}" + ("" if mine[0] == theirs[0] else f" {mine[0]} {theirs[0]}")


def show_difference(spark, con, sf_dir: str, name: str, limit: int = 3) -> None:
    df = queries()[name](spark, sf_dir)
    cursor = con.execute(oracle_sql()[name])
    theirs_columns = [d[0] for d in cursor.description]
    columns = sorted(set(df.columns) & set(theirs_columns))
    mine = {tuple(plain(r[c]) for c in columns) for r in df.collect()}
    theirs = {tuple(plain(r[theirs_columns.index(c)]) for c in columns) for r in cursor.fetchall()}
    print("  columns", columns)
    for label, rows in (("only Spark", mine - theirs), ("only SQL", theirs - mine)):
        for row in sorted(rows)[:limit]:
            print("  ", label, [v[:200] for v in row])


if __name__ == "__main__":
    from corpusloom.session import get_spark

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(queries())
    session = get_spark("compare", "local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    folder = f"/root/testdata/sf{sf}"
    connection = duck(folder)
    bad = []
    for query_name in names:
        start = time.time()
        try:
            ok, note = compare(session, connection, folder, query_name)
        except Exception as error:  # noqa: BLE001
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'ok  ' if ok else 'DIFF'} {query_name} {time.time() - start:.2f}s {note}", flush=True)
        if not ok:
            bad.append(query_name)
            if "rows" in note:
                show_difference(session, connection, folder, query_name)
    print(f"{len(names) - len(bad)} of {len(names)} agree; differ: {bad}")
