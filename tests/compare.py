"""Run catalogue queries against their SQL checks: python tests/compare.py FOLDER [name ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(shown, key=repr)


def differences(spark_df, con, sql: str) -> list[str]:
    """What differs between the two results, at most a few lines; empty if equal."""
    table = spark_df.toArrow()
    got_columns, got = _rows(table.column_names, [tuple(r.values()) for r in table.to_pylist()])
    result = con.execute(sql)
    want_columns, want = _rows([d[0] for d in result.description], result.fetchall())
    if got_columns != want_columns:
        return [f"columns {got_columns} != {want_columns}"]
    if len(got) != len(want):
        return [f"rows {len(got)} != {len(want)}", f"got {got[:2]}", f"want {want[:2]}"]
    found = []
    for g, w in zip(got, want):
        if repr(g) != repr(w):
            found.append(f"got  {g}\n    want {w}")
        if len(found) == 3:
            break
    return found


def main() -> None:
    from plumbline.catalog import QUERIES
    from plumbline.session import local_session

    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = local_session()
    con = database(folder)
    failed = 0
    for name in names:
        query = QUERIES[name]
        start = time.time()
        try:
            if query.sql is None:
                found, note = [], f"{query(spark, folder).count()} rows, no SQL"
            else:
                found, note = differences(query(spark, folder), con, query.sql), "ok"
        except Exception as error:
            found = [f"{type(error).__name__}: {str(error)[:1500]}"]
        failed += bool(found)
        print(f"{'FAIL' if found else note:>18}  {time.time() - start:6.1f}s  {name}", flush=True)
        for line in found:
            print("    " + line, flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")


if __name__ == "__main__":
    main()
