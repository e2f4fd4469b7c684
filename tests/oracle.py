"""Side-by-side run of a registered query and its SQL oracle."""

from __future__ import annotations

import glob
import hashlib
import os
import sys
import time

import duckdb

KINDS = {"i": "int", "u": "int", "f": "float", "b": "bool"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(row[i] for i in order) for row in rows), key=lambda r: tuple((v is None, str(v)) for v in r)
    )


def digest(rows: list[tuple]) -> str:
    h = hashlib.md5()
    for row in rows:
        h.update(repr(row).encode())
    return h.hexdigest()


def compare(spark, con, folder: str, name: str, build, sql: str) -> str | None:
    """None when equal, else a description of the first difference."""
    df = build(spark, folder)
    left_columns, left = canonical(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    right_columns, right = canonical([d[0] for d in result.description], result.fetchall())
    if left_columns != right_columns:
        return f"columns {left_columns} / {right_columns}"
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    if digest(left) != digest(right):
        for a, b in zip(left, right):
            if repr(a) != repr(b):
                return f"{left_columns}\n spark {a}\n duck  {b}"
    return None if left else "both sides are empty"


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from tidemark.session import local_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.ui.explainMode", "simple")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(a in n for a in argv)]
    bad = 0
    for name in names:
        started = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, folder, name, queries[name], oracles[name])
            else:
                rows = len(queries[name](spark, folder).collect())
                problem = None if rows else "no rows"
                name += f" [rows {rows}]"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - started:6.1f}s {name}" + (f"\n  {problem}" if problem else ""), flush=True)
    print(f"{len(names) - bad}/{len(names)} fine")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
