"""Runs registered queries against their SQL: python tests/check_sql.py [folder] [name part ...]."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return int(value)
    number = float(value)
    return None if math.isnan(number) else number + 0.0


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(columns: list[str], rows: list, connection, sql: str) -> str | None:
    """None when the rows agree, else what differs."""
    result = connection.execute(sql)
    expected_columns = [d[0] for d in result.description]
    expected = rows_of(expected_columns, result.fetchall())
    if sorted(columns) != sorted(expected_columns):
        return f"columns {sorted(columns)} != {sorted(expected_columns)}"
    found = rows_of(columns, rows)
    if len(found) != len(expected):
        return f"{len(found)} rows != {len(expected)}"
    wrong = [(a, b) for a, b in zip(found, expected) if a != b]
    return f"{len(wrong)} of {len(found)} rows differ, first {wrong[0]}" if wrong else None


def main() -> int:
    import __spark_entry__ as entry

    from vecflow.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, connection = local_session(8), connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, run in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        took = 0.0
        try:
            df = run(spark, folder)
            rows = df.collect()
            took = time.time() - start
            problem = compare(df.columns, rows, connection, oracles[name]) if name in oracles else None
            note = "" if name in oracles else f" rows only: {len(rows)}"
        except Exception as error:  # reported, the others still run
            problem, note = f"{type(error).__name__}: {str(error)[:600]}", ""
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {took:.1f}s + {time.time() - start - took:.1f}s{note} {problem or ''}", flush=True)
    print(f"{bad} failed of {len(queries)}, {len(oracles)} with SQL")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
