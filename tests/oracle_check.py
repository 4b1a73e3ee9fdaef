"""Run registered queries against DuckDB: ``python tests/oracle_check.py [sf] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from spanveil.sources.readers import TABLES  # noqa: E402


def duck(directory: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{directory}/{table}.parquet')"
        )
    return connection


def _cell(value):
    if isinstance(value, float):
        return round(value, 6)
    return value


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, connection, query, sql: str, directory: str) -> str | None:
    """What is wrong, or nothing."""
    df = query(spark, directory)
    got = rows_of(df.columns, df.collect())
    result = connection.sql(sql)
    want = rows_of(result.columns, result.fetchall())
    if sorted(df.columns) != sorted(result.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(result.columns)}"
    if got == want:
        return None
    extra = [r for r in got if r not in set(want)][:2] if len(got) < 50000 else []
    missing = [r for r in want if r not in set(got)][:2] if len(got) < 50000 else []
    return f"{len(got)} rows instead of {len(want)}\n  extra {extra}\n  missing {missing}"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import make_session

    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    directory = f"/root/testdata/sf{scale}"
    spark, connection = make_session(), duck(directory)
    sql, bad = oracle_sql(), 0
    for name, query in queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        began = time.time()
        try:
            wrong = difference(spark, connection, query, sql[name], directory)
        except Exception as error:  # noqa: BLE001 - a report of all queries is wanted
            wrong = f"{type(error).__name__}: {str(error)[:600]}"
        bad += wrong is not None
        print(f"{'ok  ' if wrong is None else 'BAD '} {name} {time.time() - began:.1f}s {wrong or ''}"[:3000], flush=True)
    print(f"{bad} wrong; no SQL for {sorted(set(queries()) - set(sql))}; unused {sorted(set(sql) - set(queries()))}")


if __name__ == "__main__":
    main()
