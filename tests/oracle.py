"""Spark results against the same in SQL, on the generated tables or on small ones."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings sample_portfolio sample_portfolio_lines numeric_records ingestion_events chunks ref_symbols ref_sectors source_registry mix_targets".split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v + 0.0:.8g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def differences(spark_rows, columns, con, sql) -> list:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(columns)
    order = [names.index(c) for c in columns]
    want = sorted(str(tuple(_plain(r[i]) for i in order)) for r in cur.fetchall())
    got = sorted(str(tuple(_plain(x) for x in r)) for r in spark_rows)
    return [(a, b) for a, b in zip(got, want) if a != b] + ([("rows", len(got), len(want))] if len(got) != len(want) else [])
