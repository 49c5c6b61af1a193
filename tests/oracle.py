"""Runs a query and its DuckDB SQL on the same tables and compares them."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return names, got.fetchall()


def plain(value):
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value)
    try:
        return f"{float(value):.9g}"
    except (TypeError, ValueError):
        return str(value)


def assert_same(df, sql: str, sf_dir: str):
    names, expected = oracle_rows(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    columns = sorted(names)
    left = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    at = [names.index(c) for c in columns]
    right = sorted(tuple(plain(r[i]) for i in at) for r in expected)
    assert len(left) == len(right)
    assert [x for x in zip(left, right) if x[0] != x[1]][:3] == []
