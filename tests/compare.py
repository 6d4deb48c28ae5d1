"""Runs SQL in DuckDB over a folder's tables and compares it with a DataFrame, without regard to order."""

import decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def assert_same(df, con, sql: str) -> int:
    names = sorted(df.columns)
    found = con.sql(sql)
    assert sorted(found.columns) == names
    ours = sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=repr)
    theirs = sorted((tuple(map(plain, r)) for r in found.project(",".join(f'"{n}"' for n in names)).fetchall()), key=repr)
    assert ours == theirs
    return len(ours)
