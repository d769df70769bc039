"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def plain(value):
    """A value that compares equal between the engines: floats to nine digits, nested values as tuples."""
    if hasattr(value, "asDict"):
        return tuple(plain(x) for x in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    return value


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in data), key=repr)


def spark_rows(df: DataFrame) -> list[tuple]:
    return rows(df.columns, df.collect())


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def duck_rows(con: duckdb.DuckDBPyConnection, sql: str) -> list[tuple]:
    got = con.execute(sql)
    return rows([d[0] for d in got.description], got.fetchall())


def assert_same(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    expected, found = rows(names, got.fetchall()), spark_rows(df)
    assert len(found) == len(expected)
    for a, b in zip(found, expected):
        assert a == b
