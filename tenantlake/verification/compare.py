"""Run the registered queries next to their SQL and compare whole results."""

from __future__ import annotations

import math

import duckdb
from pyspark.sql import DataFrame, SparkSession

GIVEN = ("region nation customer supplier part orders lineitem events documents embeddings "
         "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in GIVEN:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def rows_of_spark(df: DataFrame) -> tuple[list[str], list[str]]:
    names = sorted(df.columns)
    return names, sorted(repr(tuple(_plain(r[c]) for c in names)) for r in df.collect())


def rows_of_duckdb(con, sql: str) -> tuple[list[str], list[str]]:
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    names = sorted(columns)
    spots = [columns.index(c) for c in names]
    return names, sorted(repr(tuple(_plain(r[i]) for i in spots)) for r in found.fetchall())


def differences(spark: SparkSession, folder: str, name: str, query, sql: str,
                con=None) -> str | None:
    """None when both give the same rows, else a short text."""
    con = con or connect(folder)
    left_names, left = rows_of_spark(query(spark, folder))
    right_names, right = rows_of_duckdb(con, sql)
    if left_names != right_names:
        return f"{name}: columns {left_names} and {right_names}"
    if left == right:
        return None
    only_left = [r for r in left if r not in set(right)][:2]
    only_right = [r for r in right if r not in set(left)][:2]
    return f"{name}: {len(left)} and {len(right)} rows\n  {only_left}\n  {only_right}"
