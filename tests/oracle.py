"""Run a query on Spark and its SQL counterpart on DuckDB, and compare."""

from __future__ import annotations

import math
from glob import glob
from pathlib import Path

import duckdb


TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in glob(f"{sf_dir}/*.parquet"):
        db.sql(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return db


def _value(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = [tuple(_value(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(shaped, key=repr)


def spark_rows(df):
    return rows_of(df.columns, [tuple(row) for row in df.collect()])


def spark_types(df):
    return sorted((name, TYPES[kind]) for name, kind in df.dtypes)


def sql_rows(db, sql):
    result = db.sql(sql)
    return rows_of(result.columns, result.fetchall())


def sql_types(db, sql):
    result = db.sql(sql)
    return sorted(zip(result.columns, map(str, result.types), strict=True))
