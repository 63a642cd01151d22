"""Run registered queries against their SQL in DuckDB and compare all values."""

from __future__ import annotations

import datetime
import math
from decimal import Decimal
from pathlib import Path

import duckdb


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, Decimal):
        raise TypeError("decimal in a published result")
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, datetime.date):
        return "d" + value.isoformat()
    return value


def _key(row):
    return tuple((v is not None, str(type(v)), v) for v in row)


def rows_of_spark(df):
    columns = sorted(df.columns)
    rows = [tuple(_plain(row[c]) for c in columns) for row in df.select(*columns).collect()]
    return columns, sorted(rows, key=_key)


def rows_of_sql(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(_plain(row[i]) for i in order) for row in cursor.fetchall()]
    return [names[i] for i in order], sorted(rows, key=_key)


TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


def types_of_spark(df):
    return {field.name: TYPES[field.dataType.simpleString()] for field in df.schema.fields}


def types_of_sql(con, sql):
    return {row[0]: row[1] for row in con.execute(f"DESCRIBE {sql}").fetchall()}
