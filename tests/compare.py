"""Run a query and its SQL and compare the rows, whatever their order."""

from __future__ import annotations

import math
import pathlib

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in sorted(pathlib.Path(sf_dir).glob("*.parquet")):
        connection.execute(f"create view {file.stem} as select * from '{file}'")
    return connection


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    return value


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def differences(df, connection: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty when both give the same columns and rows, else what differs first."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    expected = rows_of(names, result.fetchall())
    actual = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if len(expected) != len(actual):
        return f"{len(actual)} rows against {len(expected)}"
    wrong = [(a, e) for a, e in zip(actual, expected) if a != e]
    if wrong:
        return f"{len(wrong)} rows differ, first {wrong[0]}"
    pairs = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    types = dict(df.dtypes)
    odd = [f"{c}: {types[c]} against {k}" for c, k in kinds.items() if pairs.get(k, k) != types[c]]
    return "; ".join(odd)
