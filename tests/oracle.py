"""Runs a registered query in Spark and its SQL in DuckDB and compares all rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(name, spark_df, con, sql):
    """A message about the first difference, or None."""
    result = con.execute(sql)
    sql_columns = [d[0] for d in result.description]
    sql_types = {d[0]: str(d[1]) for d in result.description}
    expected = as_rows(sql_columns, result.fetchall())
    got = as_rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(sql_columns) != sorted(spark_df.columns):
        return f"{name}: columns {sorted(spark_df.columns)} against {sorted(sql_columns)}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for column, kind in spark_df.dtypes:
        if kinds.get(kind) != sql_types[column]:
            return f"{name}: column {column} is {kind} against {sql_types[column]}"
    if len(got) != len(expected):
        return f"{name}: {len(got)} rows against {len(expected)}"
    for mine, theirs in zip(got, expected):
        if mine != theirs:
            return f"{name}: {str(mine)[:600]}\n   against {str(theirs)[:600]}"
    return None
