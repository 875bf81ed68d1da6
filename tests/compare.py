"""Runs a registered query and its SQL twin and compares the results."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if hasattr(value, "isoformat"):
        return value.isoformat(sep=" ")
    return value


def _bag(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def _family(type_name: str) -> str:
    for family, names in {
        "integer": ("BIGINT", "INTEGER", "bigint", "int", "HUGEINT"),
        "double": ("DOUBLE", "double"),
        "text": ("VARCHAR", "string"),
        "boolean": ("BOOLEAN", "boolean"),
        "timestamp": ("TIMESTAMP", "timestamp"),
    }.items():
        if type_name in names:
            return family
    return type_name


def differences(df, con, sql: str) -> list[str]:
    """Empty when names, types and the bag of rows agree."""
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    types = {c[0]: _family(str(c[1])) for c in cursor.description}
    expected = _bag(names, cursor.fetchall())
    found = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} instead of {sorted(names)}"]
    for name, kind in df.dtypes:
        if _family(kind) != types[name]:
            found.append(f"type of {name}: {kind} instead of {types[name]}")
    actual = _bag(df.columns, [tuple(r) for r in df.collect()])
    if actual != expected:
        only_spark, only_sql = actual - expected, expected - actual
        found.append(f"{sum(actual.values())} rows instead of {sum(expected.values())}")
        found.append(f"only spark {len(only_spark)}: {list(only_spark)[:3]}")
        found.append(f"only sql {len(only_sql)}: {list(only_sql)[:3]}")
    return found
