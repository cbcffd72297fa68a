"""Runs registered queries next to their SQL and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def canonical(columns, rows):
    """Rows with columns in name order, sorted."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def spark_rows(df):
    return canonical(df.columns, [tuple(r) for r in df.collect()])


def oracle_rows(connection, sql):
    cursor = connection.execute(sql)
    return canonical([d[0] for d in cursor.description], cursor.fetchall())


def differences(df, connection, sql):
    """None if equal, else a short text."""
    names, got = spark_rows(df)
    expected_names, expected = oracle_rows(connection, sql)
    if names != expected_names:
        return f"columns {names} != {expected_names}"
    if len(got) != len(expected):
        only = [r for r in got if r not in set(expected)][:2] if len(got) < 50_000 else []
        lacking = [r for r in expected if r not in set(got)][:2] if len(got) < 50_000 else []
        return f"{len(got)} rows != {len(expected)}; extra {only}; missing {lacking}"
    for a, b in zip(got, expected):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{a} != {b}"
    return None
