"""Collects queries by key, and puts together the SQL they are checked against."""

from __future__ import annotations

import textwrap
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
RECIPES: dict[str, tuple[tuple[str, ...], str]] = {}


def recipe(name: str, sql: str, needs: tuple[str, ...] = ()) -> None:
    """A named input in SQL; its Spark side is the function of the same name."""
    RECIPES[name] = (needs, textwrap.dedent(sql).strip())


def _ordered(names: tuple[str, ...], done: list[str]) -> list[str]:
    for name in names:
        if name not in done:
            _ordered(RECIPES[name][0], done)
            done.append(name)
    return done


def sql_with(names: tuple[str, ...], body: str) -> str:
    """``body`` behind the recipes it reads from."""
    body = textwrap.dedent(body).strip()
    parts = [f"{name} AS (\n{RECIPES[name][1]}\n)" for name in _ordered(names, [])]
    return f"WITH {', '.join(parts)}\n{body}" if parts else body


def query(key: str, sql: str | None = None, needs: tuple[str, ...] = ()):
    """Registers a query, with its SQL where one exists."""
    def register(function: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = function
        if sql is not None:
            ORACLES[key] = sql_with(needs, sql)
        return function
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
