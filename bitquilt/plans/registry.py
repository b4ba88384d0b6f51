"""Registry of queries and of the SQL each is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}
CTES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def add(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def cte(name: str, sql: str) -> None:
    """A named sub-query; names start with `c_` and may use earlier ones."""
    CTES[name] = sql


def _needed(sql: str, seen: list[str]) -> list[str]:
    for name in re.findall(r"\bc_\w+", sql):
        if name in CTES and name not in seen:
            _needed(CTES[name], seen)
            if name not in seen:
                seen.append(name)
    return seen


def full_sql(sql: str) -> str:
    """Prepend the sub-queries a statement needs, in dependency order."""
    names = _needed(sql, [])
    if not names:
        return sql
    parts = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in names)
    return f"WITH {parts}\n{sql}"
