"""Keeps each query next to the SQL that must return the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        if key in QUERIES:
            raise KeyError(f"query {key} is registered twice")
        QUERIES[key] = run
        if sql is not None:
            SQL[key] = with_views(sql)
        return run

    return add


def with_views(sql: str) -> str:
    """Put the definitions of the views a statement mentions in front of it.

    A statement that starts with a comma adds definitions of its own.
    """
    needed: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)  # before descending: a recursive view mentions itself
                visit(VIEWS[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql.strip()
    return "with recursive " + ",\n".join(f"{n} as ({VIEWS[n]})" for n in needed) + "\n" + sql.strip()
