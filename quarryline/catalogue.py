"""The catalogue: every operator's query, paired with the SQL that says the same.

``@operator(name, sql)`` registers a function from a ``Views`` to a DataFrame.  The SQL may name
analytic views; ``oracle()`` puts their definitions in front.
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import views

_QUERIES: dict[str, Callable[[views.Views], DataFrame]] = {}
_SQL: dict[str, str] = {}
_MODULES = ("operators.projections", "operators.joins", "operators.aggregates", "operators.windows", "operators.graph", "operators.rules", "operators.selection", "functions.queries", "sources.queries", "sources.python_queries", "sources.script_queries", "streaming.queries", "plans.risk")


def operator(name: str, sql: str | None = None):
    """Register a query under ``name``; without SQL it is checked by tests alone."""

    def keep(f: Callable[[views.Views], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return keep


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"quarryline.{m}")


def with_views(sql: str) -> str:
    """``sql`` with the analytic views it names, and those that they name, defined in front."""
    wanted: set[str] = set()
    new = {sql}
    while new:
        text = " ".join(new)
        found = {v for v in views.SQL if re.search(rf"\b{v}\b", text)} - wanted
        wanted |= found
        new = {views.SQL[v] for v in found}
    if not wanted:
        return sql
    head = ",\n".join(f"{v} AS ({views.SQL[v]})" for v in views.SQL if v in wanted)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        rest = body[5:].lstrip()
        recursive = rest[:10].upper() == "RECURSIVE "
        return f"WITH {'RECURSIVE ' if recursive else ''}{head},\n{rest[10:] if recursive else rest}"
    return f"WITH {head}\n{body}"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, f=f: f(views.Views(spark, sf_dir))) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: with_views(sql) for name, sql in _SQL.items()}
