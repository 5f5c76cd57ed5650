"""The table of named queries, each with its plain-SQL equivalent where one exists."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from specaudit.session import bound_broadcasts
from specaudit.sources.views import SQL_VIEWS, VIEWS, Model, with_views

_BUILDERS: dict[str, Callable[[Model], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(build: Callable[[Model], DataFrame]):
        if name in _BUILDERS:
            raise ValueError(f"two queries are named {name}")
        _BUILDERS[name] = build
        if sql is not None:
            _SQL[name] = sql
        return build

    return keep


def builders() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build):
        def run(spark, folder):
            bound_broadcasts(spark)
            return build(Model(spark, folder))

        return run

    return {name: bind(build) for name, build in _BUILDERS.items()}


def oracles() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in _SQL.items()}


def result(name: str, model: Model) -> DataFrame:
    return _BUILDERS[name](model)


def sql(name: str) -> str:
    return _SQL[name].strip()


def braced(text: str) -> str:
    """Mark the view names in finished SQL, so it can itself become a shared fragment."""
    known = VIEWS | SQL_VIEWS
    return re.sub(r"\b[as]_[a-z_]+\b", lambda m: "{" + m.group(0) + "}" if m.group(0) in known else m.group(0), text)
