"""Queries by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.sessions import ORACLE, Session, session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The module that a query is in.
HOME: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir)."""

    def add(f):
        QUERIES[f.__name__] = f
        HOME[f.__name__] = f.__module__.rsplit(".", 1)[-1]
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def on_session(sql: str | None = None, recursive: bool = False):
    """Register a function of a Session; its SQL goes on from the session tables' own. recursive: it has a recursive common table."""

    def add(f: Callable[[Session], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(session(spark, sf_dir))

        run.of = f  # for other queries that build on it
        QUERIES[f.__name__] = run
        HOME[f.__name__] = f.__module__.rsplit(".", 1)[-1]
        if sql:
            SQL[f.__name__] = (ORACLE.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else ORACLE) + sql
        return run

    return add
