"""Queries over the test tables, one or more per operator, with equivalent DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (t), where t(name) is a table and t.spark the session."""

    def add(function):
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")

        def run(spark, sf_dir):
            from sparkloom.session import table

            def t(n):
                return table(spark, sf_dir, n)

            t.spark, t.dir = spark, sf_dir
            return function(t)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def load() -> tuple[dict, dict]:
    from sparkloom.suite import relational, scalars, sources, tables  # noqa: F401

    return QUERIES, SQL
