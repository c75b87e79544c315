"""Named queries over the test tables, each next to the SQL that must give the same rows.

The SQL may name views (``v_…``) and shared parts (``d_…``); both are put in front of it as
common table expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from layover.sources import testviews

MODULES = ["audit", "passengers", "text", "inventory", "versions", "decisions", "seats", "tables", "streams"]

RUN: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
PARTS: dict[str, str] = {}


class Tables:
    """The test tables as disruption tables: ``t.exec``, ``t.inventory``, ``t.base("orders")``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if f"v_{name}" not in testviews.VIEWS:
            raise AttributeError(name)
        return testviews.spark_view(self.spark, self.sf_dir, f"v_{name}")

    def base(self, name: str) -> DataFrame:
        return testviews.base_table(self.spark, self.sf_dir, name)


def query(name: str, oracle: str | None = None):
    """Register a query under a name, with its oracle SQL where SQL can say the same."""

    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Tables(spark, sf_dir))

        if name in RUN:
            raise ValueError(f"query {name} is registered twice")
        RUN[name] = run
        if oracle:
            ORACLE[name] = oracle
        return build

    return register


def part(name: str, sql: str) -> None:
    """Register a shared piece of oracle SQL."""
    PARTS[name] = sql.strip()


def with_parts(sql: str) -> str:
    """Put every view and part a statement names, directly or not, in front of it."""
    found: dict[str, str] = {}

    def visit(text: str) -> None:
        for name in re.findall(r"\b[vd]_[a-z_]+\b", text):
            body = testviews.oracle_view(name) if name in testviews.VIEWS else PARTS.get(name)
            if body is not None and name not in found:
                visit(body)
                found[name] = body

    visit(sql)
    if not found:
        return sql.strip()
    ctes = ",\n".join(f"{name} AS (\n{body}\n)" for name, body in found.items())
    return f"WITH {ctes}\n{sql.strip()}"


def load() -> None:
    for module in MODULES:
        import_module(f"layover.registry.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return dict(RUN)


def oracle_sql() -> dict[str, str]:
    load()
    return {name: with_parts(sql) for name, sql in ORACLE.items()}
