"""Query registry: one Spark callable and, where SQL can say it, one oracle string."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.lens_sql import with_clause

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    """Register ``fn(spark, sf_dir)``. ``sql`` may start with further CTEs; the lens CTEs it
    names in ``ctes`` (and those they need) are put in front."""

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_clause(ctes, sql)
        return fn

    return deco
