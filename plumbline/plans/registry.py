"""Registered queries: name -> (Spark plan over a table folder, equivalent SQL where one exists)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan taking `Tables`; `sql` is the same result in plain SQL."""

    def wrap(plan):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plan(Tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = plan.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return wrap
