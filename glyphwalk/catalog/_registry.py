"""Helpers of the catalog modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphwalk.plans.spread import spread


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def registry() -> tuple[dict, Callable]:
    """A dict of queries and the decorator that fills it with (function, SQL)."""
    found: dict[str, tuple[Callable, str | None]] = {}

    def query(sql: str | None = None):
        def keep(f):
            found[f.__name__] = (f, sql)
            return f

        return keep

    return found, query
