"""Registered queries over the test tables and the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphwalk.catalog import analytics, automata, models, searches, sources, text

MODULES = (text, models, automata, searches, analytics, sources)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searches.QUERIES["search_shortest_path"][0](spark, sf_dir)


def queries() -> dict:
    return {name: run for m in MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
