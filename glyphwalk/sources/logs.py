"""Result and attempt logs: JSON results, key-value CSV, automata dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphwalk.operators.analytics import widen
from glyphwalk.plans.automaton import Automaton

RESULTS = "urls array<string>, times array<double>, tokens array<array<int>>"


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(urls, times, tokens), one row per result, from JSON objects of three parallel lists."""
    return spark.read.schema(RESULTS).json(path, multiLine=True).select(F.inline(F.arrays_zip("urls", "times", "tokens")))


def write_results(results: DataFrame, path: str, text: str = "text", time: str = "time", tokens: str = "tokens", part: str | None = None) -> None:
    """Results as JSON objects of parallel lists ordered by time; one object per value of ``part``."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.col(text).alias("u"), F.col(tokens).alias("k"))))
    grouped = results.groupBy(*([part] if part else [])).agg(rows.alias("r"))
    pick = lambda name: F.transform("r", lambda x: x[name])
    grouped.select(pick("u").alias("urls"), pick("t").alias("times"), pick("k").alias("tokens")).write.option("maxRecordsPerFile", 1).json(path)  # an object a file: they may span lines


def read_attempts(spark: SparkSession, path: str, first_key: str) -> DataFrame:
    """Wide rows from a CSV of (key, value) lines; a record starts at ``first_key``. Lines keep their order within the file."""
    lines = spark.read.schema("key string, value string").csv(path).withColumn("line", F.monotonically_increasing_id())
    return widen(lines, first_key, "line")


def append_rows(rows: DataFrame, path: str) -> None:
    """Adds CSV files to the folder; nothing that is there is rewritten."""
    rows.write.mode("append").option("header", True).csv(path)


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_automaton(spark: SparkSession, automaton: Automaton, path: str) -> None:
    """Arcs and states as two Parquet tables."""
    automaton.edges(spark).write.parquet(f"{path}/edges")
    automaton.states(spark).write.parquet(f"{path}/states")


def read_automaton(spark: SparkSession, path: str) -> Automaton:
    """An automaton that ``write_automaton`` wrote; plans are small by nature, so it is read whole."""
    states = {r["state"]: r["is_final"] for r in spark.read.parquet(f"{path}/states").collect()}
    arcs: list[list] = [[] for _ in states]
    for r in spark.read.parquet(f"{path}/edges").collect():
        arcs[r["src"]].append((r["lo"], r["hi"], r["dst"]))
    return Automaton(tuple(tuple(sorted(a)) for a in arcs), frozenset(s for s, final in states.items() if final))
