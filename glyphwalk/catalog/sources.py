"""Sources and sinks: tables of the catalog written in each format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphwalk.catalog._registry import read, registry
from glyphwalk.plans.cut import scratch
from glyphwalk.sources import corpora, logs

QUERIES, query = registry()


@query("SELECT md5(text) AS digest, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY md5(text)")
def source_jsonl(spark, sf):
    """Texts as JSON lines."""
    path = scratch(spark)
    read(spark, sf, "documents").select("text").write.json(path)
    return corpora.read_jsonl(spark, path).where("text is not null").groupBy(F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lower(trim(t)) AS word FROM (SELECT unnest(string_split(text, chr(10))) AS t FROM conversations) WHERE trim(t) <> '' GROUP BY 1")
def source_words(spark, sf):
    """Lines of turns as a word list."""
    path = scratch(spark)
    read(spark, sf, "conversations").where("text is not null").select("text").write.text(path)
    return corpora.read_words(spark, path)


@query("SELECT event_type AS url, value AS time, user_id AS token FROM events")
def source_results(spark, sf):
    """Results as JSON objects of parallel lists, one object for each type of event."""
    path = scratch(spark)
    rows = read(spark, sf, "events").select("event_type", "value", F.array(F.col("user_id").cast("int")).alias("tokens"))
    logs.write_results(rows, path, "event_type", "value", "tokens", part="event_type")
    return logs.read_results(spark, path).select(F.col("urls").alias("url"), F.col("times").alias("time"), F.element_at("tokens", 1).cast("long").alias("token"))


@query("SELECT event_id, event_type, value FROM events")
def source_appended_rows(spark, sf):
    """CSV files added to a folder in two goes."""
    path = scratch(spark)
    rows = read(spark, sf, "events").select("event_id", "event_type", "value")
    for error in (True, False):
        logs.append_rows(rows.where((F.col("event_type") == "error") == F.lit(error)), path)
    return logs.read_rows(spark, path, "event_id long, event_type string, value double")
