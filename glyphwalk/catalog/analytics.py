"""Relational analytics over ``events``, ``labels`` and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphwalk.catalog._registry import read, registry
from glyphwalk.operators import analytics as an

QUERIES, query = registry()


def _events(spark, sf):
    return read(spark, sf, "events").withColumn("bucket", (F.col("user_id") % 4).cast("int"))


@query("""SELECT event_type, user_id % 4 AS bucket, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY event_type), 6) AS share
  FROM events GROUP BY event_type, user_id % 4""")
def bias_profile(spark, sf):
    found = an.shares(_events(spark, sf), ["event_type", "bucket"], ["event_type"])
    return found.select("event_type", F.col("bucket").cast("long").alias("bucket"), "n", F.round("share", 6).alias("share"))


BANDS = "(SELECT user_id, floor(value / 50)::BIGINT AS band, count(*) AS n FROM events GROUP BY ALL)"


@query(f"SELECT e.user_id, b.band, coalesce(n, 0) AS n FROM (SELECT DISTINCT user_id FROM {BANDS}) e, (SELECT DISTINCT band FROM {BANDS}) b LEFT JOIN {BANDS} r ON r.user_id = e.user_id AND r.band = b.band")
def bias_densified(spark, sf):
    counted = read(spark, sf, "events").groupBy("user_id", F.floor(F.col("value") / 50).alias("band")).agg(F.count(F.lit(1)).alias("n"))
    return an.densify(counted, ["user_id"], ["band"], {"n": 0})


@query("""WITH o AS (SELECT event_type, count(*) FILTER (user_id % 2 = 0) AS o, count(*) FILTER (user_id % 2 = 1) AS e FROM events GROUP BY event_type)
  SELECT round(sum(pow(o - e, 2) / e), 6) AS statistic, count(*) - 1 AS df FROM o WHERE e > 0""")
def bias_chi2(spark, sf):
    by = lambda r: read(spark, sf, "events").where(F.col("user_id") % 2 == r).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return an.chi_square(by(0), by(1), ["event_type"]).select(F.round("statistic", 6).alias("statistic"), "df")


@query("SELECT event_id, user_id, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM events")
def cumulative_results(spark, sf):
    found = an.running(read(spark, sf, "events"), (F.col("event_type") == "purchase").cast("long"), ["ts", "event_id"], ["user_id"])
    return found.select("event_id", "user_id", "running")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def dedupe_keep_first(spark, sf):
    return an.keep_first(read(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("""SELECT event_type, round(max(event_id)::DOUBLE / nullif(max(epoch_us(ts) // 1000000) - 1704067200, 0), 6) AS rate FROM events GROUP BY event_type""")
def throughput(spark, sf):
    timed = read(spark, sf, "events").withColumn("seconds", F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)"))
    return an.throughput(timed, "event_id", "seconds", ["event_type"]).withColumn("rate", F.round("rate", 6))


@query("SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type")
def share_of_total(spark, sf):
    return an.shares(read(spark, sf, "events"), ["event_type"]).withColumn("share", F.round("share", 6))


@query("SELECT user_id, n FROM (SELECT user_id, count(*) AS n, min(event_id) AS first FROM events GROUP BY user_id) ORDER BY n DESC, first LIMIT 10")
def top_n_common(spark, sf):
    return an.most_common(read(spark, sf, "events"), "user_id", 10, "event_id")


@query("SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::BIGINT AS position, ((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 8)::BIGINT AS batch FROM events")
def cumcount(spark, sf):
    placed = an.position(read(spark, sf, "events"), ["event_id"], ["user_id"])
    return an.in_batches(placed, 8, ["event_id"], ["user_id"]).select("event_id", F.col("position").cast("long").alias("position"), "batch")


LOG = [("prefix", "the man"), ("num_results", "3"), ("message", "ok"), ("prefix", "a"), ("message", "timed out"), ("prefix", "b"), ("num_results", "0"), ("message", "ok")]


@query("SELECT * FROM (VALUES (1, 'ok', '3', 'the man'), (2, 'timed out', NULL, 'a'), (3, 'ok', '0', 'b')) v(record, message, num_results, prefix)")
def attempts_pivot(spark, sf):
    log = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(LOG)], "line int, key string, value string")
    return an.widen(log, "prefix", "line").select(F.col("record").cast("int").alias("record"), "message", "num_results", "prefix")


@query("SELECT k, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT json_extract(props, '$.k')::BIGINT AS k, value FROM events) GROUP BY k")
def props_totals(spark, sf):
    parsed = read(spark, sf, "events").select(F.from_json("props", "k long").getField("k").alias("k"), "value")
    return parsed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""SELECT event_id FROM (SELECT event_id, -ln((('0x' || substr(md5('3:' || event_id), 1, 8))::BIGINT + 1)::DOUBLE / 4294967297.0) / value AS k FROM events WHERE value > 0) ORDER BY k, event_id LIMIT 100""")
def sample_without_replacement(spark, sf):
    return an.weighted_sample(read(spark, sf, "events"), "value", 100, 3, "event_id").select("event_id")


@query("SELECT lang, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY CUBE (lang, quality)")
def label_cube(spark, sf):
    both = read(spark, sf, "documents").select("doc_id", "lang").join(read(spark, sf, "labels"), "doc_id")
    return both.cube("lang", "quality").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, CASE WHEN v IS NULL THEN NULL WHEN v < 300 THEN true ELSE false END AS valid FROM (SELECT user_id, max(value) FILTER (event_type = 'error') AS v FROM events GROUP BY user_id)")
def null_aware_flag(spark, sf):
    worst = read(spark, sf, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "error", F.col("value"))).alias("v"))
    return worst.select("user_id", (F.col("v") < 300).alias("valid"))


@query("SELECT doc_id, n, source FROM (SELECT doc_id, 1 AS n, 'label' AS source FROM labels UNION ALL SELECT doc_id, NULL, 'document' FROM documents)")
def union_all(spark, sf):
    a = read(spark, sf, "labels").select("doc_id", F.lit(1).alias("n"), F.lit("label").alias("source"))
    b = read(spark, sf, "documents").select("doc_id", F.lit("document").alias("source"))
    return a.unionByName(b, allowMissingColumns=True)
