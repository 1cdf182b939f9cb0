"""The registered queries opN_<name> and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphwalk.llm import audio, chaining, chat_format, chosen_path, decontaminate, lm_scoring, mixing, quality, suffix_dedup, url_filter
from glyphwalk.plans.spread import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w
  FROM d GROUP BY source),
r(i, n, share, free) AS (
  SELECT 0, 0::BIGINT, (SELECT sum(source_size) FROM s)::BIGINT, (SELECT sum(w) FROM s)::BIGINT
  UNION ALL
  SELECT i + 1, n2, share2, free2 FROM (
    SELECT r.i, r.n,
           count(*) FILTER (3 * source_size * free <= share * w)::BIGINT AS n2,
           ((SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) FILTER (3 * source_size * free <= share * w), 0))::BIGINT AS share2,
           coalesce(sum(w) FILTER (NOT 3 * source_size * free <= share * w), 0)::BIGINT AS free2
    FROM r, s GROUP BY r.i, r.n)
  WHERE n2 > n AND free2 > 0),
f AS (SELECT share, free FROM r ORDER BY i DESC LIMIT 1),
t AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, share::DOUBLE * w / free::DOUBLE) AS target
  FROM s, f),
p AS (
  SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d)
SELECT doc_id, size, source_size, target,
       (e * size + greatest(0, least(size, floor(target)::BIGINT - e * source_size - before)))::BIGINT AS taken
FROM (SELECT p.doc_id, p.size, p.before, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN floor(t.target)::BIGINT // t.source_size ELSE 0 END AS e
      FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
"""


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def _like(column: str, glob: str) -> str:
    plain = glob.replace("|", "||").replace("%", "|%").replace("_", "|_").replace("*", "%")
    return f"{column} LIKE '{plain}' ESCAPE '|'"


#: What no rule fits is judged by the first glob that fits host and path.
_GLOBS = "\n            ".join(f"WHEN {_like('host', h)} AND {_like('path', p)} THEN '{v}'" for h, p, v in url_filter.GLOBS)
OP2_SQL = rf"""
WITH r AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE
                    regexp_replace(substr(url, strpos(url, '://') + 3), '(?s)[?#].*$', '') END AS rest FROM pages),
p AS (SELECT page_id,
             translate(CASE WHEN strpos(rest, '/') = 0 THEN rest ELSE substr(rest, 1, strpos(rest, '/') - 1) END,
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             CASE WHEN strpos(rest, '/') = 0 THEN '' ELSE substr(rest, strpos(rest, '/')) END AS path FROM r),
j AS (SELECT page_id, host, path, '.' || host AS h,
             CASE WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                  WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                  WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                  WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            {_GLOBS}
            ELSE 'allow' END AS verdict
FROM j
"""


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.collapse(table(spark, sf_dir, "conversations"))


OP3_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) - 1 AS pos FROM t),
c AS (SELECT conv_id, count(*)::BIGINT AS n, list({'r': role, 't': text} ORDER BY pos) AS l FROM q GROUP BY conv_id),
p AS (SELECT conv_id, pos // 256 AS part,
             string_agg('<|im_start|>' || replace(coalesce(role, ''), '<|', '< |') || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS s
      FROM q GROUP BY conv_id, pos // 256),
h AS (SELECT a.conv_id, a.n, b.conv_id AS kept_id, row_number() OVER (PARTITION BY a.conv_id ORDER BY b.n DESC, b.conv_id NULLS FIRST) AS k
      FROM c a JOIN c b ON b.l[1] = a.l[1] AND b.n >= a.n AND list_slice(b.l, 1, a.n) = a.l)
SELECT h.conv_id, p.part::BIGINT AS part, n AS n_turns, true AS kept, kept_id, s AS rendered
FROM h JOIN p ON p.conv_id IS NOT DISTINCT FROM h.conv_id WHERE k = 1 AND h.conv_id IS NOT DISTINCT FROM kept_id
UNION ALL
SELECT conv_id, 0, n, false, kept_id, NULL FROM h WHERE k = 1 AND conv_id IS DISTINCT FROM kept_id
"""


def op4_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.find_passages(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op6_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.media_digest(table(spark, sf_dir, "documents"))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start_word", "n_words", F.round("similarity", 6).alias("similarity"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS item FROM benchmark),
bi AS (SELECT item_id, row_number() OVER () AS iv, item, len(item) AS n, least(5, len(item)) AS k FROM b WHERE len(item) > 0),
ds AS (SELECT doc_id, len(words) AS total, k, unnest(range(0, len(words) - k + 1)) AS pos, words FROM d, (SELECT DISTINCT k FROM bi) WHERE len(words) >= k),
dh AS (SELECT doc_id, total, k, pos, array_to_string(words[pos + 1:pos + k], ' ') AS s FROM ds),
bs AS (SELECT item_id, iv, n, k, unnest(range(0, n - k + 1)) AS q, item FROM bi),
bh AS (SELECT item_id, iv, n, k, q, array_to_string(item[q + 1:q + k], ' ') AS s FROM bs),
w AS (SELECT DISTINCT doc_id, item_id, iv, n, k, greatest(0, least(pos - q, total - n)) AS start FROM dh JOIN bh USING (k, s)),
x AS (SELECT w.doc_id, w.item_id, w.iv, w.n, w.start, dh.s, count(*) AS a FROM w JOIN dh ON dh.doc_id = w.doc_id AND dh.k = w.k AND dh.pos BETWEEN w.start AND w.start + w.n - w.k GROUP BY ALL),
y AS (SELECT w.doc_id, w.item_id, w.iv, w.n, w.start, bh.s, count(*) AS b FROM w JOIN bh ON bh.iv = w.iv GROUP BY ALL),
z AS (SELECT doc_id, item_id, iv, n, start, sum(least(coalesce(a, 0), coalesce(b, 0))) AS shared, sum(greatest(coalesce(a, 0), coalesce(b, 0))) AS united
      FROM x FULL JOIN y USING (doc_id, item_id, iv, n, start, s) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared::DOUBLE / united DESC, start) AS k FROM z WHERE shared >= 0.8 * united)
SELECT doc_id, item_id, start::BIGINT AS start_word, n::BIGINT AS n_words, round(shared::DOUBLE / united, 6) AS similarity FROM r WHERE k = 1
"""


def op9_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.components(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.resample(docs, table(spark, sf_dir, "labels"))
    return found.select("doc_id", F.col("__weight").alias("log_weight"), F.col("__key").alias("key"), F.col("__kept").alias("kept"))


def queries() -> dict:
    return {
        "op1_lm_scoring": op1_lm_scoring,
        "op2_url_filter": op2_url_filter,
        "op3_chat_format": op3_chat_format,
        "op4_chaining": op4_chaining,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_audio": op6_audio,
        "op7_mixing": op7_mixing,
        "op8_decontaminate": op8_decontaminate,
        "op9_chosen_path": op9_chosen_path,
        "op10_quality": op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": OP2_SQL, "op3_chat_format": OP3_SQL, "op7_mixing": OP7_SQL, "op8_decontaminate": OP8_SQL}
