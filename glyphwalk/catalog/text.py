"""Scans, matches and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphwalk.catalog._registry import read, registry
from glyphwalk.operators import analytics as an
from glyphwalk.plans.automaton import Automaton
from glyphwalk.plans.edits import Edits

QUERIES, query = registry()
RUDE = "(stupid|idiot|trash|pathetic|worthless|loser|moron|scum|clown|disgusting)"


@query(r"SELECT doc_id, lang, n_chars FROM documents WHERE regexp_matches(text, '(ing|tion) (the|la|der|el) [a-z]+')")
def regex_scan_documents(spark, sf):
    docs = read(spark, sf, "documents")
    return docs.where(an.contains(F.col("text"), "(ing|tion) (the|la|der|el) [a-z]+")).select("doc_id", "lang", "n_chars")


def words(spark, sf):
    docs = read(spark, sf, "documents")
    return docs.select("doc_id", F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("word")).where("word <> ''")


WORDS = r"(SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM documents)"


@query(rf"SELECT word, count(*) AS n FROM {WORDS} WHERE word <> '' AND regexp_full_match(word, '[a-z]{{2,}}(ing|ed|ly)') GROUP BY word")
def regex_full_match_words(spark, sf):
    return words(spark, sf).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(an.matches(F.col("word"), "[a-z]{2,}(ing|ed|ly)"))


@query(rf"SELECT word, count(*) AS n FROM {WORDS} WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 100")
def top_words(spark, sf):
    return an.most_common(words(spark, sf), "word", 100)


URL = r"^(https?)://([^/]+)/([a-z]+)/([0-9]+)"


@query(rf"""SELECT page_id, regexp_extract(url, '{URL}', 1) AS scheme, regexp_extract(url, '{URL}', 2) AS host,
  regexp_extract(url, '{URL}', 3) AS lang, TRY_CAST(regexp_extract(url, '{URL}', 4) AS BIGINT) AS number FROM pages""")
def regex_extract_fields(spark, sf):
    part = lambda i: F.regexp_extract("url", URL, i)
    return read(spark, sf, "pages").select("page_id", part(1).alias("scheme"), part(2).alias("host"), part(3).alias("lang"), part(4).try_cast("long").alias("number"))


@query(r"SELECT page_id, coalesce(regexp_full_match(url, 'https?://([a-zA-Z0-9_-]+\.)+[a-z]{2,}(/[a-zA-Z0-9_/-]*)?'), false) AS valid FROM pages")
def url_shape_valid(spark, sf):
    shape = an.matches(F.col("url"), r"https?://([[:alnum:]_-]+\.)+[a-z]{2,}(/[[:alnum:]_/-]*)?")
    return read(spark, sf, "pages").select("page_id", F.coalesce(shape, F.lit(False)).alias("valid"))


@query(r"SELECT page_id, replace(split_part(url || chr(10) || 'rest', chr(10), 1) || '', '<|endoftext|>', '') AS url FROM pages WHERE url IS NOT NULL")
def clean_urls(spark, sf):
    noisy = read(spark, sf, "pages").where("url is not null").withColumn("url", F.concat("url", F.lit("<|endoftext|>\nrest")))
    return noisy.select("page_id", an.clean_url(F.col("url")).alias("url"))


@query(r"""SELECT sentence, min(doc_id) AS doc_id, length(sentence) AS length FROM (
  SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])[ \n]+', '\1' || chr(1), 'g'), chr(1))) AS sentence FROM documents)
  WHERE sentence <> '' GROUP BY sentence""")
def distinct_sentences(spark, sf):
    spread = read(spark, sf, "documents").select("doc_id", F.explode(an.sentences(F.col("text"))).alias("sentence"))
    return an.ordered_distinct(spread, "sentence", "doc_id").select("sentence", "doc_id", F.col("length").cast("long").alias("length"))


@query(rf"""SELECT doc_id, strpos(text, w) AS start, w AS word, md5(rtrim(substr(text, 1, strpos(text, w) - 1), ' ')) AS prompt FROM (
  SELECT doc_id, text, regexp_extract(text, '{RUDE}') AS w FROM documents WHERE regexp_matches(text, '{RUDE}'))""")
def toxicity_prompt_extract(spark, sf):
    docs = read(spark, sf, "documents").where(an.contains(F.col("text"), RUDE))
    text = F.col("text")
    return docs.select("doc_id", an.match_start(text, RUDE).cast("long").alias("start"), F.regexp_extract("text", RUDE, 0).alias("word"), F.md5(an.prompt_before(text, RUDE)).alias("prompt"))


@query(rf"""SELECT lang, count(*) AS n, round(avg(toxic), 6) AS labelled, round(avg(hit::INT), 6) AS matched, round(avg((hit::INT = toxic)::INT), 6) AS accuracy
  FROM (SELECT d.lang, l.toxic, regexp_matches(coalesce(d.text, ''), '{RUDE}') AS hit FROM documents d JOIN labels l USING (doc_id)) GROUP BY lang""")
def toxicity_rate(spark, sf):
    hit = an.contains(F.coalesce("text", F.lit("")), RUDE).cast("int").alias("hit")
    rows = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id").select("lang", "toxic", hit)
    return rows.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("toxic"), 6).alias("labelled"), F.round(F.avg("hit"), 6).alias("matched"),
        F.round(F.avg((F.col("hit") == F.col("toxic")).cast("int")), 6).alias("accuracy"),
    )


SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _sql_normalized(column: str) -> str:
    out = column
    for old, new in an.REPLACEMENTS:
        out = f"replace({out}, '{old.replace(chr(39), chr(39) * 2)}', '{new.replace(chr(39), chr(39) * 2)}')"
    return f"chr(10) || trim({out}, {SPACES})"


@query(f"SELECT doc_id, md5({_sql_normalized('text')}) AS digest FROM documents WHERE text IS NOT NULL")
def text_normalize(spark, sf):
    return read(spark, sf, "documents").where("text is not null").select("doc_id", F.md5(an.normalized(F.col("text"))).alias("digest"))


@query(rf"""SELECT conv_id, turn, regexp_replace(l[-1], '[!-/:-@\[-`{{-~]', '', 'g') AS last, md5(array_to_string(l[:-2], ' ')) AS context
  FROM (SELECT conv_id, turn, string_split(trim(text, {SPACES}), ' ') AS l FROM conversations WHERE text IS NOT NULL)""")
def last_word_split(spark, sf):
    text = F.col("text")
    return read(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", an.bare(an.last_word(text)).alias("last"), F.md5(an.without_last_word(text)).alias("context"))


@query("""SELECT p_name, array_to_string(list_sort(list_filter(list_distinct(string_split(p_name, '')), lambda c: NOT contains('small ring', c))), '') AS extra
  FROM (SELECT DISTINCT p_name FROM part)""")
def charset_diff(spark, sf):
    return read(spark, sf, "part").select("p_name").distinct().select("p_name", F.array_join(an.only_in(F.col("p_name"), F.lit("small ring")), "").alias("extra"))


TEMPLATES = ["small ring", "blue bolt", "red widget", "large gear"]
_VALUES = ", ".join(f"({i}, '{t}')" for i, t in enumerate(TEMPLATES))


def _templates(spark):
    return spark.createDataFrame(list(enumerate(TEMPLATES)), "template_id int, template string")


@query(f"""SELECT p_name, template_id, template, d AS distance FROM (SELECT p_name, template_id, template, levenshtein(p_name, template) AS d,
  row_number() OVER (PARTITION BY p_name ORDER BY levenshtein(p_name, template), template_id) AS k
  FROM (SELECT DISTINCT p_name FROM part), (VALUES {_VALUES}) t(template_id, template)) WHERE k = 1""")
def best_template_match(spark, sf):
    return an.best_match(read(spark, sf, "part").select("p_name").distinct(), _templates(spark), "p_name").withColumn("distance", F.col("distance").cast("long"))


@query(f"SELECT p_name, template, levenshtein(p_name, template) AS distance FROM (SELECT DISTINCT p_name FROM part), (VALUES {_VALUES}) t(i, template) WHERE levenshtein(p_name, template) <= 4")
def edit_within_k_join(spark, sf):
    names = read(spark, sf, "part").select("p_name").distinct()
    near = F.when(F.abs(F.length("p_name") - F.length("template")) <= 4, F.levenshtein("p_name", "template", 4))
    return names.join(F.broadcast(_templates(spark)), near >= 0).select("p_name", "template", near.cast("long").alias("distance"))


@query("""WITH RECURSIVE s(t) AS (SELECT '' UNION ALL SELECT t || c FROM s, (VALUES ('a'), ('b'), ('c')) v(c) WHERE length(t) < 4)
  SELECT t AS text, levenshtein(t, 'abc') AS distance FROM s WHERE levenshtein(t, 'abc') <= 1""")
def edit1_language(spark, sf):
    found = Edits(1, frozenset("abc")).apply(Automaton.of_pattern("abc")).texts()
    return spark.createDataFrame([(t,) for t in found], "text string").withColumn("distance", F.levenshtein("text", F.lit("abc")).cast("long"))


@query(r"""WITH b AS (SELECT item_id, unnest(list_distinct(list_transform(range(0, greatest(len(w) - 7, 0)), lambda i: array_to_string(w[i + 1:i + 8], ' ')))) AS g
    FROM (SELECT item_id, regexp_split_to_array(trim(text), '\s+') AS w FROM benchmark)),
  d AS (SELECT doc_id, unnest(list_distinct(list_transform(range(0, greatest(len(w) - 7, 0)), lambda i: array_to_string(w[i + 1:i + 8], ' ')))) AS g
    FROM (SELECT doc_id, regexp_split_to_array(trim(text), '\s+') AS w FROM documents))
  SELECT item_id, count(DISTINCT doc_id) AS docs, count(DISTINCT g) AS grams FROM b JOIN d USING (g) GROUP BY item_id""")
def memorization_overlap(spark, sf):
    def grams(df, key):
        words_ = F.split(F.trim("text"), r"[ \t\n\f\r]+")
        runs = F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda i: F.array_join(F.slice("w", i, 8), " "))
        return df.select(key, words_.alias("w")).where(F.size("w") >= 8).select(key, F.explode(F.array_distinct(runs)).alias("g"))

    items = grams(read(spark, sf, "benchmark"), "item_id")
    shared = grams(read(spark, sf, "documents"), "doc_id").join(items, "g")
    return shared.groupBy("item_id").agg(F.countDistinct("doc_id").alias("docs"), F.countDistinct("g").alias("grams"))


@query(r"""SELECT conv_id, turn, len(list_distinct(regexp_extract_all(text, '[\p{L}\p{M}\p{Nd}\p{Pc}]+')))::INT AS words FROM conversations WHERE text IS NOT NULL""")
def words_in_context(spark, sf):
    turns = read(spark, sf, "conversations").where("text is not null")
    return turns.select("conv_id", "turn", F.size(an.words_in(F.col("text"))).alias("words"))
