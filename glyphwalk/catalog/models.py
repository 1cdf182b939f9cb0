"""Language models learned from ``documents`` and what is asked of them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glyphwalk.catalog._registry import read, registry
from glyphwalk.operators.language_model import EOS, LanguageModel
from glyphwalk.operators.vocabulary import characters_of

QUERIES, query = registry()

#: Counts and shares of characters after characters (-1: start; 1114112: end of a text).
CHARS = """cnt AS (SELECT c, t, count(*) AS n FROM (
    SELECT unnest(list_prepend(-1, u)) AS c, unnest(list_append(u, 1114112)) AS t FROM (
      SELECT CASE WHEN text = '' THEN []::INT[] ELSE list_transform(string_split(text, ''), lambda x: unicode(x)) END AS u FROM documents WHERE text IS NOT NULL)) GROUP BY c, t),
  lm AS (SELECT c, t, n, n::DOUBLE / sum(n) OVER (PARTITION BY c) AS p, row_number() OVER (PARTITION BY c ORDER BY n DESC, t) AS rank FROM cnt)"""


def char_model(spark, sf):
    return LanguageModel.of_characters(read(spark, sf, "documents").select("text"), eos=EOS)


def flat(model):
    return model.rows.select(F.element_at("context", 1).alias("c"), F.col("token").alias("t"), F.round("p", 6).alias("p"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {CHARS} SELECT c, t, round(p, 6) AS p, rank FROM lm")
def char_bigram_lm(spark, sf):
    return flat(char_model(spark, sf))


@query(f"WITH {CHARS} SELECT c, t, round(p / sum(p) OVER (PARTITION BY c), 6) AS p, rank FROM lm WHERE rank <= 3")
def lm_topk_next(spark, sf):
    return flat(char_model(spark, sf).top_k(3))


@query(f"""WITH {CHARS}, w AS (SELECT c, t, pow(p, 1 / 0.7) AS w FROM lm)
  SELECT c, t, round(w / sum(w) OVER (PARTITION BY c), 6) AS p, row_number() OVER (PARTITION BY c ORDER BY w DESC, t) AS rank FROM w""")
def lm_temperature(spark, sf):
    return flat(char_model(spark, sf).temper(0.7))


@query(f"""WITH {CHARS}, b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY c ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / sum(n) OVER (PARTITION BY c) AS before FROM lm)
  SELECT c, count(*) AS tokens FROM b WHERE before < 0.9 - 1e-9 GROUP BY c""")
def lm_topp(spark, sf):
    kept = char_model(spark, sf).top_p(0.9 - 1e-9).rows
    return kept.groupBy(F.element_at("context", 1).alias("c")).agg(F.count(F.lit(1)).alias("tokens"))


@query(f"WITH {CHARS} SELECT c, rank, round(p, 6) AS p FROM lm WHERE t = unicode('e')")
def lm_token_rank(spark, sf):
    return flat(char_model(spark, sf)).where(F.col("t") == ord("e")).select("c", "rank", "p")


@query(f"""WITH {CHARS}, u AS (SELECT sum(n) AS n, t FROM cnt GROUP BY t), g AS (SELECT c, u.t, u.n FROM (SELECT DISTINCT c FROM cnt), u)
  SELECT g.c, g.t, round(0.9 * coalesce(lm.p, 0) + 0.1 * g.n::DOUBLE / (SELECT sum(n) FROM cnt), 6) AS p FROM g LEFT JOIN lm USING (c, t)""")
def lm_interpolated(spark, sf):
    model = LanguageModel.of_characters(read(spark, sf, "documents").select("text"), eos=EOS, mix=0.9)
    return flat(model).select("c", "t", "p")


WORDS = r"(SELECT list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL)"


def _words(spark, sf):
    return read(spark, sf, "documents").where("text is not null").select(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "").alias("w"))


#: Asked words are broadcast up to this number; beyond, all pairs are counted.
ASKED = 200_000


def word_pairs(spark, sf, asked=None):
    """(w1, w2, n), or only those of the words ``asked`` (w1). Pairs are counted as one string each: that is the smaller key."""
    pairs = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.struct(a.alias("w1"), b.alias("w2")))
    spread = _words(spark, sf).where(F.size("w") > 1).select(F.inline(pairs))
    if asked is not None and asked.count() <= ASKED:
        spread = spread.join(F.broadcast(asked), "w1", "left_semi")
    counted = spread.groupBy(F.concat_ws(" ", "w1", "w2").alias("pair")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.substring_index("pair", " ", 1).alias("w1"), F.substring_index("pair", " ", -1).alias("w2"), "n")


PAIRS = f"(SELECT w1, w2, count(*) AS n FROM (SELECT unnest(w[:-2]) AS w1, unnest(w[2:]) AS w2 FROM {WORDS} WHERE len(w) > 1) GROUP BY w1, w2)"


@query(f"SELECT w1, w2, n, round(n / sum(n) OVER (PARTITION BY w1), 6) AS p FROM {PAIRS}")
def word_bigram_lm(spark, sf):
    return word_pairs(spark, sf).withColumn("p", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("w1")), 6))


@query(f"""SELECT w1, w2, w3, n FROM (SELECT w1, w2, w3, n, row_number() OVER (PARTITION BY w1, w2 ORDER BY n DESC, w3) AS k FROM (
  SELECT w1, w2, w3, count(*) AS n FROM (SELECT unnest(w[:-3]) AS w1, unnest(w[2:-2]) AS w2, unnest(w[3:]) AS w3 FROM {WORDS} WHERE len(w) > 2) GROUP BY ALL)) WHERE k = 1""")
def word_trigram_best(spark, sf):
    at = F.sequence(F.lit(1), F.size("w") - 2)
    triples = F.transform(at, lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i), F.get("w", i + 1)))  # one string: the smaller key
    counted = _words(spark, sf).where(F.size("w") > 2).select(F.explode(triples).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    # Rows, not states of an aggregate, are sent: those are larger, and few meet before.
    dealt = counted.repartition(F.substring_index("t", " ", 2))
    rows = dealt.select(F.substring_index("t", " ", 2).alias("pair"), F.substring_index("t", " ", -1).alias("w3"), "n")
    best = rows.groupBy("pair").agg(F.min(F.struct((-F.col("n")).alias("m"), "w3")).alias("b"))
    return best.select(F.substring_index("pair", " ", 1).alias("w1"), F.substring_index("pair", " ", -1).alias("w2"), "b.w3", (-F.col("b.m")).alias("n"))


def _items(spark, sf):
    return read(spark, sf, "benchmark").where("text is not null").select("item_id", F.transform(characters_of(F.col("text")), lambda c: F.ascii(c)).alias("tokens"))


ITEMS = """i AS (SELECT item_id, unnest(list_prepend(-1, u[:-2])) AS c, unnest(u) AS t, unnest(range(0, len(u))) AS pos FROM (
    SELECT item_id, list_transform(string_split(text, ''), lambda x: unicode(x)) AS u FROM benchmark WHERE text <> ''))"""


@query(f"""WITH {CHARS}, {ITEMS} SELECT item_id, count(*) AS n_tokens, round(sum(ln(p)), 3) AS log_p, round(exp(-sum(ln(p)) / count(*)), 4) AS perplexity
  FROM i LEFT JOIN lm USING (c, t) GROUP BY item_id HAVING count(p) = count(*)""")
def sequence_perplexity(spark, sf):
    found = char_model(spark, sf).sequence_scores(_items(spark, sf), "item_id").where("log_p is not null")
    return found.select("item_id", "n_tokens", F.round("log_p", 3).alias("log_p"), F.round("perplexity", 4).alias("perplexity"))


@query(f"WITH {CHARS}, {ITEMS} SELECT item_id, bool_and(pos < 5 OR coalesce(rank <= 25, false)) AS possible FROM i LEFT JOIN lm USING (c, t) GROUP BY item_id")
def can_generate_sequence(spark, sf):
    return char_model(spark, sf).can_generate(_items(spark, sf), 25, "item_id", prefix_len=5)


@query(f"""WITH {CHARS}, {ITEMS} SELECT item_id, round(sum(ln(p)) FILTER (pos < 20), 4) AS joint, round(sum(ln(p)) FILTER (pos >= 10 AND pos < 20), 4) AS conditional,
  round(-sum(ln(p)) FILTER (pos >= 10 AND pos < 20) / ln(10), 4) AS log10_expected_samples FROM i JOIN lm USING (c, t) GROUP BY item_id""")
def conditional_suffix_prob(spark, sf):
    scored = char_model(spark, sf).token_scores(_items(spark, sf), "item_id").where("p is not null")
    joint, suffix = F.sum(F.when(F.col("pos") < 20, F.ln("p"))), F.sum(F.when((F.col("pos") >= 10) & (F.col("pos") < 20), F.ln("p")))
    return scored.groupBy("item_id").agg(
        F.round(joint, 4).alias("joint"), F.round(suffix, 4).alias("conditional"), F.round(-suffix / F.ln(F.lit(10.0)), 4).alias("log10_expected_samples")
    )


@query(f"""WITH b AS (SELECT w1, w2, row_number() OVER (PARTITION BY w1 ORDER BY n DESC, w2) AS k FROM {PAIRS}),
  c AS (SELECT role, w[-2] AS w1, w[-1] AS y FROM (SELECT role, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w <> '') AS w FROM conversations) WHERE len(w) > 1)
  SELECT role, round(avg((y = coalesce(w2, ''))::INT), 6) AS accuracy, count(*) AS n FROM c LEFT JOIN (SELECT * FROM b WHERE k = 1) USING (w1) GROUP BY role""")
def last_word_accuracy(spark, sf):
    turns = read(spark, sf, "conversations").select("role", F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "").alias("w")).where(F.size("w") > 1)
    asked = turns.select("role", F.element_at("w", -2).alias("w1"), F.element_at("w", -1).alias("y")).groupBy("role", "w1", "y").agg(F.count(F.lit(1)).alias("m"))
    best = word_pairs(spark, sf, asked.select("w1").distinct()).groupBy("w1").agg(F.min(F.struct((-F.col("n")).alias("m"), "w2")).alias("b")).select("w1", F.col("b.w2").alias("guess"))
    right = F.when(F.col("y") == F.coalesce("guess", F.lit("")), F.col("m")).otherwise(0)
    found = asked.join(best, "w1", "left").groupBy("role").agg((F.sum(right) / F.sum("m")).alias("accuracy"), F.sum("m").alias("n"))
    return found.select("role", F.round("accuracy", 6).alias("accuracy"), "n")


@query()
def model_samples(spark, sf):
    """Ancestral samples from the character model, deterministic by seed."""
    found = char_model(spark, sf).settled().sample(spark, 50, 12, seed=5)
    return found.select("walker", F.size("tokens").alias("n_tokens"))


@query(f"""WITH {CHARS}, i AS (SELECT p_name, unnest(list_prepend(-1, u[:-2])) AS c, unnest(u) AS t FROM (
    SELECT p_name, list_transform(string_split(p_name, ''), lambda x: unicode(x)) AS u FROM (SELECT DISTINCT p_name FROM part)))
  SELECT p_name AS text, bool_and(coalesce(rank <= 30, false)) AS possible FROM i LEFT JOIN lm USING (c, t) GROUP BY p_name""")
def can_generate_string(spark, sf):
    names = read(spark, sf, "part").select(F.col("p_name").alias("text")).distinct()
    encodings = names.select("text", F.transform(characters_of(F.col("text")), lambda c: F.ascii(c)).alias("tokens"))
    return char_model(spark, sf).encodable(names, encodings, 30).select("text", F.col("tokens").isNotNull().alias("possible"))


@query(f"WITH {CHARS} SELECT t AS token, round(1 / p, 4) AS perplexity FROM lm WHERE c = unicode('t')")
def next_perplexities(spark, sf):
    context = spark.createDataFrame([([ord("t")],)], "context array<int>")
    return char_model(spark, sf).next_perplexities(context).select("token", F.round("perplexity", 4).alias("perplexity"))
