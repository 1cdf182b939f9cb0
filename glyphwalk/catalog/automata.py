"""Automaton algebra, vocabularies and lifting."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphwalk.catalog._registry import read, registry
from glyphwalk.operators.vocabulary import Vocabulary, lift_edges, tokenizations
from glyphwalk.plans.automaton import Automaton

QUERIES, query = registry()
A = Automaton.of_pattern
STRINGS = "WITH RECURSIVE s(t) AS (SELECT '' UNION ALL SELECT t || c FROM s, (VALUES ('a'), ('b'), ('c')) v(c) WHERE length(t) < {n})"


def _texts(spark, automaton, column="text"):
    return spark.createDataFrame([(t,) for t in automaton.texts()], f"{column} string")


@query(STRINGS.format(n=5) + " SELECT t AS text FROM s WHERE regexp_full_match(t, '(ab|c){1,2}a?')")
def automaton_expand(spark, sf):
    return _texts(spark, A("(ab|c){1,2}a?"))


@query(STRINGS.format(n=7) + " SELECT length(t) AS length, count(*) AS strings FROM s WHERE regexp_full_match(t, '[ab]*') AND NOT contains(t, 'aa') GROUP BY length(t)")
def automaton_cardinality(spark, sf):
    counts = A("[ab]*").difference(A("[ab]*aa[ab]*")).counts(7)
    return spark.createDataFrame(list(enumerate(counts)), "length long, strings long")


@query(" UNION ALL ".join([
    STRINGS.format(n=4) + " SELECT 'intersect' AS op, t AS text FROM s WHERE regexp_full_match(t, '(a|bc)*') AND regexp_full_match(t, '.*c.?')",
    "SELECT 'difference', t FROM s WHERE regexp_full_match(t, '(a|bc)*') AND NOT regexp_full_match(t, '.*c.?')",
    "SELECT 'union', t FROM s WHERE regexp_full_match(t, 'a{1,3}|b')",
    "SELECT 'prefixes', t FROM s WHERE regexp_full_match(t, '(abc|bb)?|a|ab|b')",
    "SELECT 'truncated', t FROM s WHERE length(t) <= 3 AND regexp_full_match(t, '(a|bc)+')",
    "SELECT 'concat', t FROM s WHERE regexp_full_match(t, '[ab]c?b')",
    "SELECT 'repeat', t FROM s WHERE regexp_full_match(t, '(ab?){0,2}')",
    "SELECT 'suffixes', t FROM s WHERE regexp_full_match(t, 'c|bc')",
    "SELECT 'sinks', t FROM s WHERE t IN ('ab', 'c')",
    "SELECT 'relabel', t FROM s WHERE t IN ('bcb', 'b')",
    "SELECT 'complement', t FROM s WHERE NOT regexp_full_match(t, '.*[ac].*')",
]))
def automaton_algebra(spark, sf):
    few, abc = A("[abc]{0,4}"), {97: (98, 99), 98: 98}
    a, b = A("(a|bc)*"), A(".*c.?")
    found = {
        "intersect": a.intersect(b), "difference": a.difference(b), "union": A("a{1,3}").union(A("b")), "prefixes": A("abc|bb").prefixes(), "truncated": A("(a|bc)+").truncated(3),
        "concat": A("[ab]").concat(A("c?b")), "repeat": A("ab?").repeat(0, 2), "suffixes": A("abc|aabc").suffixes_after(A("ab|aa")), "sinks": A("a|ab|c").sinks(),
        "relabel": A("ab|b").relabel(abc), "complement": A(".*[ac].*").complement(),
    }
    return spark.createDataFrame([(op, t) for op, x in found.items() for t in x.intersect(few).texts()], "op string, text string")


@query("SELECT * FROM (VALUES ('abc|d|de|ghij', 8, 4, 4, false), ('a{2,5}', 6, 5, 4, false), ('', 1, 0, 1, false)) v(pattern, states, longest, strings, cyclic)")
def automaton_shape(spark, sf):
    rows = []
    for p in ("abc|d|de|ghij", "a{2,5}", ""):
        a = A(p)
        rows.append((p, len(a.arcs), a.longest(), a.cardinality(), a.is_cyclic))
    return spark.createDataFrame(rows, "pattern string, states int, longest int, strings int, cyclic boolean")


@query(STRINGS.format(n=4) + " SELECT t AS text, round(1.0 / count(*) OVER (), 6)::DOUBLE AS probability FROM s WHERE regexp_full_match(t, 'a(b|c)?|b[abc]{2}|cc')")
def automaton_normalized_weights(spark, sf):
    """Walks by arc weight, and by one share for ending at a final state, draw every string equally often."""
    a = A("a(b|c)?|b[abc]{2}|cc")
    left, edges = a.completions(), a.edges(spark)
    states = spark.createDataFrame(list(enumerate(left)), "state int, strings long")
    finals = a.states(spark).where("is_final").select(F.col("state").alias("final"))
    weighted = edges.join(states.select(F.col("state").alias("src"), F.col("strings").alias("s")), "src").join(states.select(F.col("state").alias("dst"), F.col("strings").alias("d")), "dst")
    spread = weighted.select("src", "dst", F.explode(F.sequence("lo", "hi")).alias("label"), (F.col("d") / F.col("s")).alias("w"))
    here, out = spark.createDataFrame([(0, "", 1.0)], "state int, text string, p double"), None
    for _ in range(a.longest() + 1):
        ended = here.join(finals, F.col("state") == F.col("final")).join(states, "state").select("text", (F.col("p") / F.col("strings")).alias("p"))
        out = ended if out is None else out.unionByName(ended)
        here = here.join(spread, F.col("state") == F.col("src")).select(F.col("dst").alias("state"), F.concat("text", F.expr("char(label)")).alias("text"), (F.col("p") * F.col("w")).alias("p"))
    return out.select("text", F.round("p", 6).alias("probability"))


PIECES = ["a", "b", "c", "d", "e", "g", "i", "l", "n", "r", "s", "t", "w", "o", "u", "re", "ed", "er", "in", "ring", "all", "ea", "ge", "gear", "bo", "lt", "id", "get", "b l", " ", "ue", "blue"]
VOCABULARY = Vocabulary({p: i for i, p in enumerate(PIECES)}, eos=99)
VOCAB = "vocab(token, piece) AS (VALUES " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(PIECES)) + ")"


def _names(spark, sf):
    return read(spark, sf, "part").select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("text")).distinct()


NAMES = "n AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS text FROM part)"
SPLITS = "r(text, rest, tokens) AS (SELECT text, text, '' FROM n UNION ALL SELECT text, substr(rest, length(piece) + 1), tokens || token || ' ' FROM r JOIN vocab ON starts_with(rest, piece))"


@query(f"WITH RECURSIVE {VOCAB}, {NAMES}, {SPLITS} SELECT text, trim(tokens) AS tokens FROM r WHERE rest = ''")
def tokenizations_all(spark, sf):
    found = tokenizations(_names(spark, sf), VOCABULARY.frame(spark))
    return found.select("text", F.array_join(F.col("tokens").cast("array<string>"), " ").alias("tokens"))


@query(f"WITH RECURSIVE {VOCAB}, {NAMES}, {SPLITS} SELECT text, count(*) AS ways FROM r WHERE rest = '' GROUP BY text")
def tokenization_count(spark, sf):
    return tokenizations(_names(spark, sf), VOCABULARY.frame(spark)).groupBy("text").agg(F.count(F.lit(1)).alias("ways"))


@query(f"""WITH RECURSIVE {VOCAB}, {NAMES}, g(text, rest, tokens) AS (SELECT text, text, '' FROM n UNION ALL
  SELECT text, substr(rest, length(piece) + 1), tokens || token || ' ' FROM g JOIN vocab v ON starts_with(rest, piece)
  WHERE NOT EXISTS (SELECT 1 FROM vocab w WHERE length(w.piece) > length(v.piece) AND starts_with(g.rest, w.piece)))
  SELECT text, trim(tokens) AS tokens FROM g WHERE rest = ''""")
def canonical_tokens(spark, sf):
    canonical = F.pandas_udf(lambda s: s.map(lambda t: " ".join(map(str, VOCABULARY.canonical(t) or ()))), "string")
    return _names(spark, sf).select("text", canonical("text").alias("tokens")).where("tokens <> ''")


@query(f"""WITH RECURSIVE {VOCAB}, n AS (SELECT unnest(['blue gear', 'bolt', 'ring', 'gear']) AS text), {SPLITS} SELECT trim(tokens) AS tokens FROM r WHERE rest = ''""")
def token_lift_paths(spark, sf):
    """Arcs of all pieces over the automaton of a pattern, and the token sequences that they accept."""
    a = A("(blue g|g)ear|bolt|ring")
    arcs = F.broadcast(lift_edges(a.edges(spark), VOCABULARY.frame(spark)))
    finals = F.broadcast(spark.createDataFrame([(s,) for s in a.finals], "state int"))
    here, out = spark.createDataFrame([(0, "")], "state int, tokens string"), None
    for _ in range(a.longest()):
        here = here.join(arcs, F.col("state") == F.col("src")).select(F.col("dst").alias("state"), F.ltrim(F.concat("tokens", F.lit(" "), F.col("token").cast("string"))).alias("tokens"))
        ended = here.join(finals, "state", "left_semi").select("tokens")
        out = ended if out is None else out.unionByName(ended)
    return out
