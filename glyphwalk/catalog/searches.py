"""Pattern searches over a character model of ``documents``; oracles spell out the candidate strings."""

from __future__ import annotations

import os
from contextvars import ContextVar
from dataclasses import replace
from functools import lru_cache

from pyspark.sql import functions as F

from glyphwalk.catalog._registry import read, registry
from glyphwalk.catalog.models import CHARS, char_model
from glyphwalk.engine import Engine, prepare
from glyphwalk.operators.language_model import LanguageModel, _ranked
from glyphwalk.operators.vocabulary import Vocabulary
from glyphwalk.plans.query import Order, PatternQuery, Preprocessing, SearchOptions, Text, Tokens

QUERIES, query = registry()
ASCII = Vocabulary.characters("".join(map(chr, range(1, 128))))


#: Whether searches may run in the driver's process; the rows named ..._tables say no.
_IN_PROCESS: ContextVar[bool] = ContextVar("in_process", default=True)


def char_engine(spark, sf) -> Engine:
    return replace(prepare(char_model(spark, sf), ASCII), in_process=_IN_PROCESS.get())


def answers(found, places: int = 5):
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "text", F.round("cost", places).alias("cost"))


def scored(candidates: str, cost: str = "-ln(p)", keep: str = "true", end: bool = False, limit: int = 10, extra: str = "", size: str = "len(u)") -> str:
    """SQL: candidates (query_id, text, prefix) ranked by the sum of ``cost`` over their characters."""
    tail = "list_append(u, 1114112)" if end else "u"
    lead = "list_prepend(-1, u)" if end else "list_prepend(-1, u[:-2])"
    return f"""WITH RECURSIVE {CHARS}, zk AS (SELECT c, sum(p) FILTER (rank <= 5) AS z5, sum(p) AS z FROM lm GROUP BY c){extra},
  k AS ({candidates}),
  x AS (SELECT query_id, text, prefix, unnest({lead}) AS c, unnest({tail}) AS t, unnest(range(0, len({tail}))) AS pos FROM (
    SELECT *, list_transform(string_split(text, ''), lambda q: unicode(q)) AS u FROM k)),
  y AS (SELECT x.query_id, x.text, round(sum({cost}), 8) AS cost FROM x JOIN lm USING (c, t) JOIN zk USING (c) WHERE {keep}
    GROUP BY x.query_id, x.text HAVING count(*) = max(length(x.text)) + {int(end)})
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY cost, text) AS rank, text, round(cost, 5) AS cost FROM y
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cost, text) <= {limit}"""


PHRASES = """SELECT '0' AS query_id, a || b || c AS text, '' AS prefix FROM (VALUES ('E'), ('L'), ('D'), ('A'), ('Th')) l(a), (VALUES ('n'), ('a'), ('e'), ('r'), ('s'), ('t')) m(b), (VALUES ('e'), ('t'), ('s'), ('n'), (' ')) n(c)"""
PATTERN = "(E|L|D|A|Th)[naerst](e|t|s|n| )"


@query(scored(PHRASES))
def search_shortest_path(spark, sf):
    return answers(char_engine(spark, sf).search(PatternQuery(Text(PATTERN), limit=10)))


@query(scored(PHRASES, cost="-ln(p / z5)", keep="rank <= 5"))
def search_topk(spark, sf):
    return answers(char_engine(spark, sf).search(PatternQuery(Text(PATTERN), limit=10, top_k=5)))


AFTER_THE = "SELECT '0' AS query_id, 'the ' || b AS text, 'the ' AS prefix FROM (VALUES ('in'), ('to'), ('on'), ('ea'), ('th'), ('re'), ('es')) m(b)"


@query(scored(AFTER_THE, cost="CASE WHEN pos < 4 THEN CASE WHEN rank <= 5 THEN -ln(p / z5) ELSE -ln(p / (z5 + p)) END ELSE -ln(p / z5) END", keep="(pos < 4 OR rank <= 5)"))
def search_prefix_penalized(spark, sf):
    """The prefix is let in whatever its rank, and costs what the model says."""
    return answers(char_engine(spark, sf).search(PatternQuery(Text("the (in|to|on|ea|th|re|es)", prefix="the "), limit=10, top_k=5)))


@query(scored(AFTER_THE, cost="CASE WHEN pos < 4 THEN 0 ELSE -ln(p / z5) END", keep="(pos < 4 OR rank <= 5)"))
def search_prefix(spark, sf):
    """The prefix is free."""
    options = SearchOptions(pattern="the (in|to|on|ea|th|re|es)", prefix="the ", order=Order.LIKELIEST, limit=10, top_k=5)
    return answers(char_engine(spark, sf).search(options))


@query(scored(PHRASES + " WHERE NOT regexp_full_match(a || b || c, '.*(en|Th..)')"))
def search_filtered(spark, sf):
    return answers(char_engine(spark, sf).search(PatternQuery(Text(PATTERN), limit=10, preprocessing=Preprocessing(exclude=".*(en|Th..)"))))


@query(scored(PHRASES, end=True))
def search_eos(spark, sf):
    return answers(char_engine(spark, sf).search(PatternQuery(Text(PATTERN, end=True), limit=10)))


GROWN = "SELECT '0' AS query_id, t AS text, '' AS prefix FROM v"
GROW = ", v(t) AS (SELECT unnest(['E', 'A', 'L']) UNION ALL SELECT t || ch FROM v, (VALUES ('a'), ('e'), ('n'), ('o'), ('r'), (' ')) w(ch) WHERE length(t) < 4)"


@query(scored(GROWN, extra=GROW, limit=20))
def search_max_len(spark, sf):
    """An infinite language, cut by length and pruned by cost."""
    return answers(char_engine(spark, sf).search(PatternQuery(Text("[EAL][aenor ]*"), limit=20, max_len=4)))


@query(scored(GROWN, extra=GROW, limit=5, cost="-ln(pow(p, 2.0) / z2)").replace("sum(p) AS z FROM", "sum(p) AS z, sum(pow(p, 2.0)) AS z2 FROM"))
def search_temperature(spark, sf):
    return answers(char_engine(spark, sf).search(PatternQuery(Text("[EAL][aenor ]*"), limit=5, max_len=4, temperature=0.5)))


@query(scored("SELECT 'ends' AS query_id, w || e AS text, '' AS prefix FROM (VALUES ('the'), ('ring'), ('ea')) a(w), (VALUES ('s'), ('.'), (' ')) b(e) UNION ALL SELECT 'plain', w, '' FROM (VALUES ('the'), ('thing'), ('tion')) a(w)", limit=4))
def search_many_queries(spark, sf):
    """Two queries in one frontier."""
    return answers(char_engine(spark, sf).search({"ends": PatternQuery(Text(r"(the|ring|ea)[s. ]"), limit=4), "plain": PatternQuery(Text("the|thing|tion"), limit=4)}))


@query(scored(GROWN, extra=GROW, limit=5, cost="-ln(p)").replace("round(sum(-ln(p)), 8)", "round(max(-ln(p)), 8)"))
def search_max_cost(spark, sf):
    """The dearest step counts."""
    return answers(char_engine(spark, sf).search(SearchOptions(pattern="[EAL][aenor ]*", order=Order.LIKELIEST, limit=5, max_len=4, aggregation="max")))


@query("""SELECT t AS text FROM (WITH RECURSIVE v(t) AS (SELECT '' UNION ALL SELECT t || ch FROM v, (VALUES ('a'), ('b')) w(ch) WHERE length(t) < 3) SELECT t FROM v WHERE regexp_full_match(t, '(a|b)a?b?') )""")
def search_enumerate_bfs(spark, sf):
    return char_engine(spark, sf).search(SearchOptions(pattern="(a|b)a?b?", limit=None)).select("text")


@query(f"""WITH {CHARS} SELECT chr(t) AS text FROM lm WHERE c = -1 AND rank <= 12 AND regexp_full_match(chr(t), '[A-Z]')""")
def search_enumerate_topk(spark, sf):
    return char_engine(spark, sf).search(SearchOptions(pattern="[A-Z]", limit=None, top_k=12)).select("text")


@query(f"""WITH RECURSIVE {CHARS}, b(depth, c, text, cost) AS (SELECT 0, -1, '', 0.0::DOUBLE UNION ALL
  SELECT depth, c, text, cost FROM (SELECT b.depth + 1 AS depth, lm.t AS c, b.text || chr(lm.t) AS text, round(b.cost - ln(lm.p), 9) AS cost,
    row_number() OVER (ORDER BY round(b.cost - ln(lm.p), 9), b.text || chr(lm.t)) AS k FROM b JOIN lm ON lm.c = b.c
    WHERE b.depth < 6 AND (lm.t BETWEEN 97 AND 122 OR lm.t = 32)) WHERE k <= 8)
  SELECT '0' AS query_id, row_number() OVER (ORDER BY cost, text) AS rank, text, round(cost, 5) AS cost FROM b WHERE depth = 6""")
def search_beam(spark, sf):
    return answers(char_engine(spark, sf).search(SearchOptions(pattern="[a-z ]{6}", order=Order.BEAM, beam=8, limit=8)))


@query(f"""WITH RECURSIVE {CHARS}, b(depth, c, text, cost) AS (SELECT 0, -1, '', 0.0::DOUBLE UNION ALL
  SELECT depth, c, text, cost FROM (SELECT b.depth + 1 AS depth, lm.t AS c, b.text || chr(lm.t) AS text, round(-ln(lm.p), 9) AS cost,
    row_number() OVER (ORDER BY round(-ln(lm.p), 9), b.text || chr(lm.t)) AS k FROM b JOIN lm ON lm.c = b.c WHERE b.depth < 8 AND lm.t BETWEEN 97 AND 122) WHERE k <= 1)
  SELECT '0' AS query_id, 1::BIGINT AS rank, text, round(cost, 5) AS cost FROM b WHERE depth = 8""")
def search_greedy(spark, sf):
    return answers(char_engine(spark, sf).search(SearchOptions(pattern="[a-z]{8}", order=Order.GREEDY, limit=1)))


@query(f"""WITH RECURSIVE {CHARS}, w(walker, depth, c, text) AS (SELECT range, 0, -1, '' FROM range(200) UNION ALL
  SELECT walker, depth + 1, t, text || chr(t) FROM (
    SELECT *, row_number() OVER (PARTITION BY walker ORDER BY t) AS k FROM (
      SELECT w.walker, w.depth, w.text, lm.t, sum(lm.p) OVER (PARTITION BY w.walker ORDER BY lm.t ROWS UNBOUNDED PRECEDING) AS run, sum(lm.p) OVER (PARTITION BY w.walker) AS total,
        ('0x' || substr(md5('11:' || w.walker || ':' || w.depth), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
      FROM w JOIN lm ON lm.c = w.c WHERE w.depth < 3 AND lm.t BETWEEN 97 AND 122) WHERE run > u * total) WHERE k = 1)
  SELECT walker, text FROM w WHERE depth = 3""")
def search_random_walk(spark, sf):
    options = SearchOptions(pattern="[a-z]{3}", order=Order.RANDOM, limit=200, seed=11)
    found = char_engine(spark, sf).search(options)
    return found.select((F.col("rank") - 1).cast("long").alias("walker"), "text")


@query("SELECT text, true AS likely FROM (VALUES ('to'), ('tea'), ('ten'), ('a')) v(text)")
def search_random_prefix(spark, sf):
    """A prefix that is the whole pattern is drawn without bias: each of four strings about 250 times in 1,000."""
    found = char_engine(spark, sf).search(SearchOptions(pattern="to|te(a|n)|a", prefix="to|te(a|n)|a", order=Order.RANDOM, limit=1000, seed=2))
    return found.groupBy("text").agg(F.count(F.lit(1)).alias("n")).select("text", F.col("n").between(180, 320).alias("likely"))


def piece_model(spark, sf) -> LanguageModel:
    """Pieces of one to three letters by how often they stand in words, whatever came before."""
    words = read(spark, sf, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where("w <> ''").groupBy("w").agg(F.count(F.lit(1)).alias("m"))
    sizes = F.filter(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: n), lambda n: n <= F.length("w"))
    spread = words.select("w", "m", F.explode(sizes).alias("n")).select("w", "m", "n", F.explode(F.expr("sequence(1, length(w) - n + 1)")).alias("i"))
    counted = spread.select(F.expr("substring(w, i, n)").alias("piece"), "m").groupBy("piece").agg(F.sum("m").alias("n"))
    known = {p: i for i, p in enumerate(PIECES)}
    kept = counted.where(F.col("piece").isin(PIECES))
    ids = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    share = kept.withColumn("all", F.lit(kept.agg(F.sum("n")).first()[0] or 1))
    rows = share.select(F.array().cast("array<int>").alias("context"), ids[F.col("piece")].alias("token"), (F.col("n") / F.col("all")).alias("p"))
    return LanguageModel(_ranked(rows), 0, eos=99, vocabulary=Vocabulary(known, eos=99))


PIECES = ["a", "e", "h", "i", "n", "o", "r", "s", "t", "th", "he", "the", "in", "ing", "on", "an", "re", "er", "es", "tio", "ion"]
PIECE_SQL = f"""l AS (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM documents), f AS (SELECT w, count(*) AS m FROM l WHERE w <> '' GROUP BY w),
  c AS (SELECT substr(w, i, n) AS piece, sum(m) AS n FROM (SELECT w, m, n, unnest(range(1, length(w) - n + 2)) AS i FROM f, (VALUES (1), (2), (3)) v(n)) GROUP BY 1),
  vocab AS (SELECT piece, n::DOUBLE / sum(n) OVER () AS p FROM c WHERE piece IN ({', '.join(repr(p) for p in PIECES)}))"""
CANDIDATES = "(VALUES ('the'), ('then'), ('thing'), ('nation'), ('a'))"


@query(f"""WITH RECURSIVE {PIECE_SQL}, r(text, rest, cost, pieces) AS (SELECT t, t, 0.0::DOUBLE, '' FROM {CANDIDATES} v(t) UNION ALL
  SELECT text, substr(rest, length(piece) + 1), round(cost - ln(p), 9), pieces || '|' || piece FROM r JOIN vocab ON starts_with(rest, piece))
  SELECT text, round(cost, 5) AS cost, count(*) AS ways FROM (SELECT text, cost FROM r WHERE rest = '') GROUP BY text, round(cost, 5)""")
def search_all_tokens(spark, sf):
    """Every way to write every string, with its cost."""
    found = prepare(piece_model(spark, sf)).search(PatternQuery(Text("the|then|thing|nation|a")))
    return found.groupBy("text", F.round("cost", 5).alias("cost")).agg(F.count(F.lit(1)).alias("ways"))


@query(f"""WITH RECURSIVE {PIECE_SQL}, r(text, rest, cost) AS (SELECT t, t, 0.0::DOUBLE FROM {CANDIDATES} v(t) UNION ALL
  SELECT text, substr(rest, length(piece) + 1), round(cost - ln(p), 9) FROM r JOIN vocab v ON starts_with(rest, piece)
  WHERE NOT EXISTS (SELECT 1 FROM vocab w WHERE length(w.piece) > length(v.piece) AND starts_with(r.rest, w.piece)))
  SELECT text, round(cost, 5) AS cost FROM r WHERE rest = ''""")
def search_canonical(spark, sf):
    """Only the encoding that the tokenizer gives."""
    found = prepare(piece_model(spark, sf)).search(PatternQuery(Text("the|then|thing|nation|a"), tokens=Tokens.CANONICAL))
    return found.select("text", F.round("cost", 5).alias("cost"))


@query(f"""WITH RECURSIVE {PIECE_SQL}, r(text, rest, cost) AS (SELECT 'the' || t, t, 0.0::DOUBLE FROM (VALUES ('re'), ('n'), ('se'), ('in')) v(t) UNION ALL
  SELECT text, substr(rest, length(piece) + 1), round(cost - ln(p), 9) FROM r JOIN vocab ON starts_with(rest, piece))
  SELECT text, round(cost, 5) AS cost FROM r WHERE rest = ''""")
def search_prefix_canonical(spark, sf):
    """The prefix is written as the tokenizer writes it, and nothing else may stand there; what follows in every way."""
    asked = PatternQuery(Text("the(re|n|se|in)", prefix="the"), tokens=Tokens.PREFIX_CANONICAL)
    found = replace(prepare(piece_model(spark, sf)), in_process=_IN_PROCESS.get()).search(asked)
    return found.select("text", F.round("cost", 5).alias("cost"))


#: A byte-level BPE vocabulary file: base64 pieces and ranks.
BPE = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def bpe_vocabulary(path: str = BPE) -> Vocabulary:
    found = Vocabulary.from_tiktoken(path)
    return Vocabulary(found.ids, None, max(found.pieces) + 1, found.ranks)


def bpe_model(docs, path: str = BPE) -> LanguageModel:
    """Tokens of a byte-level BPE vocabulary by how often they stand in texts, whatever came before."""
    tokens = F.pandas_udf(lambda texts: texts.map(lambda t: list(bpe_vocabulary(path).canonical(t) or ())), "array<int>")
    counted = docs.where("text is not null").select(F.explode(tokens("text")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).select(F.array().cast("array<int>").alias("context"), "token", "n")
    vocabulary = bpe_vocabulary(path)
    return LanguageModel.from_counts(counted, 0, eos=vocabulary.eos, vocabulary=vocabulary)


def search_bpe(spark, sf):
    """Every way to write some strings in the tokens of a byte-level BPE vocabulary, likeliest first. Checked against brute force in the tests."""
    found = prepare(bpe_model(read(spark, sf, "documents"))).search(PatternQuery(Text(" (the|then|thing|nation|é)"), limit=25))
    return answers(found)


if os.path.exists(BPE):
    query()(search_bpe)


def _on_tables(name: str) -> None:
    """Registers a search once more, on frontier tables whatever its size."""
    run, sql = QUERIES[name]

    def search(spark, sf):
        before = _IN_PROCESS.set(False)
        try:
            return run(spark, sf)
        finally:
            _IN_PROCESS.reset(before)

    search.__name__ = f"{name}_tables"
    query(sql)(search)


for _name in ("search_shortest_path", "search_topk", "search_prefix_penalized", "search_eos", "search_max_len", "search_max_cost", "search_many_queries", "search_enumerate_bfs", "search_beam", "search_random_walk", "search_prefix_canonical"):
    _on_tables(_name)
