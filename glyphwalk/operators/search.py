"""Pattern search over a language model: a frontier table that advances one token a level.

A frontier row is (query_id, state, prefix_state, context, tokens, cost). A level joins it with the
arcs of the pattern's token automaton and with the model, both on equality. Costs are -log p,
rounded to nine digits before any comparison. Three prunes keep the frontier small, all exact:

* bound: arcs cost nothing less than zero, so rows dearer than the n-th answer so far are dropped;
* dominance: the future depends on (query, state, prefix state, context) only, so of each such
  group the n best rows stay (not with checks of the whole path);
* reachability: automata are trimmed, so every state leads to an answer.

Queries that share their options advance together in one frontier, told apart by ``query_id``.
A level is written once, as a table in the shared folder that tells its answers too; nothing of it
comes to the driver but its size. Ranks of unlimited answers come from a range-sorted table, so no
task holds the answers of a query. Searches that touch few model rows skip the tables altogether
(``local_search``); both ways give the same answers.
"""

from __future__ import annotations

import warnings
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphwalk.operators import local_search
from glyphwalk.operators.language_model import LanguageModel, pick, uniform
from glyphwalk.operators.vocabulary import Vocabulary
from glyphwalk.plans.automaton import Automaton
from glyphwalk.plans.cut import cut
from glyphwalk.plans.query import Order, PatternQuery, SearchOptions, Tokens, as_options

BROADCAST_ROWS, DEFAULT_LEN = 1_000_000, 64
FRONTIER = "query_id string, state int, prefix_state int, context array<int>, tokens array<int>, cost double"


@dataclass(frozen=True)
class Plan:
    """A compiled query: token automata of the pattern and of the prefix, and the longest answer."""

    query_id: str
    options: SearchOptions
    automaton: Automaton
    prefix: Automaton | None
    max_len: int

    def stats(self) -> dict:
        """What is known before the search, with ten random answers of the pattern alone and the bytes that all of its tokens take at most."""
        a = self.automaton
        n = a.cardinality()
        return {
            "states": len(a.arcs), "arcs": sum(map(len, a.arcs)), "cyclic": a.is_cyclic, "cardinality": n,
            "sample": list(a.random_strings(10, self.options.seed, self.max_len)), "bytes": None if n is None else 4 * n * self.max_len,
        }


def _characters(o: SearchOptions, pattern: str | None, given: Automaton | None) -> Automaton:
    a = given if given is not None else Automaton.of_pattern(pattern, o.unicode)
    for e in o.edits:
        a = e.apply(a)
    return a


def compile_query(query: PatternQuery | SearchOptions, vocabulary: Vocabulary, query_id: str = "0") -> Plan:
    """Pattern, edits and exclusion as one character automaton, lifted to tokens."""
    o = query if isinstance(query, SearchOptions) else as_options(query)
    own = o.pattern is not None
    a = _characters(o, o.pattern, None if own else o.automaton)
    if o.exclude is not None:
        a = a.difference(Automaton.of_pattern(o.exclude, o.unicode))
    canonical = o.tokens is Tokens.CANONICAL

    def lifted(chars: Automaton, canonical: bool) -> Automaton:
        if o.tokens is Tokens.CHARACTERS:
            return chars.relabel({x: vocabulary.ids[chr(x)] for lo, hi in chars.labels() for x in range(lo, hi + 1) if chr(x) in vocabulary.ids})
        return vocabulary.lift_canonical(chars, o.max_len) if canonical else vocabulary.lift(chars)

    tokens = lifted(a, canonical) if own else o.automaton
    prefix = None
    if o.prefix is not None:
        prefix = lifted(_characters(o, o.prefix, None), canonical or o.tokens is Tokens.PREFIX_CANONICAL).prefixes()
    elif o.prefix_automaton is not None:
        prefix = o.prefix_automaton.prefixes()
    if o.end:
        tokens = tokens.concat(Automaton.any_of([vocabulary.eos]))
    longest = None if tokens.is_cyclic else tokens.longest()
    if longest is None and o.max_len is None:
        warnings.warn(f"the language is infinite and the query has no max_len; answers end at {DEFAULT_LEN} tokens", stacklevel=2)
    max_len = min(x for x in (o.max_len, longest, DEFAULT_LEN if longest is None and o.max_len is None else None) if x is not None)
    return Plan(query_id, o, tokens, prefix, max_len)


def _expanded(spark: SparkSession, plans: list[Plan], automata: list[Automaton | None], model: LanguageModel, names: tuple[str, str]) -> DataFrame:
    """(query_id, src, token, dst): arcs with their label ranges spread over the model's tokens."""
    rows = [(p.query_id, s, lo, hi, d) for p, a in zip(plans, automata, strict=True) if a is not None for s, arcs in enumerate(a.arcs) for lo, hi, d in arcs]
    single = [(q, s, lo, d) for q, s, lo, hi, d in rows if lo == hi]
    ranges = [r for r in rows if r[2] < r[3]]
    out = spark.createDataFrame(single, "query_id string, src int, token int, dst int")
    if ranges:
        wide = spark.createDataFrame(ranges, "query_id string, src int, lo int, hi int, dst int")
        known = model.rows.select("token").distinct()
        out = out.unionByName(known.join(F.broadcast(wide), F.col("token").between(F.col("lo"), F.col("hi"))).select("query_id", "src", "token", "dst"))
    found = cut(out.toDF("query_id", names[0], "token", names[1]))
    return F.broadcast(found) if found.count() <= BROADCAST_ROWS else found


def _start(spark: SparkSession, plans: list[Plan], model: LanguageModel) -> DataFrame:
    rows = [(p.query_id, 0, None if p.prefix is None else 0, model.start, [], 0.0) for p in plans if not p.automaton.is_empty]
    return spark.createDataFrame(rows, FRONTIER)


def _steps(frontier: DataFrame, edges: DataFrame, forced: DataFrame | None, model: LanguageModel, contexts: DataFrame, o: SearchOptions) -> DataFrame:
    """All arcs from the frontier with q (weight before normalisation), z (its sum) and in_prefix.

    The sum runs over the model's whole row, arcs of the pattern or not; so it comes from a table of
    contexts, corrected for the tokens that the prefix lets in.
    """
    keep = F.lit(True) if o.top_k is None else F.coalesce(F.col("rank") <= o.top_k, F.lit(False))
    base = F.when(keep, F.coalesce("p", F.lit(0.0))).otherwise(F.lit(0.0))
    here = frontier.join(edges, (frontier["query_id"] == edges["query_id"]) & (F.col("state") == F.col("src"))).drop(edges["query_id"]).drop("src")
    here = here.join(model.rows, ["context", "token"], "left").withColumn("base", base).join(contexts, "context", "left")
    own = F.coalesce("zk", F.lit(0.0))
    if forced is None:
        return here.select("*", F.col("base").alias("q"), own.alias("z"), F.lit(False).alias("in_prefix"), F.lit(None).cast("int").alias("after_prefix"))
    places = frontier.where("prefix_state is not null").select("query_id", "prefix_state", "context").distinct()
    allowed = places.join(forced, ["query_id", "prefix_state"]).join(model.rows, ["context", "token"], "left").withColumn("base", base)
    sums = allowed.groupBy("query_id", "prefix_state", "context").agg(
        F.count(F.lit(1)).alias("a_n"), F.sum(F.coalesce("p", F.lit(0.0))).alias("a_p"), F.sum("base").alias("a_base")
    )
    here = here.join(forced, ["query_id", "prefix_state", "token"], "left").join(sums, ["query_id", "prefix_state", "context"], "left")
    inside, some = F.col("after_prefix").isNotNull(), F.coalesce(F.col("a_n") > 0, F.lit(False))
    given = F.coalesce("p", F.lit(0.0)) if o.penalize_prefix else F.lit(1.0)
    mass = F.col("a_p") if o.penalize_prefix else F.col("a_n").cast("double")
    q, z = F.when(inside, given).otherwise(F.col("base")), F.when(some, own - F.col("a_base") + mass).otherwise(own)
    if o.stay_in_prefix:
        q, z = F.when(some & ~inside, F.lit(0.0)).otherwise(q), F.when(some, mass).otherwise(own)
    return here.select("*", q.alias("q"), z.alias("z"), inside.alias("in_prefix"))


def _contexts(model: LanguageModel, top_k: int | None) -> DataFrame:
    kept = model.rows if top_k is None else model.rows.where(F.col("rank") <= top_k)
    return kept.groupBy("context").agg(F.sum("p").alias("zk"))


def _finals(spark: SparkSession, plans: list[Plan]) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(p.query_id, s) for p in plans for s in p.automaton.finals], "query_id string, state int"))


RESULT = "query_id string, tokens array<int>, cost double"


def _best(model: LanguageModel, plans: list[Plan], o: SearchOptions) -> DataFrame:
    """(query_id, tokens, cost) of likeliest, beam and greedy search and of enumeration."""
    spark = model.rows.sparkSession
    edges = _expanded(spark, plans, [p.automaton for p in plans], model, ("src", "dst"))
    forced = _expanded(spark, plans, [p.prefix for p in plans], model, ("prefix_state", "after_prefix")) if any(p.prefix for p in plans) else None
    contexts, finals = cut(_contexts(model, o.top_k)), _finals(spark, plans)
    frontier = _start(spark, plans, model)
    ends = finals.withColumn("final", F.lit(True))
    found = spark.createDataFrame([(p.query_id, [], 0.0) for p in plans if 0 in p.automaton.finals], RESULT)
    levels: list[DataFrame] = []
    lengths = spark.createDataFrame([(p.query_id, p.max_len) for p in plans], "query_id string, max_len int")
    greedy, plain = o.order is Order.GREEDY, o.order is Order.ENUMERATE
    checked = _canonical_check(plans, model) if o.dynamic_canonical else None
    for depth in range(1, max(p.max_len for p in plans) + 1):
        if o.stay_in_prefix or o.top_k or forced is not None or not plain:
            steps = _steps(frontier, edges, forced, model, contexts, o)
            free = F.lit(bool(o.top_k) and not o.penalize_prefix) & F.col("in_prefix")
            if plain:  # a token passes if the prefix lets it or it is among the k likeliest; costs don't count
                steps = steps.where(F.col("in_prefix") | (F.lit(not o.top_k) | F.coalesce(F.col("rank") <= (o.top_k or 0), F.lit(False))))
                price = F.lit(0.0)
            else:
                steps = steps.where(((F.col("q") > 0) & (F.col("z") > 0)) | free)
                price = F.when(free, F.lit(0.0)).otherwise(-F.ln(F.col("q") / F.col("z")))
        else:
            steps = frontier.join(edges, (frontier["query_id"] == edges["query_id"]) & (F.col("state") == F.col("src"))).drop(edges["query_id"]).withColumn("after_prefix", F.lit(None).cast("int"))
            price = F.lit(0.0)
        total = price if greedy else F.greatest("cost", price) if o.aggregation == "max" else F.col("cost") + price
        after = steps.select(
            "query_id", F.col("dst").alias("state"), F.col("after_prefix").alias("prefix_state"),
            (F.slice(F.array_append("context", F.col("token")), -model.order, model.order) if model.order else F.col("context")).alias("context"),
            F.array_append("tokens", F.col("token")).alias("tokens"), F.abs(F.round(total, 9)).alias("cost"),
        ).join(F.broadcast(lengths).where(F.col("max_len") >= depth), "query_id", "left_semi")
        if checked is not None:
            after = after.where(checked("tokens"))
        order = Window.partitionBy("query_id").orderBy("cost", "tokens")
        if o.order is Order.BEAM or greedy:
            width = (o.beam or 1) if o.order is Order.BEAM else max(1, o.limit or 1)
            after = after.withColumn("k", F.row_number().over(order)).where(F.col("k") <= width).drop("k")
        elif o.limit is not None and not plain and checked is None:
            same = Window.partitionBy("query_id", "state", "prefix_state", "context").orderBy("cost", "tokens")
            after = after.withColumn("k", F.row_number().over(same)).where(F.col("k") <= o.limit).drop("k")
            if o.limit:
                full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("have"), F.max("cost").alias("bound")).where(F.col("have") >= o.limit)
                after = after.join(F.broadcast(full), "query_id", "left").where("bound is null or cost <= bound").drop("have", "bound")
        frontier = cut(after.join(ends, ["query_id", "state"], "left"))
        new = frontier.where("final").select("query_id", "tokens", "cost")
        frontier = frontier.drop("final")
        if o.limit is None:
            levels.append(new)
        else:
            ahead = Window.partitionBy("query_id").orderBy(*([F.size("tokens")] if plain else ["cost"]), "tokens")
            found = cut(found.unionByName(new).withColumn("k", F.row_number().over(ahead)).where(F.col("k") <= o.limit).drop("k"))
        if frontier.isEmpty() or plain and o.limit is not None and found.count() >= o.limit * len(plans):
            break
    return reduce(DataFrame.unionByName, levels, found)


def _canonical_check(plans: list[Plan], model: LanguageModel):
    vocabulary = model.vocabulary
    marks = {vocabulary.eos, vocabulary.bos}

    @F.pandas_udf("boolean")
    def check(tokens: pd.Series) -> pd.Series:
        # A path may still grow: it is canonical so far if its own text would be written the same way.
        return tokens.map(lambda t: vocabulary.is_canonical([x for x in t if x not in marks]))

    return check


def _sampled(model: LanguageModel, plans: list[Plan], o: SearchOptions) -> DataFrame:
    """(query_id, tokens, cost, walker): ``limit`` walks per query; stuck walkers start again with another seed, ``attempts`` times in all."""
    spark = model.rows.sparkSession
    n = o.limit or 1
    edges = _expanded(spark, plans, [p.automaton for p in plans], model, ("src", "dst"))
    forced, weights = None, None
    if any(p.prefix for p in plans):
        forced = _expanded(spark, plans, [p.prefix for p in plans], model, ("prefix_state", "after_prefix"))
        if o.unbiased_prefix:
            rows = [(p.query_id, s, lo, hi, d, w) for p in plans for s, lo, hi, d, w in p.automaton.truncated(p.max_len).weights()]
            weights = F.broadcast(spark.createDataFrame(rows, "query_id string, src int, lo int, hi int, dst int, w double"))
            plans = [Plan(p.query_id, p.options, p.automaton.truncated(p.max_len), p.prefix, p.max_len) for p in plans]
            edges = _expanded(spark, plans, [p.automaton for p in plans], model, ("src", "dst"))
    contexts, finals = cut(_contexts(model, o.top_k)), _finals(spark, plans)
    start = F.array(*[F.lit(t) for t in model.start]).cast("array<int>")
    first = reduce(DataFrame.unionByName, [
        spark.range(n if not p.automaton.is_empty else 0).select(
            F.lit(p.query_id).alias("query_id"), F.lit(0).alias("state"), F.lit(None if p.prefix is None else 0).cast("int").alias("prefix_state"),
            start.alias("context"), F.array().cast("array<int>").alias("tokens"), F.lit(0.0).alias("cost"), F.col("id").alias("walker"),
        )
        for p in plans
    ])
    done: list[DataFrame] = []
    for attempt in range(o.attempts):
        frontier = first
        for d in done:
            frontier = frontier.join(d, ["query_id", "walker"], "left_anti")
        if done and frontier.isEmpty():
            break
        for depth in range(max(p.max_len for p in plans)):
            steps = _steps(frontier, edges, forced, model, contexts, o)
            if weights is not None:
                w = weights.select(F.col("query_id").alias("wq"), F.col("src").alias("ws"), "lo", "hi", "w")
                steps = steps.join(w, (F.col("query_id") == F.col("wq")) & (F.col("state") == F.col("ws")) & F.col("token").between(F.col("lo"), F.col("hi")), "left").drop("wq", "ws", "lo", "hi")
                whole = F.min(F.col("in_prefix").cast("int")).over(Window.partitionBy("query_id", "walker")) == 1
                steps = steps.withColumn("q", F.when(whole, F.col("w")).otherwise(F.col("q"))).withColumn("z", F.when(whole, F.lit(1.0)).otherwise(F.col("z"))).drop("w")
            moves = steps.where("q > 0")
            chosen = pick(moves, ["query_id", "walker"], "token", "q", uniform(o.seed + 1_000_003 * attempt, F.col("walker"), depth))
            after = chosen.select(
                "query_id", F.col("dst").alias("state"), F.col("after_prefix").alias("prefix_state"),
                (F.slice(F.array_append("context", F.col("token")), -model.order, model.order) if model.order else F.col("context")).alias("context"),
                F.array_append("tokens", F.col("token")).alias("tokens"), F.round(F.col("cost") - F.ln(F.col("q") / F.col("z")), 9).alias("cost"), "walker",
            )
            frontier = cut(after)
            over = frontier.join(finals, ["query_id", "state"], "left_semi")
            # A walk ends at a final state that nothing follows (the end mark).
            ended = over.join(edges, (over["query_id"] == edges["query_id"]) & (F.col("state") == F.col("src")), "left_anti")
            done.append(cut(ended.select("query_id", "walker", "tokens", "cost")))
            frontier = frontier.join(done[-1], ["query_id", "walker"], "left_anti")
            if frontier.isEmpty():
                break
    return reduce(DataFrame.unionByName, done) if done else first.select("query_id", "walker", "tokens", "cost").limit(0)


def decode(found: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Adds ``text``. Marks stand for nothing; the vocabulary is joined, so it may be of any size."""
    spark = found.sparkSession
    keyed = found.withColumn("__id", F.struct(*found.columns))
    if vocabulary.ranks is not None:
        back = F.pandas_udf(lambda s: s.map(lambda t: vocabulary.decode(t)), "string")
        return found.withColumn("text", back("tokens"))
    spread = keyed.select("__id", F.posexplode_outer("tokens").alias("pos", "token"))
    pieces = spread.join(vocabulary.frame(spark).select("token", "piece"), "token", "left")
    texts = pieces.groupBy("__id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("piece", F.lit("")).alias("piece")))).alias("l"))
    return texts.select("__id.*", F.array_join(F.transform("l", lambda x: x["piece"]), "").alias("text"))


def _in_process(model: LanguageModel, plans: list[Plan], o: SearchOptions) -> DataFrame:
    """The same answers without a job per level; raises TooLarge beyond the sizes checked there."""
    few = local_search.LocalModel(model, [a for p in plans for a in (p.automaton, p.prefix) if a is not None], o.top_k)
    spark = model.rows.sparkSession
    if o.order is Order.RANDOM:
        rows = [(p.query_id, w, t, c) for p in plans for w, t, c in local_search.sample(few, p, o.attempts)]
        return spark.createDataFrame(rows, "query_id string, walker long, tokens array<int>, cost double")
    marks = {model.vocabulary.eos, model.vocabulary.bos}
    check = (lambda tokens: model.vocabulary.is_canonical([t for t in tokens if t not in marks])) if o.dynamic_canonical else None
    return spark.createDataFrame([(p.query_id, t, c) for p in plans for t, c in local_search.best(few, p, check)], RESULT)


def _numbered(found: DataFrame, order: list) -> DataFrame:
    """Adds ``rank`` within each query, however many rows it has: places in a range-sorted table plus the rows of the parts before."""
    laid = found.repartitionByRange("query_id", *order).sortWithinPartitions("query_id", *order)
    laid = cut(laid.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    parts = laid.groupBy("query_id", "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("query_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    rank = (F.col("__before") + F.col("__at") - F.col("__first") + 1).alias("rank")
    return laid.join(F.broadcast(parts), ["query_id", "__part"]).select(*found.columns, rank)  # a row per part and query


def run_plans(model: LanguageModel, plans: list[Plan], in_process: bool = True) -> DataFrame:
    """Answers of all plans: (query_id, rank, tokens, text, cost), ranks from 1 by cost and tokens (samples: by walker).

    Small searches run in the driver's process (their size is checked first), others as frontier tables.
    """
    groups: dict[tuple, list[Plan]] = defaultdict(list)
    for p in plans:
        o = p.options
        groups[o.order, o.limit, o.top_k, o.temperature, o.aggregation, o.beam, o.dynamic_canonical, o.penalize_prefix, o.stay_in_prefix, o.unbiased_prefix, o.seed, o.attempts].append(p)
    out = []
    for members in groups.values():
        o = members[0].options
        tempered = model.temper(o.temperature)
        tempered = tempered if tempered is model else tempered.settled()
        random = o.order is Order.RANDOM
        small = True
        try:
            if not in_process:
                raise local_search.TooLarge
            found = _in_process(tempered, members, o)
        except local_search.TooLarge:
            small, found = False, (_sampled if random else _best)(tempered, members, o)
        order = ["walker"] if random else [*([F.size("tokens")] if o.order is Order.ENUMERATE else ["cost"]), "tokens"]
        if small or o.limit is not None and not random:
            ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
        else:
            ranked = _numbered(found, order)
        out.append(decode(ranked.select("query_id", "rank", "tokens", "cost"), model.vocabulary))
    return reduce(DataFrame.unionByName, out).select("query_id", "rank", "tokens", "text", "cost")
