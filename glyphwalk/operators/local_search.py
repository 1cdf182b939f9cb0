"""The same search in one process, for models and plans that are small enough; sizes are checked.

A pattern over a character model touches a few thousand model rows. Then a job per level costs far
more than the level itself, so the rows that the pattern can touch are fetched once (never more than
``ROWS``) and the frontier is advanced here. Answers are the same as those of the frontier tables.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphwalk.operators.language_model import LanguageModel
from glyphwalk.plans.automaton import Automaton
from glyphwalk.plans.query import Order, SearchOptions

ROWS, FRONTIER_ROWS, RANGES = 200_000, 100_000, 300


class TooLarge(Exception):
    """The search needs the cluster."""


def _few(df: DataFrame) -> list:
    rows = df.limit(ROWS + 1).collect()
    if len(rows) > ROWS:
        raise TooLarge
    return rows


class LocalModel:
    """Model rows that the plans can touch, and the mass of every context's allowed tokens."""

    def __init__(self, model: LanguageModel, automata: list[Automaton], top_k: int | None):
        spans = sorted({(lo, hi) for a in automata for lo, hi in a.labels()})
        if len(spans) > RANGES:
            spans = [(spans[0][0], max(hi for _, hi in spans))]
        touched = F.lit(False)
        for lo, hi in spans:
            touched |= F.col("token").between(lo, hi)
        self.rows: dict[tuple, dict[int, tuple[float, int]]] = {}
        for r in _few(model.rows.where(touched)):
            self.rows.setdefault(tuple(r["context"]), {})[r["token"]] = (r["p"], r["rank"])
        kept = model.rows if top_k is None else model.rows.where(F.col("rank") <= top_k)
        self.mass = {tuple(r["context"]): r["zk"] for r in _few(kept.groupBy("context").agg(F.sum("p").alias("zk")))}
        self.tokens = sorted({t for row in self.rows.values() for t in row})
        self.order, self.start = model.order, tuple(model.start)

    def after(self, context: tuple, token: int) -> tuple:
        return (*context, token)[-self.order :] if self.order else ()


class Walk:
    """Steps of one plan under its policy."""

    def __init__(self, model: LocalModel, automaton: Automaton, prefix: Automaton | None, o: SearchOptions):
        self.model, self.automaton, self.prefix, self.o = model, automaton, prefix, o
        self._arcs: dict = {}

    def arcs(self, a: Automaton, state: int) -> dict[int, int]:
        key = (a is self.prefix, state)
        if key not in self._arcs:
            found, known = {}, self.model.tokens
            for lo, hi, dst in a.arcs[state]:
                for t in [lo] if lo == hi else known[bisect_left(known, lo) : bisect_right(known, hi)]:
                    found[t] = dst
            self._arcs[key] = dict(sorted(found.items()))
        return self._arcs[key]

    def steps(self, state: int, inside: int | None, context: tuple):
        """(token, dst, prefix state after, q, z, rank, let in by the prefix)"""
        o, row = self.o, self.model.rows.get(context, {})
        base = lambda t: row[t][0] if t in row and (o.top_k is None or row[t][1] <= o.top_k) else 0.0
        allowed = self.arcs(self.prefix, inside) if self.prefix is not None and inside is not None else {}
        given = (lambda t: row[t][0] if t in row else 0.0) if o.penalize_prefix else (lambda t: 1.0)
        z = self.model.mass.get(context, 0.0)
        if allowed:
            mass = sum(given(t) for t in allowed)
            z = mass if o.stay_in_prefix else z - sum(map(base, allowed)) + mass
        for t, dst in self.arcs(self.automaton, state).items():
            let = t in allowed
            q = given(t) if let else 0.0 if allowed and o.stay_in_prefix else base(t)
            yield t, dst, allowed.get(t), q, z, row[t][1] if t in row else None, let


def best(model: LocalModel, plan, check=None) -> list[tuple[list[int], float]]:
    """(tokens, cost) of the plan's answers, at most its limit."""
    o = plan.options
    walk, plain, greedy = Walk(model, plan.automaton, plan.prefix, o), o.order is Order.ENUMERATE, o.order is Order.GREEDY
    rank_of = (lambda f: (len(f[1]), f[1])) if plain else (lambda f: (f[0], f[1]))
    found = [(0.0, ())] if 0 in plan.automaton.finals else []
    frontier = [(0.0, (), 0, None if plan.prefix is None else 0, model.start)] if not plan.automaton.is_empty else []
    for _ in range(plan.max_len):
        after = []
        for cost, tokens, state, inside, context in frontier:
            for t, dst, into, q, z, rank, let in walk.steps(state, inside, context):
                if plain:
                    if not (let or not o.top_k or rank is not None and rank <= o.top_k):
                        continue
                    price = 0.0
                elif let and o.top_k and not o.penalize_prefix:
                    price = 0.0
                elif q > 0 and z > 0:
                    price = -math.log(q / z)
                else:
                    continue
                total = price if greedy else max(cost, price) if o.aggregation == "max" else cost + price
                after.append((abs(round(total, 9)), (*tokens, t), dst, into, model.after(context, t)))
        if check is not None:
            after = [f for f in after if check(f[1])]
        if o.order is Order.BEAM or greedy:
            after = sorted(after, key=rank_of)[: (o.beam or 1) if o.order is Order.BEAM else max(1, o.limit or 1)]
        elif o.limit is not None and not plain and check is None:
            same: dict[tuple, int] = {}
            kept = []
            for f in sorted(after, key=rank_of):
                same[f[2:]] = same.get(f[2:], 0) + 1
                if same[f[2:]] <= o.limit:
                    kept.append(f)
            after = kept
            if o.limit and len(found) >= o.limit:
                after = [f for f in after if f[0] <= found[-1][0]]
        if len(after) > FRONTIER_ROWS:
            raise TooLarge
        frontier = after
        found += [(f[0], f[1]) for f in frontier if f[2] in plan.automaton.finals]
        if o.limit is not None:
            found = sorted(found, key=rank_of)[: o.limit]
        if not frontier or plain and o.limit is not None and len(found) >= o.limit:
            break
    return [(list(t), c) for c, t in found]


def uniform(seed: int, walker: int, depth: int) -> float:
    return int(hashlib.md5(f"{seed}:{walker}:{depth}".encode()).hexdigest()[:8], 16) / 2**32


def sample(model: LocalModel, plan, attempts: int) -> list[tuple[int, list[int], float]]:
    """(walker, tokens, cost) of ``limit`` walks."""
    o, automaton, weights = plan.options, plan.automaton, None
    n = o.limit or 1
    if n * plan.max_len > 2_000_000:
        raise TooLarge
    if plan.prefix is not None and o.unbiased_prefix:
        automaton = automaton.truncated(plan.max_len)
        weights = {}
        for s, lo, hi, _, w in automaton.weights():
            weights.setdefault(s, []).append((lo, hi, w))
    if automaton.is_empty:
        return []
    walk, memo, out = Walk(model, automaton, plan.prefix, o), {}, []

    def moves(place: tuple) -> list:
        if place not in memo:
            steps = list(walk.steps(*place))
            if weights is not None and all(let for *_, let in steps):
                w = lambda t: next(w for lo, hi, w in weights[place[0]] if lo <= t <= hi)
                steps = [(t, dst, into, w(t), 1.0, rank, let) for t, dst, into, _, _, rank, let in steps]
            memo[place] = [s for s in steps if s[3] > 0]
        return memo[place]

    for walker in range(n):
        for attempt in range(attempts):
            place, tokens, cost = (0, None if plan.prefix is None else 0, model.start), [], 0.0
            for depth in range(plan.max_len):
                ahead = moves(place)
                total, run = sum(s[3] for s in ahead), 0.0
                u = uniform(o.seed + 1_000_003 * attempt, walker, depth) * total
                for t, dst, into, q, z, _, _ in ahead:
                    run += q
                    if run > u:
                        break
                else:
                    break
                tokens.append(t)
                cost = round(cost - math.log(q / z), 9)
                place = (dst, into, model.after(place[2], t))
                if dst in automaton.finals and not automaton.arcs[dst]:
                    out.append((walker, tokens, cost))
                    break
            if out and out[-1][0] == walker:
                break
    return out
