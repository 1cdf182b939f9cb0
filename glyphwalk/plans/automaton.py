"""Finite automata over integer labels (code points or token ids), built on the driver as plans.

An ``Automaton`` is deterministic, trimmed to states that lie on some accepted path, and starts in
state 0. Its arcs carry label ranges, so ``.`` is two arcs and not a million. The empty language is
one state without finals. All operations return minimal automata.
"""

from __future__ import annotations

import random
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from glyphwalk.plans.pattern import LAST, Alternatives, Chars, Concat, Empty, Node, Repeat, parse

Arc = tuple[int, int, int]


class Infinite(ValueError):
    """The operation needs a finite language."""


@dataclass(frozen=True)
class Automaton:
    arcs: tuple[tuple[Arc, ...], ...]
    finals: frozenset[int]

    # --- construction -------------------------------------------------------------------------

    @staticmethod
    def of_pattern(pattern: str, unicode: bool = True) -> Automaton:
        return Automaton.of_tree(parse(pattern, unicode))

    @staticmethod
    def of_tree(node: Node) -> Automaton:
        nfa = Nfa()
        nfa.finals.add(nfa.add_tree(nfa.start, node))
        return nfa.determinize()

    @staticmethod
    def of_strings(strings: Iterable[Sequence[int] | str]) -> Automaton:
        """Exactly these strings (or label sequences)."""
        nfa = Nfa()
        tree: dict[tuple[int, int], int] = {}
        for s in strings:
            at = nfa.start
            for label in [ord(c) for c in s] if isinstance(s, str) else s:
                if (at, label) not in tree:
                    tree[at, label] = nfa.state()
                    nfa.arc(at, label, label, tree[at, label])
                at = tree[at, label]
            nfa.finals.add(at)
        return nfa.determinize()

    @staticmethod
    def nothing() -> Automaton:
        return Automaton(((),), frozenset())

    @staticmethod
    def epsilon() -> Automaton:
        return Automaton(((),), frozenset([0]))

    @staticmethod
    def any_of(labels: Iterable[int]) -> Automaton:
        return Automaton.of_strings([(x,) for x in labels])

    # --- inspection ---------------------------------------------------------------------------

    def step(self, state: int, label: int) -> int | None:
        for lo, hi, dst in self.arcs[state]:
            if lo <= label <= hi:
                return dst
        return None

    def run(self, labels: Sequence[int] | str, state: int = 0) -> int | None:
        for x in [ord(c) for c in labels] if isinstance(labels, str) else labels:
            state = self.step(state, x)
            if state is None:
                return None
        return state

    def accepts(self, labels: Sequence[int] | str) -> bool:
        return self.run(labels) in self.finals

    def next_labels(self, labels: Sequence[int] | str = ()) -> list[Arc]:
        """Arcs that go on from the state reached by ``labels``; none if the path falls off."""
        at = self.run(labels)
        return [] if at is None else list(self.arcs[at])

    def longest_match(self, text: str) -> str | None:
        """The longest accepted beginning of a text; None if there is none."""
        at, best = 0, 0 if 0 in self.finals else None
        for i, c in enumerate(text):
            at = self.step(at, ord(c))
            if at is None:
                break
            if at in self.finals:
                best = i + 1
        return None if best is None else text[:best]

    def parents(self) -> list[set[int]]:
        """States with an arc into each state."""
        out: list[set[int]] = [set() for _ in self.arcs]
        for s, a in enumerate(self.arcs):
            for _, _, d in a:
                out[d].add(s)
        return out

    @property
    def is_empty(self) -> bool:
        return not self.finals

    def labels(self) -> list[tuple[int, int]]:
        """Distinct label ranges, cut so that none overlap."""
        cuts = sorted({x for a in self.arcs for lo, hi, _ in a for x in (lo, hi + 1)})
        used = [(lo, hi) for a in self.arcs for lo, hi, _ in a]
        return [(a, b - 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if any(lo <= a <= hi for lo, hi in used)]

    def order(self) -> list[int] | None:
        """States in topological order; None if there is a cycle."""
        into = [0] * len(self.arcs)
        for a in self.arcs:
            for dst in {d for _, _, d in a}:
                into[dst] += 1
        queue, out = deque(s for s, n in enumerate(into) if not n), []
        while queue:
            s = queue.popleft()
            out.append(s)
            for dst in {d for _, _, d in self.arcs[s]}:
                into[dst] -= 1
                if not into[dst]:
                    queue.append(dst)
        return out if len(out) == len(self.arcs) else None

    @property
    def is_cyclic(self) -> bool:
        return self.order() is None

    def longest(self) -> int:
        """Arcs on the longest accepted path."""
        order = self.order()
        if order is None:
            raise Infinite("the language is infinite")
        depth = [0] * len(self.arcs)
        for s in order:
            for _, _, dst in self.arcs[s]:
                depth[dst] = max(depth[dst], depth[s] + 1)
        return max((depth[s] for s in self.finals), default=0)

    def counts(self, max_len: int) -> list[int]:
        """Accepted strings of each length from 0 to ``max_len``."""
        here, out = {0: 1}, []
        for _ in range(max_len + 1):
            out.append(sum(n for s, n in here.items() if s in self.finals))
            after: dict[int, int] = defaultdict(int)
            for s, n in here.items():
                for lo, hi, dst in self.arcs[s]:
                    after[dst] += n * (hi - lo + 1)
            here = after
        return out

    def cardinality(self) -> int | None:
        """Number of accepted strings; None: infinite."""
        return None if self.is_cyclic else sum(self.counts(self.longest()))

    def completions(self, max_len: int | None = None) -> list[int]:
        """Accepted continuations of every state (the empty one included)."""
        order = self.order()
        if order is None and max_len is None:
            raise Infinite("weights need a finite language; truncate it first")
        if order is None:
            return self.truncated(max_len).completions()
        out = [0] * len(self.arcs)
        for s in reversed(order):
            out[s] = int(s in self.finals) + sum((hi - lo + 1) * out[dst] for lo, hi, dst in self.arcs[s])
        return out

    def weights(self) -> list[tuple[int, int, int, int, float]]:
        """(src, lo, hi, dst, weight of one label): a walk by weight is uniform over accepted strings."""
        left = self.completions()
        return [
            (s, lo, hi, dst, float(Fraction(left[dst], sum((h - o + 1) * left[d] for o, h, d in a))))
            for s, a in enumerate(self.arcs) for lo, hi, dst in a
        ]

    def strings(self, limit: int | None = None, max_len: int | None = None) -> Iterator[tuple[int, ...]]:
        """Accepted label sequences, shortest first, then by label."""
        if self.is_cyclic and limit is None and max_len is None:
            raise Infinite("the language is infinite")
        queue: deque[tuple[int, tuple[int, ...]]] = deque([(0, ())])
        while queue and limit != 0:
            s, path = queue.popleft()
            if s in self.finals:
                yield path
                limit = None if limit is None else limit - 1
            if max_len is None or len(path) < max_len:
                queue.extend((dst, (*path, x)) for lo, hi, dst in self.arcs[s] for x in range(lo, hi + 1))

    def random_strings(self, n: int, seed: int = 0, max_len: int | None = None) -> Iterator[tuple[int, ...]]:
        """n accepted label sequences, drawn with replacement, each as likely as any other of at most ``max_len`` labels."""
        a = self.truncated(max_len) if max_len is not None else self
        if a.is_empty:
            return
        left, r = a.completions(), random.Random(seed)
        for _ in range(n):
            s, path = 0, []
            while True:
                at = r.randrange(left[s])  # the string ends here if it is the first of the final state's completions
                if s in a.finals:
                    if not at:
                        break
                    at -= 1
                for lo, hi, dst in a.arcs[s]:
                    size = (hi - lo + 1) * left[dst]
                    if at < size:
                        path.append(lo + at // left[dst])
                        s = dst
                        break
                    at -= size
            yield tuple(path)

    def texts(self, limit: int | None = None, max_len: int | None = None) -> Iterator[str]:
        for s in self.strings(limit, max_len):
            yield "".join(map(chr, s))

    def summary(self) -> str:
        lines = [f"{s}{'*' if s in self.finals else ''} -[{lo if lo == hi else f'{lo}-{hi}'}]-> {d}" for s, a in enumerate(self.arcs) for lo, hi, d in a]
        return "\n".join(lines or ["0" + "*" * (0 in self.finals)])

    # --- algebra ------------------------------------------------------------------------------

    def nfa(self) -> Nfa:
        out = Nfa()
        out.add(out.start, self, out.finals)
        return out

    def union(self, *others: Automaton) -> Automaton:
        out = Nfa()
        for a in (self, *others):
            out.add(out.start, a, out.finals)
        return out.determinize()

    def concat(self, *others: Automaton) -> Automaton:
        out, ends = Nfa(), set()
        out.add(out.start, self, ends)
        for a in others:
            after: set[int] = set()
            middle = out.state()
            for e in ends:
                out.skip(e, middle)
            out.add(middle, a, after)
            ends = after
        out.finals |= ends
        return out.determinize()

    def optional(self) -> Automaton:
        return self.union(Automaton.epsilon())

    def repeat(self, least: int, most: int | None = None) -> Automaton:
        if least < 0 or most is not None and most < least:
            raise ValueError(f"repetition {least}..{most}")
        out = Nfa()
        at = out.start
        for i in range(least if most is None else most):
            if i >= least:
                out.finals.add(at)
            at = out.add_joined(at, self)
        if most is None:
            loop = out.state()
            out.skip(at, loop)
            out.skip(out.add_joined(loop, self), loop)
            at = loop
        out.finals.add(at)
        return out.determinize()

    def _product(self, other: Automaton, keep) -> Automaton:
        """Pairs of states; a missing state is -1."""
        index, arcs, finals = {(0, 0): 0}, [], set()
        queue = deque([(0, 0)])
        while queue:
            a, b = pair = queue.popleft()
            if keep(a in self.finals, b in other.finals):
                finals.add(index[pair])
            here = []
            mine, theirs = (self.arcs[a] if a >= 0 else ()), (other.arcs[b] if b >= 0 else ())
            cuts = sorted({x for arc in (*mine, *theirs) for x in (arc[0], arc[1] + 1)})
            for lo, stop in zip(cuts[:-1], cuts[1:], strict=True):
                to = tuple(next((d for l, h, d in side if l <= lo <= h), -1) for side in (mine, theirs))
                if to == (-1, -1):
                    continue
                if to not in index:
                    index[to] = len(index)
                    queue.append(to)
                here.append((lo, stop - 1, index[to]))
            arcs.append(here)
        return minimize(arcs, finals)

    def intersect(self, other: Automaton) -> Automaton:
        return self._product(other, lambda a, b: a and b)

    def difference(self, other: Automaton) -> Automaton:
        return self._product(other, lambda a, b: a and not b)

    def complement(self, last: int = LAST) -> Automaton:
        return Automaton((((0, last, 0),),), frozenset([0])).difference(self)

    def equivalent(self, other: Automaton) -> bool:
        return self._product(other, lambda a, b: a != b).is_empty

    def truncated(self, max_len: int) -> Automaton:
        """Strings of at most ``max_len`` labels."""
        spans = self.labels()
        any_ = Nfa()
        at = any_.start
        any_.finals.add(at)
        for _ in range(max_len):
            after = any_.state()
            for lo, hi in spans:
                any_.arc(at, lo, hi, after)
            any_.finals.add(at := after)
        return self.intersect(any_.determinize())

    def prefixes(self) -> Automaton:
        """All prefixes of accepted strings."""
        return self if self.is_empty else minimize([list(a) for a in self.arcs], set(range(len(self.arcs))))

    def prefixes_without_end(self) -> Automaton:
        """The same arcs, nothing accepted: a plan that only forces a path."""
        return Automaton(self.arcs, frozenset())

    def sinks(self) -> Automaton:
        """Strings that end where nothing can follow."""
        if self.is_cyclic:
            raise Infinite("a cyclic automaton has no last states of its own")
        return minimize([list(a) for a in self.arcs], {s for s, a in enumerate(self.arcs) if not a and (s in self.finals)})

    def suffixes_after(self, prefix: Automaton) -> Automaton:
        """Strings s for which some p of ``prefix`` makes p + s accepted."""
        out, seen, queue = self.nfa(), {(0, 0)}, deque([(0, 0)])
        start = out.state()
        while queue:
            a, b = queue.popleft()
            if b in prefix.finals:
                out.skip(start, out.offset + a)
            for lo, hi, d in self.arcs[a]:
                for plo, phi, pd in prefix.arcs[b]:
                    if max(lo, plo) <= min(hi, phi) and (d, pd) not in seen:
                        seen.add((d, pd))
                        queue.append((d, pd))
        out.start = start
        return out.determinize()

    def relabel(self, mapping: dict[int, int | Sequence[int]]) -> Automaton:
        """Labels replaced; a sequence turns an arc into a chain."""
        out = Nfa()
        base = [out.state() for _ in self.arcs]
        out.skip(out.start, base[0])
        for s, a in enumerate(self.arcs):
            for lo, hi, dst in a:
                for x in range(lo, hi + 1):
                    to = mapping.get(x, x)
                    chain = [to] if isinstance(to, int) else list(to)
                    at = base[s]
                    for label in chain[:-1]:
                        out.arc(at, label, label, after := out.state())
                        at = after
                    if chain:
                        out.arc(at, chain[-1], chain[-1], base[dst])
                    else:
                        out.skip(at, base[dst])
        out.finals |= {base[s] for s in self.finals}
        return out.determinize()

    # --- tables -------------------------------------------------------------------------------

    def edges(self, spark: SparkSession) -> DataFrame:
        rows = [(s, lo, hi, dst) for s, a in enumerate(self.arcs) for lo, hi, dst in a]
        return spark.createDataFrame(rows, "src int, lo int, hi int, dst int")

    def states(self, spark: SparkSession) -> DataFrame:
        rows = [(s, s == 0, s in self.finals) for s in range(len(self.arcs))]
        return spark.createDataFrame(rows, "state int, is_start boolean, is_final boolean")


class Nfa:
    """Automaton under construction: ranges, free moves, any number of finals."""

    def __init__(self):
        self.moves: list[list[Arc]] = []
        self.free: list[list[int]] = []
        self.finals: set[int] = set()
        self.offset = 0
        self.start = self.state()

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def arc(self, src: int, lo: int, hi: int, dst: int) -> None:
        self.moves[src].append((lo, hi, dst))

    def skip(self, src: int, dst: int) -> None:
        self.free[src].append(dst)

    def add(self, at: int, a: Automaton, ends: set[int]) -> None:
        """A copy of ``a`` after ``at``; its finals go to ``ends``."""
        self.offset = base = len(self.moves)
        for arcs in a.arcs:
            s = self.state()
            self.moves[s] = [(lo, hi, base + d) for lo, hi, d in arcs]
        self.skip(at, base)
        ends |= {base + f for f in a.finals}

    def add_joined(self, at: int, a: Automaton) -> int:
        ends: set[int] = set()
        self.add(at, a, ends)
        out = self.state()
        for e in ends:
            self.skip(e, out)
        return out

    def add_tree(self, at: int, node: Node) -> int:
        """States for the tree after ``at``; returns where it ends."""
        match node:
            case Empty():
                return at
            case Chars(ranges=ranges):
                out = self.state()
                for lo, hi in ranges:
                    self.arc(at, lo, hi, out)
                return out
            case Concat(parts=parts):
                for p in parts:
                    at = self.add_tree(at, p)
                return at
            case Alternatives(parts=parts):
                out = self.state()
                for p in parts:
                    own = self.state()
                    self.skip(at, own)
                    self.skip(self.add_tree(own, p), out)
                return out
            case Repeat(inner=inner, least=least, most=most):
                out = self.state()
                for i in range(least if most is None else most):
                    if i >= least:
                        self.skip(at, out)
                    own = self.state()
                    self.skip(at, own)
                    at = self.add_tree(own, inner)
                if most is None:
                    loop = self.state()
                    self.skip(at, loop)
                    own = self.state()
                    self.skip(loop, own)
                    self.skip(self.add_tree(own, inner), loop)
                    at = loop
                self.skip(at, out)
                return out
        raise TypeError(node)

    def closure(self, states: Iterable[int]) -> frozenset[int]:
        seen, stack = set(states), list(states)
        while stack:
            for s in self.free[stack.pop()]:
                if s not in seen:
                    seen.add(s)
                    stack.append(s)
        return frozenset(seen)

    def determinize(self) -> Automaton:
        first = self.closure([self.start])
        index, queue, arcs, finals = {first: 0}, deque([first]), [], set()
        while queue:
            group = queue.popleft()
            if group & self.finals:
                finals.add(index[group])
            moves = [m for s in group for m in self.moves[s]]
            cuts = sorted({x for lo, hi, _ in moves for x in (lo, hi + 1)})
            opens, closes = defaultdict(list), defaultdict(list)
            for lo, hi, d in moves:
                opens[lo].append(d)
                closes[hi + 1].append(d)
            live: dict[int, int] = defaultdict(int)
            here: list[Arc] = []
            for lo, stop in zip(cuts[:-1], cuts[1:], strict=True):
                for d in closes[lo]:
                    live[d] -= 1
                    if not live[d]:
                        del live[d]
                for d in opens[lo]:
                    live[d] += 1
                if not live:
                    continue
                to = self.closure(live)
                if to not in index:
                    index[to] = len(index)
                    queue.append(to)
                here.append((lo, stop - 1, index[to]))
            arcs.append(here)
        return minimize(arcs, finals)


def minimize(arcs: list[list[Arc]], finals: set[int]) -> Automaton:
    """The minimal trimmed automaton, states numbered breadth first by label."""
    back: list[set[int]] = [set() for _ in arcs]
    for s, a in enumerate(arcs):
        for _, _, d in a:
            back[d].add(s)
    useful, stack = set(finals), list(finals)
    while stack:
        for s in back[stack.pop()]:
            if s not in useful:
                useful.add(s)
                stack.append(s)
    if 0 not in useful:
        return Automaton.nothing()
    block = [int(s in finals) if s in useful else -1 for s in range(len(arcs))]
    count = len(set(block))
    while True:
        # A state's signature: its block and its arcs into blocks, neighbouring ranges joined.
        names: dict[tuple, int] = {}
        after = [-1] * len(arcs)
        for s in useful:
            joined: list[list[int]] = []
            for lo, hi, d in sorted(arcs[s]):
                if block[d] < 0:
                    continue
                if joined and joined[-1][1] + 1 == lo and joined[-1][2] == block[d]:
                    joined[-1][1] = hi
                else:
                    joined.append([lo, hi, block[d]])
            after[s] = names.setdefault((block[s], tuple(map(tuple, joined))), len(names))
        block = after
        if len(set(block)) == count:
            break
        count = len(set(block))
    parts = {i: sig[1] for sig, i in names.items()}
    # The last signatures name blocks of the round before, which has the same partition.
    of: dict[int, int] = {}
    for s in useful:
        of[block[s]] = s
    number, queue, out, ends = {block[0]: 0}, deque([block[0]]), [], set()
    while queue:
        b = queue.popleft()
        if of[b] in finals:
            ends.add(number[b])
        joined = []
        for lo, hi, d in sorted(arcs[of[b]]):
            if block[d] < 0:
                continue
            if block[d] not in number:
                number[block[d]] = len(number)
                queue.append(block[d])
            if joined and joined[-1][1] + 1 == lo and joined[-1][2] == number[block[d]]:
                joined[-1] = (joined[-1][0], hi, joined[-1][2])
            else:
                joined.append((lo, hi, number[block[d]]))
        out.append(tuple(joined))
    assert len(parts) == len(number)
    return Automaton(tuple(out), frozenset(ends))
