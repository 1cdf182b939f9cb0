"""Edit distance as an automaton: all strings within a number of edits of a language."""

from __future__ import annotations

import string
from collections.abc import Iterable
from dataclasses import dataclass

from glyphwalk.plans.automaton import Automaton, Nfa
from glyphwalk.plans.pattern import normalize

#: Letters, digits, punctuation and the space.
PRINTABLE = frozenset(string.ascii_letters + string.digits + string.punctuation + " ")


@dataclass(frozen=True)
class Edits:
    """Up to ``count`` edits over ``alphabet``.

    Characters outside the alphabet stay as they are, unless the passthrough flags let them be
    deleted or substituted. Inserted and substituted characters come from the alphabet.
    """

    count: int = 1
    alphabet: frozenset[str] = PRINTABLE
    deletes: bool = True
    inserts: bool = True
    substitutions: bool = True
    passthrough_deletes: bool = False
    passthrough_substitutions: bool = False

    def __post_init__(self):
        if not isinstance(self.count, int) or self.count < 0:
            raise ValueError(f"number of edits: {self.count!r}")
        if not all(isinstance(c, str) and len(c) == 1 for c in self.alphabet):
            raise ValueError("the alphabet is a set of characters")

    def apply(self, a: Automaton) -> Automaton:
        known = normalize((ord(c), ord(c)) for c in self.alphabet)
        out, n = Nfa(), len(a.arcs)
        at = [[out.state() for _ in range(n)] for _ in range(self.count + 1)]
        out.skip(out.start, at[0][0])
        for e in range(self.count + 1):
            for s, arcs in enumerate(a.arcs):
                if s in a.finals:
                    out.finals.add(at[e][s])
                for lo, hi, dst in arcs:
                    out.arc(at[e][s], lo, hi, at[e][dst])
                    if e == self.count:
                        continue
                    inside = any(x <= hi and lo <= y for x, y in known)
                    covered = sum(min(y, hi) - max(x, lo) + 1 for x, y in known if x <= hi and lo <= y)
                    outside = covered < hi - lo + 1
                    if self.deletes and inside or self.passthrough_deletes and outside:
                        out.skip(at[e][s], at[e + 1][dst])
                    if self.substitutions and inside or self.passthrough_substitutions and outside:
                        for x, y in known:
                            out.arc(at[e][s], x, y, at[e + 1][dst])
                if e < self.count and self.inserts:
                    for x, y in known:
                        out.arc(at[e][s], x, y, at[e + 1][s])
        return out.determinize()


def punctuation_then_space(count: int = 1, alphabet: Iterable[str] = PRINTABLE) -> list[Edits]:
    """Edits of punctuation, then of spaces (no substitution), then of everything else."""
    marks, rest = frozenset(string.punctuation), frozenset(alphabet) - frozenset(string.punctuation) - {" "}
    return [Edits(count, marks), Edits(count, frozenset(" "), substitutions=False), Edits(count, rest)]
