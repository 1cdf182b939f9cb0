"""What a pattern query asks for, and its lowering to one plain record of options."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, fields
from enum import Enum

from glyphwalk.plans.automaton import Automaton
from glyphwalk.plans.edits import Edits
from glyphwalk.plans.pattern import literal

__all__ = ["Order", "PatternQuery", "Preprocessing", "SearchOptions", "Text", "Tokens", "literal"]


class Order(Enum):
    """In which order, or how, answers are drawn."""

    LIKELIEST = "likeliest"
    RANDOM = "random"
    GREEDY = "greedy"
    BEAM = "beam"
    ENUMERATE = "enumerate"


class Tokens(Enum):
    """Which token sequences of a string belong to the language."""

    ALL = "all"
    CANONICAL = "canonical"
    PREFIX_CANONICAL = "prefix_canonical"
    CHARACTERS = "characters"


@dataclass(frozen=True, slots=True)
class Text:
    """The pattern, the pattern of a prefix that is taken as given, and whether answers must end the text."""

    pattern: str
    prefix: str | None = None
    end: bool = False


@dataclass(frozen=True, slots=True)
class Preprocessing:
    """Edits applied to pattern and prefix in order, and a pattern that answers must not match."""

    edits: tuple[Edits, ...] = ()
    exclude: str | None = None


@dataclass(slots=True)
class SearchOptions:
    """The lowered query. Unknown options can't be set."""

    pattern: str | None = None
    prefix: str | None = None
    limit: int | None = 1
    top_k: int | None = None
    temperature: float | None = None
    max_len: int | None = None
    order: Order = Order.ENUMERATE
    aggregation: str = "sum"  # or "max": the worst step counts
    beam: int | None = None
    tokens: Tokens = Tokens.ALL
    dynamic_canonical: bool = False
    end: bool = False
    penalize_prefix: bool = False
    stay_in_prefix: bool = False
    unbiased_prefix: bool = True
    edits: tuple[Edits, ...] = ()
    exclude: str | None = None
    seed: int = 0
    automaton: Automaton | None = None
    prefix_automaton: Automaton | None = None
    unicode: bool = True
    #: How often a random walk that gets stuck starts again; fewer than ``limit`` answers come back if all of them do.
    attempts: int = 20

    def __post_init__(self):
        if self.pattern is None and self.automaton is None:
            raise ValueError("a query needs a pattern or an automaton")
        if self.aggregation not in ("sum", "max"):
            raise ValueError(f"aggregation {self.aggregation!r}")
        for name in ("limit", "top_k", "max_len", "beam"):
            if (n := getattr(self, name)) is not None and n < 0:
                raise ValueError(f"{name} is {n}")

    @property
    def directed(self) -> bool:
        """Whether the model's probabilities lead the search."""
        return self.order is not Order.ENUMERATE


@dataclass(frozen=True, slots=True)
class PatternQuery:
    """A query as users write it."""

    text: Text
    order: Order = Order.LIKELIEST
    tokens: Tokens = Tokens.ALL
    preprocessing: Preprocessing = field(default_factory=Preprocessing)
    limit: int | None = None
    top_k: int | None = None
    temperature: float | None = None
    max_len: int | None = None
    seed: int = 0

    def lower(self) -> SearchOptions:
        """Likeliest: prefixes cost what the model says. Random: answers end the text, and the prefix is drawn without bias."""
        random = self.order is Order.RANDOM
        return SearchOptions(
            pattern=self.text.pattern, prefix=self.text.prefix, end=self.text.end or random, limit=self.limit, top_k=self.top_k,
            temperature=self.temperature, max_len=self.max_len, order=self.order, tokens=self.tokens,
            penalize_prefix=not random, stay_in_prefix=self.tokens is Tokens.PREFIX_CANONICAL,
            edits=self.preprocessing.edits, exclude=self.preprocessing.exclude, seed=self.seed,
        )


def as_options(query: PatternQuery | SearchOptions) -> SearchOptions:
    if isinstance(query, SearchOptions):
        warnings.warn("SearchOptions is the low-level form; PatternQuery lowers to it", stacklevel=3)
        return query
    return query.lower()


OPTION_NAMES = tuple(f.name for f in fields(SearchOptions))
