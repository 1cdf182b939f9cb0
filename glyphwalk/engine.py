"""The public API: prepare a model, compile queries, search."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from glyphwalk.operators.language_model import LanguageModel
from glyphwalk.operators.search import Plan, compile_query, run_plans
from glyphwalk.operators.vocabulary import Vocabulary
from glyphwalk.plans.automaton import Automaton
from glyphwalk.plans.query import PatternQuery, SearchOptions

Query = PatternQuery | SearchOptions


@dataclass(frozen=True)
class Engine:
    """A model that is settled in the shared folder, ready for any number of queries."""

    model: LanguageModel
    #: Whether searches that touch few model rows run in the driver's process.
    in_process: bool = True

    def plan(self, query: Query) -> Automaton:
        """The token automaton of the query."""
        return self.compile(query).automaton

    def plan_prefix(self, query: Query) -> Automaton | None:
        return self.compile(query).prefix

    def compile(self, query: Query, query_id: str = "0") -> Plan:
        return compile_query(query, self.model.vocabulary, query_id)

    def search(self, query: Query | Mapping[str, Query]) -> DataFrame:
        """(query_id, rank, tokens, text, cost); a mapping runs many queries in one frontier."""
        queries = query if isinstance(query, Mapping) else {"0": query}
        return run_plans(self.model, [self.compile(q, i) for i, q in queries.items()], self.in_process)


def prepare(model: LanguageModel, vocabulary: Vocabulary | None = None) -> Engine:
    if vocabulary is not None:
        model = LanguageModel(model.rows, model.order, model.bos, vocabulary.eos, vocabulary)
    if model.vocabulary is None:
        raise ValueError("a model needs a vocabulary to be searched by patterns")
    return Engine(model.settled())


def search(model: LanguageModel, vocabulary: Vocabulary, query: Query | Mapping[str, Query]) -> DataFrame:
    """Prepare and search in one step."""
    return prepare(model, vocabulary).search(query)
