"""SQL table and scalar functions: ``register`` makes them known to a session."""

from __future__ import annotations

import difflib
import json

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from glyphwalk.operators.vocabulary import Vocabulary
from glyphwalk.plans.automaton import Automaton
from glyphwalk.plans.edits import Edits
from glyphwalk.plans.pattern import explain, literal, parse


@F.udtf(returnType="text string")
class RegexExpand:
    """regex_expand(pattern, max_len, limit): the strings of a pattern, shortest first."""

    def eval(self, pattern: str, max_len: int, limit: int):
        for text in Automaton.of_pattern(pattern).texts(limit, max_len):
            yield (text,)


@F.udtf(returnType="text string")
class EditExpand:
    """edit_expand(pattern, edits, alphabet): strings within so many edits of a pattern."""

    def eval(self, pattern: str, edits: int, alphabet: str):
        for text in Edits(edits, frozenset(alphabet)).apply(Automaton.of_pattern(pattern)).texts():
            yield (text,)


@F.udtf(returnType="tokens array<int>")
class Tokenizations:
    """tokenizations(text, vocabulary as JSON {piece: id}): every way to write a text in pieces."""

    def eval(self, text: str, vocabulary: str):
        if text is not None:
            for tokens in Vocabulary(json.loads(vocabulary)).encodings(text):
                yield (list(tokens),)


@F.udtf(returnType="idx int, edit string")
class EditScript:
    """edit_script(a, b): where an edit script from a to b changes characters."""

    def eval(self, a: str, b: str):
        for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a or "", b or "", False).get_opcodes():
            if tag != "equal":
                for k in range(max(i2 - i1, j2 - j1)):
                    yield (i1 + k, tag)


def regex_matches(text: pd.Series, pattern: pd.Series) -> pd.Series:
    """Whole-string match where the pattern is a column; for one pattern ``analytics.matches`` stays in the JVM."""
    compiled = {p: Automaton.of_pattern(p) for p in pattern.dropna().unique()}
    return pd.Series([None if t is None or p is None else compiled[p].accepts(t) for t, p in zip(text, pattern, strict=True)], dtype="object")


def regex_cardinality(pattern: pd.Series) -> pd.Series:
    """Number of strings of a pattern; null if infinite."""
    return pattern.map(lambda p: None if p is None else Automaton.of_pattern(p).cardinality()).astype("Int64")


def regex_explain(pattern: pd.Series) -> pd.Series:
    return pattern.map(lambda p: None if p is None else explain(parse(p)))


def regex_literal(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else literal(t))


def register(spark: SparkSession) -> None:
    """Makes all functions known to SQL."""
    for name, table in (("regex_expand", RegexExpand), ("edit_expand", EditExpand), ("tokenizations", Tokenizations), ("edit_script", EditScript)):
        spark.udtf.register(name, table)
    for name, function, kind in (("regex_matches", regex_matches, "boolean"), ("regex_cardinality", regex_cardinality, "long"), ("regex_explain", regex_explain, "string"), ("regex_literal", regex_literal, "string")):
        spark.udf.register(name, F.pandas_udf(function, kind))
