"""Relational analytics over search results and corpora."""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphwalk.plans.cut import cut
from glyphwalk.plans.pattern import java_full_match, literal, parse, to_java

# --- shares, dense tables, tests -----------------------------------------------------------------


#: Bound of key tables that are multiplied with others.
CATEGORIES = 10_000


def shares(df: DataFrame, by: list[str], within: list[str] = (), share: str = "share") -> DataFrame:
    """Counts per ``by`` and their share of the rows of ``within`` (of all rows if empty)."""
    counted = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn(share, F.col("n") / F.sum("n").over(Window.partitionBy(*within)))


def densify(df: DataFrame, left: list[str], right: list[str], fill: dict[str, float]) -> DataFrame:
    """All combinations of the keys that occur; missing ones get ``fill``. The right keys are categories: more than ``CATEGORIES`` of them are refused."""
    keys = df.select(*right).distinct()
    if keys.limit(CATEGORIES + 1).count() > CATEGORIES:
        raise ValueError(f"{right} have more than {CATEGORIES} values")
    grid = df.select(*left).distinct().join(F.broadcast(keys))
    return grid.join(df, [*left, *right], "left").fillna(fill)


def chi_square(observed: DataFrame, expected: DataFrame, key: list[str], count: str = "n") -> DataFrame:
    """(statistic, df, p_value): goodness of fit; categories that one side lacks count as 0, and need an expectation above 0."""
    o, e = observed.select(*key, F.col(count).alias("o")), expected.select(*key, F.col(count).alias("e"))
    both = o.join(e, key, "full").fillna(0, ["o", "e"]).where("e > 0")
    found = both.agg(F.sum(F.pow(F.col("o") - F.col("e"), F.lit(2)) / F.col("e")).alias("statistic"), (F.count(F.lit(1)) - 1).alias("df"))
    return found.withColumn("p_value", F.pandas_udf(_tail, "double")("statistic", "df"))


def gamma_tail(a: float, x: float) -> float:
    """Regularized upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    lead = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:  # series of the lower function
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - lead * total)
    # Continued fraction, by Lentz's method.
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        b += 2
        d = 1 / (b - i * (i - a) * d)
        c = b - i * (i - a) / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return lead * h


def _tail(statistic: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(s) or n < 1 else gamma_tail(n / 2, s / 2) for s, n in zip(statistic, df, strict=True)], dtype="float64")


# --- order-aware operations ----------------------------------------------------------------------


def keep_first(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    by = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(by)).where("__k = 1").drop("__k")


def ordered_distinct(df: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values with where each came first, to be ordered by length and position."""
    return df.groupBy(value).agg(F.min(position).alias(position)).withColumn("length", F.length(value))


def running(df: DataFrame, value: Column, order: list, by: list[str] = (), out: str = "running") -> DataFrame:
    frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value).over(frame))


def position(df: DataFrame, order: list, by: list[str], out: str = "position") -> DataFrame:
    """0, 1, 2 ... within each group."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def in_batches(df: DataFrame, size: int, order: list, by: list[str], out: str = "batch") -> DataFrame:
    """Groups of ``size`` rows in order."""
    return position(df, order, by, "__p").withColumn(out, F.floor(F.col("__p") / size)).drop("__p")


def most_common(df: DataFrame, value: str, n: int, order: str | None = None) -> DataFrame:
    """The n most frequent values; ties by first appearance (or by value)."""
    counted = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"), *([F.min(order).alias("first")] if order else []))
    return counted.orderBy(F.col("n").desc(), "first" if order else value).limit(n).select(value, "n")


def throughput(df: DataFrame, amount: str, time: str, by: list[str]) -> DataFrame:
    """Largest amount over largest time of each group; null if no time passed."""
    return df.groupBy(*by).agg(F.try_divide(F.max(amount).cast("double"), F.max(time).cast("double")).alias("rate"))


def accuracy(df: DataFrame, truth: str, guess: str, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(truth) == F.col(guess)).cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def widen(log: DataFrame, first_key: str, order: str, key: str = "key", value: str = "value") -> DataFrame:
    """A log of (key, value) lines as one row per record; a record starts at each ``first_key``.

    Keys are found first (a small set), then pivoted. Lines are laid out in ranges of their order;
    the records of the ranges before are added to the running number in each, so no task holds the log.
    """
    starts = F.coalesce((F.col(key) == first_key).cast("long"), F.lit(0))
    laid = cut(log.repartitionByRange(order).withColumn("__part", F.spark_partition_id()).withColumn("__starts", starts))
    parts = laid.groupBy("__part").agg(F.sum("__starts").alias("__n"))
    parts = parts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = laid.withColumn("__own", F.sum("__starts").over(inside)).join(F.broadcast(parts), "__part")  # a row per range
    numbered = numbered.withColumn("record", F.col("__own") + F.col("__before")).drop("__part", "__starts", "__own", "__before")
    return numbered.where("record > 0").groupBy("record").pivot(key).agg(F.first(value))


def weighted_sample(df: DataFrame, weight: str, n: int, seed: int, key: str) -> DataFrame:
    """n rows without replacement, by weight: the smallest of -ln(u) / weight."""
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") + 1) / F.lit(2.0**32 + 1)
    return df.where(F.col(weight) > 0).withColumn("sample_key", -F.ln(u) / F.col(weight)).orderBy("sample_key", key).limit(n)


# --- text ----------------------------------------------------------------------------------------

#: The replacements of the last-word corpus, made in this order.
REPLACEMENTS = [
    ("“", '"'),
    ("”", '"'),
    ("''", '"'),
    ("``", '"'),
    ("’", "'"),
    ("‘", "'"),
    ("–", "-"),
    (" ,", ","),
    (" .", "."),
    ("é", "e"),
    ("—", "-"),
    ("\xa0", " "),
    ("\u200a", ""),
    ("…", "..."),
    ("ñ", "n"),
]
SPACES = " \t\n\r\f\v"
PUNCTUATION = r"[!-/:-@\[-`{-~]"


def normalized(text: Column) -> Column:
    """Plain punctuation, trimmed, led by a line feed."""
    for old, new in REPLACEMENTS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.concat(F.lit("\n"), F.btrim(text, F.lit(SPACES)))


def last_word(text: Column) -> Column:
    return F.element_at(F.split(F.btrim(text, F.lit(SPACES)), " "), -1)


def without_last_word(text: Column) -> Column:
    words = F.split(F.btrim(text, F.lit(SPACES)), " ")
    return F.array_join(F.slice(words, 1, F.size(words) - 1), " ")


def bare(word: Column) -> Column:
    return F.regexp_replace(word, PUNCTUATION, "")


def sentences(text: Column) -> Column:
    """Parts that end with a full stop, question or exclamation mark and white space."""
    return F.filter(F.split(text, r"(?<=[.!?])[ \n]+"), lambda s: s != "")


def matches(text: Column, pattern: str, unicode: bool = True) -> Column:
    """Whether the whole text is in the pattern's language."""
    return text.rlike(java_full_match(pattern, unicode))


def contains(text: Column, pattern: str, unicode: bool = True) -> Column:
    return text.rlike(to_java(parse(pattern, unicode)))


def match_start(text: Column, pattern: str, unicode: bool = True) -> Column:
    """Position from 1 of the first match; 0 if there is none."""
    return F.regexp_instr(text, F.lit(to_java(parse(pattern, unicode))))


def prompt_before(text: Column, pattern: str) -> Column:
    at = match_start(text, pattern)
    return F.when(at > 0, F.rtrim(F.substring(text, F.lit(1), at - 1)))


def words_in(text: Column) -> Column:
    """Distinct words of a text: runs of letters, digits and underscores."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)[\w]+"), F.lit(0)))


def stop_word_pattern(prefix: str, words: list[str]) -> str:
    """Pattern of answers that end in a stop word, to be excluded from a last-word query."""
    return f"{literal(prefix)} ({'|'.join(map(literal, words))})((\\.)|(!)|(\\?))?(\")?"


def end_of_prefix(pieces: Column, prefix: Column) -> Column:
    """Index from 0 of the first token after the prefix: pieces before it spell the prefix."""
    ends = F.transform(F.sequence(F.lit(0), F.size(pieces)), lambda i: F.length(F.array_join(F.slice(pieces, 1, i), "")))
    return F.array_position(F.transform(ends, lambda n: n >= F.length(prefix)), True) - 1


def named_length(name: Column) -> Column:
    """Labels of baselines: a number n becomes 'baseline (n=..)', other names stay."""
    n = name.try_cast("int")
    return F.when(n.isNotNull(), F.concat(F.lit("baseline (n="), n.cast("string"), F.lit(")"))).otherwise(name)


def only_in(a: Column, b: Column) -> Column:
    """Sorted characters of a that b lacks."""
    chars = lambda s: F.array_distinct(F.filter(F.split(s, ""), lambda c: c != ""))
    return F.array_sort(F.array_except(chars(a), chars(b)))


def clean_url(url: Column, end_mark: str = "<|endoftext|>") -> Column:
    """Up to the first line feed, without the end mark."""
    return F.replace(F.split_part(url, F.lit("\n"), F.lit(1)), F.lit(end_mark), F.lit(""))


def best_match(texts: DataFrame, templates: DataFrame, text: str = "text") -> DataFrame:
    """The nearest template of each text by edit distance; the first template wins ties. Templates: (template_id, template), at most ``CATEGORIES``."""
    if templates.limit(CATEGORIES + 1).count() > CATEGORIES:
        raise ValueError(f"more than {CATEGORIES} templates")
    pairs = texts.join(F.broadcast(templates))
    distance = F.levenshtein(F.col(text), F.col("template"))
    near = pairs.groupBy(text).agg(F.min(F.struct(distance.alias("distance"), "template_id", "template")).alias("m"))
    return near.select(text, "m.template_id", "m.template", "m.distance")


def edit_positions(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b, idx, edit): where an edit script from a to b changes characters."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for x, y in zip(part[a], part[b], strict=True):
                for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, x or "", y or "", False).get_opcodes():
                    rows += [(x, y, i1 + k, tag) for k in range(max(i2 - i1, j2 - j1)) if tag != "equal"]
            yield pd.DataFrame(rows, columns=["a", "b", "idx", "edit"])

    return pairs.select(a, b).mapInPandas(run, "a string, b string, idx int, edit string")
