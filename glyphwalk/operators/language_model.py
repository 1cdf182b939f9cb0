"""Next-token models as tables: learn from text, temper, truncate, and score sequences.

A model is a table (context, token, p, rank): ``context`` holds the last ``order`` tokens, rank is
ordinal from 1 by (p descending, token). Impossible tokens have no row. Every operation is a join
or a window on the context, so a model of any size stays distributed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphwalk.operators.vocabulary import Vocabulary, characters_of
from glyphwalk.plans.cut import cut

BOS, EOS = -1, 0x110000


def ngram_counts(sequences: DataFrame, tokens: str = "tokens", order: int = 1, bos: int = BOS, eos: int | None = None) -> DataFrame:
    """(context, token, n) over all sequences, each led by ``order`` start marks (and ended by a mark)."""
    lead = F.array_repeat(F.lit(bos), order)
    whole = F.concat(lead, F.col(tokens), *([F.array(F.lit(eos))] if eos is not None else []))
    at = F.when(F.size("t") > order, F.sequence(F.lit(1), F.size("t") - order)).otherwise(F.array().cast("array<int>"))
    parts = [F.element_at("t", (F.col("i") + j).cast("int")).alias(f"c{j}") for j in range(order + 1)]
    if order == 1:  # a zip needs no lookup by position
        pairs = F.zip_with(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))), F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("c0"), b.alias("c1")))
        spread = sequences.where(F.col(tokens).isNotNull()).select(whole.alias("t")).select(F.inline(pairs))
    else:
        spread = sequences.where(F.col(tokens).isNotNull()).select(whole.alias("t")).select("t", F.explode(at).alias("i")).select(*parts)
    columns = [f"c{j}" for j in range(order + 1)]
    counted = spread.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.array(*columns[:-1]).cast("array<int>").alias("context"), F.col(columns[-1]).alias("token"), "n")


def character_pairs(docs: DataFrame, text: str, bos: int = BOS, eos: int | None = None) -> DataFrame:
    """``ngram_counts`` of order 1 over code points, by way of the distinct words.

    Texts are cut at spaces; a word between spaces has the pairs of ' word ', and the first and last
    ones meet the marks instead. Words repeat far more than they vary, so most of the work is the
    aggregate over words, with map-side combine.
    """
    cut_ = docs.where(F.col(text).isNotNull()).select(F.split(text, " ").alias("w"))
    spread = cut_.select(F.size("w").alias("n"), F.posexplode("w").alias("i", "word"))
    words = spread.groupBy("word", (F.col("i") == 0).alias("first"), (F.col("i") == F.col("n") - 1).alias("last")).agg(F.count(F.lit(1)).alias("m"))
    codes = F.transform(characters_of(F.col("word")), lambda c: F.ascii(c))
    end = F.array(F.lit(eos)) if eos is not None else F.array().cast("array<int>")
    t = F.concat(F.array(F.when(F.col("first"), F.lit(bos)).otherwise(F.lit(32))), codes, F.when(F.col("last"), end).otherwise(F.array(F.lit(32))))
    size = F.greatest(F.size("t") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("t", 1, size), F.slice("t", 2, size), lambda a, b: F.struct(a.alias("c"), b.alias("token")))
    counted = words.select(t.alias("t"), "m").select(F.explode(pairs).alias("p"), "m").groupBy("p.c", "p.token").agg(F.sum("m").alias("n"))
    return counted.select(F.array("c").alias("context"), "token", "n")


def _ranked(rows: DataFrame) -> DataFrame:
    by = Window.partitionBy("context").orderBy(F.col("p").desc(), "token")
    return rows.select("context", "token", "p", F.row_number().over(by).alias("rank"))


def _total(column: str) -> Column:
    return F.sum(column).over(Window.partitionBy("context"))


@dataclass(frozen=True)
class LanguageModel:
    """rows (context, token, p, rank) and how contexts are made."""

    rows: DataFrame
    order: int = 1
    bos: int = BOS
    eos: int | None = EOS
    vocabulary: Vocabulary | None = None

    # --- learning -----------------------------------------------------------------------------

    @staticmethod
    def from_counts(counts: DataFrame, order: int, mix: float | None = None, **args) -> LanguageModel:
        """Shares of counts; ``mix`` interpolates with the shares over all contexts, so that every token seen anywhere is possible."""
        if mix is None:
            rows = counts.select("context", "token", (F.col("n") / _total("n")).alias("p"))
        else:
            counts = cut(counts)  # read three times below
            single = counts.groupBy("token").agg(F.sum("n").alias("m"))
            total = single.agg(F.sum("m").alias("all"))
            grid = counts.select("context").distinct().join(F.broadcast(total)).join(single)
            seen = counts.select("context", "token", (F.col("n") / _total("n")).alias("own"))
            rows = grid.join(seen, ["context", "token"], "left").select("context", "token", (F.lit(mix) * F.coalesce("own", F.lit(0.0)) + F.lit(1 - mix) * F.col("m") / F.col("all")).alias("p"))
        return LanguageModel(_ranked(rows), order, **args)

    @staticmethod
    def of_characters(docs: DataFrame, text: str = "text", order: int = 1, eos: int | None = None, **args) -> LanguageModel:
        """Tokens are code points."""
        if order == 1:
            return LanguageModel.from_counts(character_pairs(docs, text, eos=eos), 1, eos=eos, **args)
        tokens = docs.select(F.transform(characters_of(F.col(text)), lambda c: F.ascii(c)).alias("tokens"))
        return LanguageModel.from_counts(ngram_counts(tokens, order=order, eos=eos), order, eos=eos, **args)

    @staticmethod
    def of_rows(spark: SparkSession, rows: list[tuple[list[int], int, float]], order: int = 1, **args) -> LanguageModel:
        return LanguageModel(_ranked(spark.createDataFrame(rows, "context array<int>, token int, p double").where("p > 0")), order, **args)

    @staticmethod
    def from_scorer(contexts: DataFrame, score: Callable[[list[list[int]]], np.ndarray], order: int, **args) -> LanguageModel:
        """A model held elsewhere: ``score`` maps contexts to one row of next-token probabilities each, in Arrow batches."""

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                p = np.asarray(score([list(c) for c in part["context"]]), float)
                row, token = np.nonzero(p > 0)
                yield pd.DataFrame({"context": [list(part["context"].iloc[i]) for i in row], "token": token.astype("int32"), "p": p[row, token]})

        rows = contexts.select("context").distinct().mapInPandas(run, "context array<int>, token int, p double")
        return LanguageModel(_ranked(rows), order, **args)

    # --- reshaping ----------------------------------------------------------------------------

    def temper(self, temperature: float | None) -> LanguageModel:
        """Probabilities to the power 1 / temperature, normalised; None and 0 leave them as they are."""
        if not temperature or temperature == 1:
            return self
        raised = self.rows.select("context", "token", F.pow("p", F.lit(1.0 / temperature)).alias("w"))
        return replace(self, rows=_ranked(raised.select("context", "token", (F.col("w") / _total("w")).alias("p")).where("p > 0")))

    def top_k(self, k: int) -> LanguageModel:
        kept = self.rows.where(F.col("rank") <= k)
        return replace(self, rows=kept.select("context", "token", (F.col("p") / _total("p")).alias("p"), "rank"))

    def top_p(self, share: float) -> LanguageModel:
        """The fewest tokens whose probability reaches ``share``."""
        before = Window.partitionBy("context").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
        kept = self.rows.withColumn("before", F.coalesce(F.sum("p").over(before), F.lit(0.0))).where(F.col("before") < share)
        return replace(self, rows=kept.select("context", "token", (F.col("p") / _total("p")).alias("p"), "rank"))

    def settled(self) -> LanguageModel:
        """The same model read from the shared folder: computed once, whatever uses it."""
        return replace(self, rows=cut(self.rows))

    # --- asking -------------------------------------------------------------------------------

    @property
    def start(self) -> list[int]:
        return [self.bos] * self.order

    def context_of(self, tokens: Column) -> Column:
        """The context that a sequence of tokens leaves."""
        if not self.order:
            return F.array().cast("array<int>")
        whole = F.concat(F.array(*[F.lit(t) for t in self.start]).cast("array<int>"), tokens)
        return F.slice(whole, -self.order, self.order)

    def after(self, contexts: DataFrame) -> DataFrame:
        """Next-token rows of the given contexts."""
        return self.rows.join(contexts.select("context").distinct(), "context", "left_semi")

    def token_scores(self, sequences: DataFrame, key: str = "id", tokens: str = "tokens") -> DataFrame:
        """(key, pos, token, p, rank) of every token of every sequence, p null where the model has none."""
        steps = sequences.select(F.col(key), F.col(tokens).alias("t"), F.posexplode(tokens).alias("pos", "token"))
        placed = steps.select(key, "pos", "token", self.context_of(F.slice("t", 1, F.col("pos"))).alias("context"))
        return placed.join(self.rows, ["context", "token"], "left").select(key, "pos", "token", "p", "rank")

    def sequence_scores(self, sequences: DataFrame, key: str = "id", tokens: str = "tokens", prefix_len: int = 0) -> DataFrame:
        """(key, n_tokens, log_p, perplexity) over tokens from ``prefix_len`` on; null where a token is impossible."""
        scored = self.token_scores(sequences, key, tokens).where(F.col("pos") >= prefix_len)
        found = scored.groupBy(key).agg(F.count(F.lit(1)).alias("n_tokens"), F.sum(F.ln("p")).alias("s"), F.count("p").alias("known"))
        log_p = F.when(F.col("known") == F.col("n_tokens"), F.col("s"))
        return found.select(key, "n_tokens", log_p.alias("log_p"), F.exp(-log_p / F.col("n_tokens")).alias("perplexity"))

    def can_generate(self, sequences: DataFrame, k: int | None, key: str = "id", tokens: str = "tokens", prefix_len: int = 0) -> DataFrame:
        """(key, possible): every token after the prefix is among the k likeliest."""
        scored = self.token_scores(sequences, key, tokens)
        fine = (F.col("pos") < prefix_len) | (F.col("rank").isNotNull() & (F.lit(k is None) | (F.col("rank") <= F.lit(k or 0))))
        return scored.groupBy(key).agg(F.bool_and(fine).alias("possible"))

    def next_perplexities(self, contexts: DataFrame) -> DataFrame:
        """(context, token, perplexity) of every possible next token."""
        return self.after(contexts).select("context", "token", (1 / F.col("p")).alias("perplexity"))

    def encodable(self, texts: DataFrame, encodings: DataFrame, k: int | None, text: str = "text") -> DataFrame:
        """(text, tokens): the first encoding of each text whose tokens are all among the k likeliest; null if there is none.

        encodings: (text, tokens), all of them or the canonical one only.
        """
        keyed = encodings.withColumn("id", F.struct(text, "tokens"))
        fine = self.can_generate(keyed, k).where("possible").select(F.col("id")[text].alias(text), F.col("id.tokens").alias("tokens"))
        first = fine.groupBy(text).agg(F.min(F.struct(F.size("tokens").alias("n"), "tokens")).alias("m")).select(text, "m.tokens")
        return texts.select(text).distinct().join(first, text, "left")

    def sample(self, spark: SparkSession, n: int, max_len: int, seed: int = 0, prefix: list[int] = (), repetition_penalty: float = 1.0) -> DataFrame:
        """(walker, tokens): n sequences drawn token by token, until the end mark or ``max_len``.

        repetition_penalty: tokens that a sequence already holds have their log probability multiplied by it.
        """
        walkers = spark.range(n).select(F.col("id").alias("walker"), F.array(*[F.lit(t) for t in prefix]).cast("array<int>").alias("tokens"))
        done = []
        for depth in range(len(prefix), max_len):
            here = walkers.withColumn("context", self.context_of(F.col("tokens"))).join(self.rows, "context", "left")
            if repetition_penalty != 1:
                here = here.withColumn("p", F.when(F.array_contains("tokens", F.col("token")), F.pow("p", F.lit(repetition_penalty))).otherwise(F.col("p")))
            picked = pick(here, ["walker"], "token", "p", uniform(seed, F.col("walker"), depth))
            walkers = cut(picked.select("walker", F.when(F.col("token").isNull(), F.col("tokens")).otherwise(F.array_append("tokens", F.col("token"))).alias("tokens"), F.col("token").isNull().alias("stuck")))
            over = F.col("stuck") | (F.element_at("tokens", -1) == F.lit(self.eos if self.eos is not None else -(2**31)))
            done.append(walkers.where(over).select("walker", "tokens"))
            walkers = walkers.where(~over).select("walker", "tokens")
        return reduce(DataFrame.unionByName, [*done, walkers])


def uniform(seed: int, walker: Column, depth: int) -> Column:
    """A number in [0, 1) from a hash of seed, walker and depth: the same in every run and engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), walker.cast("string"), F.lit(f":{depth}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def pick(rows: DataFrame, key: list[str], token: str, weight: str, u: Column) -> DataFrame:
    """One row per key, drawn by weight: the first token whose running sum exceeds u times the total."""
    by = Window.partitionBy(*key)
    running = F.sum(weight).over(by.orderBy(token).rowsBetween(Window.unboundedPreceding, 0))
    drawn = rows.withColumn("__run", running).withColumn("__total", F.sum(weight).over(by)).withColumn("__u", u)
    kept = drawn.where((F.col("__run") > F.col("__u") * F.col("__total")) | F.col("__total").isNull())
    return kept.withColumn("__k", F.row_number().over(by.orderBy(token))).where("__k = 1").drop("__run", "__total", "__u", "__k")
