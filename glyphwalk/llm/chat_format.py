"""Chat formatting: logged conversations that prefix longer ones are collapsed, the rest rendered.

Every turn gets a rolling hash of the turns up to it: two 64-bit lanes of position-salted turn
hashes, summed along the conversation. The hash of a whole conversation equals a hash inside
another one exactly if it is a prefix of it (128 bits of hash and the length must agree).
Conversations for which a better holder exists - a longer one, or an equal one with a smaller id -
are removed by an anti-join, and only then the others are rendered.

Only DataFrame operations run here. A conversation is never gathered: positions and hashes are
two-level prefix sums over ranges of ``PART`` turn numbers, and rendering gives one row per
``PART`` turns. A very common first turn is one key of an aggregate with map-side combine.

Turns are ordered by number (null last), role and text; repeated rows of a conversation count
once. Null roles and texts differ from empty ones and render as empty. Null ids form one
conversation. "<|" in a role or text is rendered as "< |", so that no text can write the template's
marks. Texts of any length are rendered whole. An empty table gives an empty result; other columns are
not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphwalk.plans.cut import cut
from glyphwalk.plans.prefix import prefix_sum

PART = 256
TEMPLATE = ("<|im_start|>", "\n", "<|im_end|>\n")


def _lane(seed: str, *cols: Column) -> Column:
    parts = [x for c in cols for x in (c.isNull(), F.coalesce(c.cast("string"), F.lit("")))]
    return F.xxhash64(F.lit(seed), *parts).cast("decimal(20,0)")


def turn_prefixes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, role, text, n, h1, h2): each turn with its position from 0, its conversation's length and the hash of the turns up to it."""
    rows = turns.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")
    ).distinct()
    rows = rows.withColumn("range", F.coalesce(F.floor(F.col("turn") / PART), F.lit(2**62)))
    order = [F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    placed = cut(prefix_sum(rows.withColumn("one", F.lit(1)), ["conv"], "range", order, "one", "pos").drop("one"))
    hashed = placed.select(
        "conv", "pos", "role", "text",
        F.floor(F.col("pos") / PART).alias("part"),
        _lane("a", F.col("pos"), F.col("role"), F.col("text")).alias("a"),
        _lane("b", F.col("pos"), F.col("role"), F.col("text")).alias("b"),
    )
    summed = prefix_sum(prefix_sum(hashed, ["conv"], "part", [F.col("pos")], "a", "h1"), ["conv"], "part", [F.col("pos")], "b", "h2")
    length = placed.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("conv", "__c")
    return summed.join(length, F.col("conv").eqNullSafe(F.col("__c"))).select(
        "conv", "pos", "part", "role", "text", "n",
        (F.col("h1") + F.col("a")).alias("h1"), (F.col("h2") + F.col("b")).alias("h2"),
    )


def collapse(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template=TEMPLATE) -> DataFrame:
    """One row per ``PART`` turns of every maximal conversation, and one per collapsed conversation.

    conv_id, part, n_turns, kept, kept_id (the longest conversation that this one prefixes, smallest
    id first; itself if kept) and rendered (null if collapsed).
    """
    prefixes = cut(turn_prefixes(turns, conv, turn, role, text))
    keys = ["len", "h1", "h2"]
    each = prefixes.select("conv", "n", (F.col("pos") + 1).alias("len"), "h1", "h2")
    best = each.groupBy(*keys).agg(F.min(F.struct(-F.col("n"), F.col("conv").alias("conv"))).alias("best"))
    whole = each.where("len = n")
    held = cut(whole.join(best, keys).select("conv", "n", F.col("best.conv").alias("kept_id")))
    collapsed = held.where(~F.col("conv").eqNullSafe(F.col("kept_id")))
    gone = collapsed.select(F.col("conv").alias("__gone"))
    kept = prefixes.join(gone, F.col("conv").eqNullSafe(F.col("__gone")), "left_anti")
    opening, middle, closing = (F.lit(x) for x in template)
    plain = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))
    piece = F.concat(opening, plain(F.col("role")), middle, plain(F.col("text")), closing)
    rendered = kept.groupBy("conv", "part", "n").agg(F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece")))).alias("turns"))
    return rendered.select(
        F.col("conv").alias("conv_id"), "part", F.col("n").alias("n_turns"), F.lit(True).alias("kept"), F.col("conv").alias("kept_id"),
        F.concat_ws("", F.transform("turns", lambda t: t["piece"])).alias("rendered"),
    ).unionByName(
        collapsed.select(
            F.col("conv").alias("conv_id"), F.lit(0).cast("long").alias("part"), F.col("n").alias("n_turns"), F.lit(False).alias("kept"),
            "kept_id", F.lit(None).cast("string").alias("rendered"),
        )
    )
