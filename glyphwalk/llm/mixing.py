"""Mixing of sources to target weights.

Documents get a hash-random key; within each source they are laid out in key order and a
distributed prefix sum of their token counts tells where the source's exact budget ends. A source
whose target exceeds its size is repeated in whole epochs, at most ``cap`` of them.

Only DataFrame operations run here. A hot source is split into 4,096 key ranges, so no task
holds a source. Allocation iterates over the table of sources with three scalars per round.

Keys are hashes of id and text, so rows that share an id (or have none) are spread too; only rows equal
in both stay together. Null ids and texts are ordinary values (text null: size 0), the null source is a source of its
own and comes last, repeated rows are mixed as rows of their own, an empty table gives an empty
result. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphwalk.plans.cut import cut
from glyphwalk.plans.prefix import prefix_sum

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def allocate(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(source, source_size) -> adds target: the total is shared by weight, capped at ``cap`` sizes.

    Weights go round the sources by code point, null last. Each round shares what the capped
    sources leave; the set of capped sources only grows, so the rounds end.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.array(*[F.lit(w) for w in weights])
    ranked = cut(
        sources.select("source", "source_size", (F.row_number().over(order) - 1).alias("i"))
        .withColumn("w", F.element_at(weight, (F.col("i") % len(weights) + 1).cast("int")).cast("long"))
        .drop("i")
    )
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    wide = lambda c: c.cast("decimal(19,0)")  # noqa: E731  products of two longs
    over, share, free = -1, 0, 1
    while True:
        capped = wide(cap * F.col("source_size")) * wide(F.lit(free)) <= wide(F.lit(share)) * wide(F.col("w")) if over >= 0 else F.lit(False)
        n, held, left = ranked.agg(
            F.count(F.when(capped, 1)),
            F.coalesce(F.sum(F.when(capped, cap * F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~capped, F.col("w"))), F.lit(0)),
        ).first()
        if n == over or not left:
            break
        over, share, free = n, total - held, left
    target = F.least(
        (cap * F.col("source_size")).cast("double"),
        F.lit(share).cast("double") * F.col("w") / F.lit(free).cast("double"),
    )
    return ranked.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    cap: int = 3,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs``, and the columns ``carry``.

    taken: words the mix takes of the row. Whole epochs of the source come first, then the rows
    up to the budget in key order; the row at the cut gives the words that are still missing, so a
    source gives exactly the whole part of its target.
    """
    key = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))))
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("__source"),
            *[F.col(c).alias(f"__carry_{c}") for c in carry],
            word_count(F.col(text_col)).alias("size"),
            key.alias("key"),
        ).withColumn("bucket", F.substring("key", 1, 3))
    )
    sources = rows.groupBy(F.col("__source").alias("source")).agg(F.sum("size").alias("source_size"))
    plan = allocate(sources, weights, cap).select(
        F.col("source").alias("s"), "source_size", "target", F.floor("target").cast("long").alias("budget")
    )
    order = [F.col("key"), F.col("doc_id"), F.col("size")]
    placed = prefix_sum(rows, ["__source"], "bucket", order, "size", "before")
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    rest = F.col("budget") - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return placed.join(plan, F.col("__source").eqNullSafe(F.col("s"))).select(
        "doc_id", *[F.col(f"__carry_{c}").alias(c) for c in carry], "size", "source_size", "target", taken.cast("long").alias("taken")
    )
