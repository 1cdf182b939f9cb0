"""Prefix sums over groups of any size, in two levels.

One window per group would put a hot group in one task. Here each group is cut into buckets by
a leading part of its order key: bucket totals are summed by a window over at most ``buckets``
rows per group, and rows are summed by a window inside their bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix_sum(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the group before this one.

    ``bucket`` must be a function of the order key that never decreases along ``order`` and is never
    null. The
    input is planned twice, so cut it before if it is costly.
    """
    # One key that is never null: the join below then keeps the partitioning of the windows.
    parts = [x for c in group for x in (F.col(c).isNull().cast("string"), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    keyed = df.withColumn("__g", F.concat_ws("\x1f", *parts)).withColumn("__b", F.col(bucket))
    before = Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        keyed.groupBy("__g", "__b").agg(F.sum(value).alias("__t"))
        .select("__g", "__b", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__base"))
    )
    inner = Window.partitionBy("__g", "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        keyed.withColumn(out, F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .join(base, ["__g", "__b"])
        .withColumn(out, F.col(out) + F.col("__base"))
        .drop("__g", "__b", "__base")
    )
