"""Small inputs over all cores: a file of one row group is one task however many cores there are."""

from __future__ import annotations

from pyspark.sql import DataFrame

SMALL = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt round-robin over the cores if its files are smaller than ``SMALL``; larger inputs have splits enough."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SMALL else df
