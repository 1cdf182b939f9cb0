"""Connected components of a link table by alternating star contractions.

Every round is two grouped aggregates over the link table, which stays distributed; the driver
only sees one count per round. A vertex with very many links is harmless: only its smallest
neighbour is gathered, by a map-side combine, and links are joined back to it by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphwalk.plans.cut import cut, drop_cut


def _state(edges: DataFrame) -> tuple:
    """Number and sums of two hashes of the (distinct) links: equal for equal tables."""
    sums = [F.sum(F.xxhash64(F.lit(seed), "u", "v").cast("decimal(20,0)")) for seed in (1, 2)]
    return tuple(edges.agg(F.count(F.lit(1)), *sums).first())


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(vertex, component) for each vertex of ``links``; component is the smallest vertex reachable."""
    edges = cut(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    state = _state(edges)
    for _ in range(max_rounds if state[0] else 0):
        # Large star: every neighbour above u is tied to the smallest vertex around u.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its lower neighbours are tied to the smallest of them.
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(down.select("u", F.col("m").alias("v")))
            .distinct()
        )
        after, before = cut(small), state
        drop_cut(edges)
        edges, state = after, _state(after)
        if state == before:
            break
    else:
        if state[0]:
            raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    )
