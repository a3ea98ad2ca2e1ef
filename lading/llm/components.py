"""Connected components of a distributed edge list, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lading.materialise import cut


def _is_stars(edges: DataFrame) -> bool:
    """Every u has one edge, and no centre v is itself a u."""
    twice = edges.groupBy("u").count().filter("count > 1").select("u")
    inner = edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").select("u")
    return twice.unionByName(inner).isEmpty()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) for every id on an edge; the component is its smallest id.

    Large-star then small-star (edges always point from u to a smaller v) until
    only stars are left: a logarithmic number of rounds, each of a few shuffles
    whose minima are combined before the shuffle.  A node with very many
    neighbours is only ever a join key, which adaptive execution splits.  Each
    round is checkpointed.  Edges with a null end and self-loops are ignored.
    """
    now = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    while not _is_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    centres = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(centres)
