"""Connected components by alternating large-star and small-star steps.

The graph stays a distributed edge table; only row counts reach the driver.
Stars are built with grouped minima and joins, so a vertex of any degree is
never gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import cut, discard


def _large_star(edges: DataFrame) -> DataFrame:
    """Every vertex's larger neighbours are linked to the least of itself and its neighbours; the result has v < u."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Written first: a vertex with many neighbours then meets its minimum in a join that can be split.
    least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every vertex and its smaller neighbours are linked to the least of those; edges must have v < u."""
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _settled(stars: DataFrame) -> bool:
    """Whether the edges (u, v), v < u, are a forest of stars: every u has one v, and no v is a u itself."""
    ends = stars.select(F.col("u").alias("k"), F.lit(1).alias("as_u"), F.lit(0).alias("as_v")).unionByName(stars.select(F.col("v").alias("k"), F.lit(0).alias("as_u"), F.lit(1).alias("as_v")))
    roles = ends.groupBy("k").agg(F.sum("as_u").alias("us"), F.max("as_v").alias("v"))
    return not roles.where("us > 1 or (us = 1 and v = 1)").limit(1).count()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """u, v: every vertex of the edge table except the least of its component, with that least vertex.

    Self-loops, duplicate edges and nulls make no difference.  Each round
    shortens the chains of stars; its table is written to the shared folder, so
    a lost executor never restarts the loop.  The edges are read several times:
    they should be a written table.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    for _ in range(rounds):
        large = cut(_large_star(now), "edges")
        discard(now)
        now = cut(_small_star(large), "edges")
        discard(large)
        if _settled(now):
            return now
    raise RuntimeError("components did not converge")
