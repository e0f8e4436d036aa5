"""Connected components by alternating large and small stars, every step a written table.

Each round is two joins of the edges with the least neighbour of each vertex; a hub's rows are split by
adaptive execution's skew joins, and its least neighbour is found by partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(u, v): each vertex that has an edge and is not the least of its component, with that least vertex.

    edges: long columns u and v; self-loops and nulls are ignored. No edges give an empty result.
    """
    edges = materialize(edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct(), name)
    before = None
    while True:
        last, edges = edges, materialize(_small_star(_large_star(edges)), name)
        discard(last)
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return edges
        before = state
