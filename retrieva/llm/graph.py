"""Connected components by alternating large-star and small-star steps (joins and grouped minima).

Each step rewires every edge towards the smallest neighbour; the number of steps grows with the logarithm of the
component size. Only minima are grouped (pre-aggregated before the shuffle), so a node with very many edges does
not meet in one task, and nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrieva.session import materialize


def _to_smallest(e: DataFrame) -> DataFrame:
    """(u, v) with the smallest v of each u beside it. The minima are written: the join then has plain shuffles, which Spark splits for a node with very many edges."""
    least = materialize(e.groupBy("u").agg(F.min("v").alias("m")), "smallest")
    return e.join(least, "u")


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """edges(a, b) of one type -> (node, component): the smallest node that can be reached.

    Only nodes with an edge to another node are listed. Nulls, loops and repeated edges are ignored.
    """
    e = materialize(edges.filter(F.col("a") != F.col("b"))
                    .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    state = _state(e)
    for _ in range(max_rounds if state[0] else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: neighbours above u go to the smallest of u and its neighbours
        large = _to_smallest(both).filter(F.col("v") > F.col("u")).select(
            F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        # small star: neighbours below u, and u, go to the smallest of them
        small = _to_smallest(large)
        e = materialize(small.select("u", F.col("m").alias("v"))
                        .unionByName(small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), name)
        before, state = state, _state(e)
        if state == before:
            break
    else:
        if state[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
