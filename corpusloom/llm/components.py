"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is two partial aggregates and two equi-joins and is written to the shared folder, so
lineage stays short and nothing but two scalars a round reaches the driver. The number of rounds
grows with the logarithm of the longest chain. The table of a round goes as soon as the next one stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import drop, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return rest.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b: long) -> (node, component): the smallest node reachable, for every node with an edge to another.

    Loops and repeated edges are allowed, null ends are ignored; no edge, no row.
    """
    state, path = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        now = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1000003).alias("h")).first()
        if now["n"] == 0 or now == mark:
            return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(state.select(F.col("b"), F.col("b")).distinct())
        mark, before = now, path
        state, path = written(_small_star(_large_star(state)), "stars")
        drop(edges.sparkSession, before)
    raise RuntimeError(f"the components did not settle in {max_rounds} rounds")
