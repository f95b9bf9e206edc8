"""Trees given by parent ids, whatever the ids are: levels, roots, subtrees, sums over subtrees, cycles; all ancestors on demand.

Every round doubles the distance that a pointer spans, so a tree of depth d takes log2(d) rounds of one equi-join on ids; each is
written, and none has more rows than there are nodes. Depths have no gaps: when a round brings no node to its root, no node that
still points on will ever meet one, so the rest lies on a cycle or below one and is not followed any further.

Defined results: a node whose parent is null or is no node is a root; rows without an id are left out; of repeated ids the smallest parent counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.workspace import drop, materialise, written


@dataclass
class Tree:
    """``reached``: node, level, root, of nodes that hang on a root; ``cyclic``: nodes that do not; ``steps``: node, to (the ancestor
    at distance 1, 2, 4, ...) of all nodes that have one, cyclic ones too."""

    reached: DataFrame
    steps: list[DataFrame]
    cyclic: DataFrame

    @cached_property
    def closure(self) -> DataFrame:
        """node, ancestor, distance (0: itself), of nodes that hang on a root: as many rows as their levels together."""
        return materialise(subtree(self, self.reached.select("node")).select("node", F.col("root").alias("ancestor"), "distance"), "closure")


def build(nodes: DataFrame, *, id_col: str, parent_col: str) -> Tree:
    spark = nodes.sparkSession
    named, at = written(nodes.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("node")).agg(F.min(parent_col).alias("parent")), "nodes")
    first = named.join(named.select(F.col("node").alias("parent"), F.lit(1).alias("distance")), "parent", "left")
    done = F.col("distance").isNull()
    state = materialise(first.select("node", F.when(done, F.col("node")).otherwise(F.col("parent")).alias("to"), F.coalesce("distance", F.lit(0)).alias("distance"), done.alias("done")), "pointer")
    drop(spark, at)
    reached, pending, steps = state.where("done"), state.where("not done"), []
    left = pending.count()
    while left:
        ahead = reached.unionAll(pending).select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("distance").alias("further"), "done")
        state, at = written(pending.select("node", "to", "distance").join(ahead, "to").select("node", F.col("next").alias("to"), (F.col("distance") + F.col("further")).alias("distance"), "done"), "pointer")
        before, left = left, state.where("not done").count()
        if left == before:
            drop(spark, at)
            break
        steps.append(pending.select("node", "to"))
        reached, pending = reached.unionAll(state.where("done")), state.where("not done")
    return Tree(reached.select("node", (F.col("distance") + 1).alias("level"), F.col("to").alias("root")), steps, pending.select("node"))


def subtree(tree: Tree, roots: DataFrame) -> DataFrame:
    """(root, node, distance) for the ids in the first column of ``roots`` and all below them."""
    found = roots.select(F.col(roots.columns[0]).alias("node")).distinct().join(tree.reached.select("node"), "node", "left_semi").select(F.col("node").alias("root"), "node", F.lit(0).alias("distance"))
    stay = tree.reached.select("node", F.col("node").alias("below"), F.lit(0).alias("more"))
    for k, step in enumerate(tree.steps):
        found = found.join(stay.unionAll(step.select(F.col("to").alias("node"), F.col("node").alias("below"), F.lit(1 << k).alias("more"))), "node").select("root", F.col("below").alias("node"), (F.col("distance") + F.col("more")).alias("distance"))
    return found


def levels(tree: Tree) -> DataFrame:
    """(node, level, root): a root is at level 1."""
    return tree.reached


def rolled_up(tree: Tree, values: DataFrame, key: str, value: str, *more: str) -> DataFrame:
    """(node, total): the sum of ``value`` over a node and all below it; sums of ``more`` columns follow under their names.

    A sum over all nodes less than 2**k below goes to the node itself and to the ancestor at distance 2**k, so a round has at most
    two rows a node, whatever the depth.
    """
    names = ["total", *more]
    sums = values.groupBy(F.col(key).alias("node")).agg(*[F.sum(c).alias(n) for c, n in zip([value, *more], names)]).join(tree.reached.select("node"), "node", "left_semi")
    kinds = sums.groupBy("node").agg(*[F.sum(n).alias(n) for n in names]).schema  # of a sum of sums; every round would widen decimals again
    for step in tree.steps:
        goes = F.explode(F.when(F.col("to").isNull(), F.array("node")).otherwise(F.array("node", "to")))
        sums = sums.join(step, "node", "left").select(goes.alias("node"), *names).groupBy("node").agg(*[F.sum(n).cast(kinds[n].dataType).alias(n) for n in names])
    return sums
