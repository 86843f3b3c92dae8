"""Connected components of a graph given as edges, by label contraction.

In a round each node points to its smallest neighbour or itself, pointers are followed
once more, and edges are rewritten to the nodes pointed to; loops and doubles go. The
smallest node of a component never moves, so it is what remains. Rounds end when no
edge is left; each is written to the shared folder, so lineage stays short and a lost
executor costs one round at most. A round groups by node with partial aggregation and
joins edges with one row for each node, which adaptive execution splits at hot nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import drop, materialize

MAX_ROUNDS = 100


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Every node on an edge with the smallest node of its component: ``node, root``.

    Edges with a null end and loops are left out; repeated edges count once.
    """
    left = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a") != F.col("b"))
    left = materialize(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    while not left.isEmpty():
        if len(maps) == MAX_ROUNDS:
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
        ends = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = ends.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to"))
        jump = near.select(F.col("node").alias("to"), F.col("to").alias("next"))
        to = materialize(near.join(jump.hint("merge"), "to", "left").select("node", F.coalesce("next", "to").alias("to")), "to")
        maps.append(to)
        one = to.select(F.col("node").alias("a"), F.col("to").alias("ra")).hint("merge")
        two = to.select(F.col("node").alias("b"), F.col("to").alias("rb")).hint("merge")
        moved = left.join(one, "a").join(two, "b").where(F.col("ra") != F.col("rb"))
        moved = materialize(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        drop(left)
        left = moved
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("a").alias("root"))
    found = maps[-1].select("node", F.col("to").alias("root"))
    for step in reversed(maps[:-1]):
        later = found.select(F.col("node").alias("to"), "root").hint("merge")
        found = step.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    found = materialize(found, "components")
    drop(left, *maps)
    return found
