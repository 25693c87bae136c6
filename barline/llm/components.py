"""Connected components of an edge table, by contraction.

Each round every node points at its least neighbour if that is less than itself, pointers are
doubled once, and edges are rewritten to the pointed nodes; edges inside a component vanish.
The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import discard, materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root is the least node of its component.

    Loops and repeated edges are allowed; an empty table gives an empty result.
    """
    live = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    nodes = live.select(F.col("a").alias("node")).union(live.select("b")).distinct()
    member = materialise(nodes.select("node", F.col("node").alias("root")), "cc-members")
    live = live.where("a <> b")
    while not live.isEmpty():
        # the greater end of an edge may point at the lesser one
        up = live.groupBy("b").agg(F.min("a").alias("to")).select(F.col("b").alias("node"), "to")
        step = up.select("node", "to")
        twice = step.join(up.select(F.col("node").alias("to"), F.col("to").alias("far")), "to", "left")
        hop = materialise(twice.select("node", F.coalesce("far", "to").alias("to")), "cc-hops")
        ends = live
        for side in ("a", "b"):
            ends = ends.join(hop.select(F.col("node").alias(side), F.col("to").alias(f"{side}_to")), side, "left")
        ends = ends.select(F.coalesce("a_to", "a").alias("x"), F.coalesce("b_to", "b").alias("y")).where("x <> y")
        old_live, old_member = live, member
        live = materialise(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges")
        moved = member.join(hop.select(F.col("node").alias("root"), "to"), "root", "left")
        member = materialise(moved.select("node", F.coalesce("to", "root").alias("root")), "cc-members")
        for x in (old_live, old_member, hop):
            discard(x)
    return member
