"""Spanning forests by Borůvka's contraction, for components of any relation.

Every component takes its least edge; the chosen edges are written to the forest,
components are merged by pointer jumping, and edges inside a component or parallel to a
lesser one are dropped. A round at least halves the components that still have edges, and
its tables are written to the shared folder, so that rounds don't add up in the plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histospark.runtime import stage, stage_observed

#: Pointer jumps between two writings; three reach eight steps up.
JUMPS = 3


@dataclass
class Forest:
    """``roots``: ``node, root``, root being a node of the component; ``edges``: ``a, b`` of its spanning tree."""

    roots: DataFrame
    edges: DataFrame
    rounds: int


def spanning_forest(edges: DataFrame) -> Forest:
    """Forest of the graph of ``edges`` (``a, b`` of any ordered type, no loops). Nodes without edges aren't in it."""
    edge = F.struct(F.xxhash64("a", "b").alias("w"), "a", "b")
    left, seen = stage_observed(edges.select(F.col("a").alias("ca"), F.col("b").alias("cb"), edge.alias("edge")), n=F.count("*"))
    nodes = left.select(F.explode(F.array("ca", "cb")).alias("node")).distinct().withColumn("root", F.col("node"))
    chosen: list[DataFrame] = []
    merged: list[DataFrame] = []
    while seen["n"]:
        ends = left.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), F.col("cb").alias("to"), "edge"), F.struct(F.col("cb").alias("c"), F.col("ca").alias("to"), "edge"))).alias("e"))
        # edges are totally ordered, so least edges close no cycle but that of two components that chose the same
        least = stage(ends.groupBy("e.c").agg(F.min(F.struct("e.edge", "e.to")).alias("m")).select("c", F.col("m.to").alias("p"), F.col("m.edge").alias("edge")))
        chosen.append(least.select("edge.a", "edge.b").distinct())
        other = least.select(F.col("c").alias("_c"), F.col("p").alias("_p"))
        parents = least.join(other, F.col("p") == F.col("_c"), "left").select("c", F.when((F.col("_p") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p"))
        moved = True
        while moved:
            for _ in range(JUMPS):
                up = parents.select(F.col("c").alias("_c"), F.col("p").alias("_p"))
                parents = parents.join(up, F.col("p") == F.col("_c"), "left").select("c", F.coalesce("_p", "p").alias("p"), (F.col("_p") != F.col("p")).alias("moved"))
            parents, jumped = stage_observed(parents, moved=F.max("moved"))
            parents, moved = parents.select("c", "p"), jumped["moved"]
        merged.append(parents)
        to = lambda name: parents.select(F.col("c").alias(f"_{name}"), F.col("p").alias(f"_{name}p"))
        joined = left.join(to("ca"), F.col("ca") == F.col("_ca")).join(to("cb"), F.col("cb") == F.col("_cb")).where("_cap <> _cbp")
        left, seen = stage_observed(joined.groupBy(F.least("_cap", "_cbp").alias("ca"), F.greatest("_cap", "_cbp").alias("cb")).agg(F.min("edge").alias("edge")), n=F.count("*"))
    roots = nodes
    for i, parents in enumerate(merged):
        table = parents.select(F.col("c").alias("_r"), F.col("p").alias("_rp"))
        roots = roots.join(table, F.col("root") == F.col("_r"), "left").select("node", F.coalesce("_rp", "root").alias("root"))
        if i % 8 == 7:
            roots = stage(roots)
    forest = chosen[0] if chosen else edges.select("a", "b").limit(0)
    for c in chosen[1:]:
        forest = forest.unionByName(c)
    return Forest(stage(roots), forest, len(merged))
