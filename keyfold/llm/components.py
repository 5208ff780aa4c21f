"""Connected components of a graph held as an edge table, by contraction.

In each round every node takes its smallest neighbour, if that is smaller than itself, as parent; chains of
parents are halved by joins until all point to a root; edges are then carried over to the roots. At
least half of the nodes that still have an edge vanish in a round. All state is in tables in the
shared folder: nothing is collected, and a lost executor costs only its tasks. A node with very many
neighbours is met by aggregation with map-side combine and by joins that Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.shared import written


def _rooted(parents: DataFrame) -> DataFrame:
    """(node, parent) with parent <= node, followed until every parent is its own parent."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        step = written(parents.join(up, "parent").select("node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")), "roots")
        parents = step.select("node", "parent")
        if step.filter("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """From edges (a long, b long) to (node, root): root is the smallest node of node's component.

    Loops, repeated edges and edges with a null end are ignored. Only nodes that have an edge appear; an
    empty edge table gives an empty result.
    """
    edges = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        ends = edges.select("a", "b").union(edges.select("b", "a"))
        least = ends.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("parent"))
        parents = _rooted(written(least, "parents"))
        if labels is None:
            labels = parents.select("node", F.col("parent").alias("root"))
        else:
            up = parents.select(F.col("node").alias("root"), "parent")
            labels = written(labels.join(up, "root", "left").select("node", F.coalesce("parent", "root").alias("root")), "labels")
        of_a = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        of_b = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        roots = edges.join(of_a, "a").join(of_b, "b").filter("pa <> pb")
        edges = written(roots.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
