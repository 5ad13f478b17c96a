"""Connected components of a large graph by repeated contraction, all in joins and minima.

In each round every node joins its neighbour (or itself) that is first in a random order, and the edges between what
is left go on. The random order halves long chains in expectation, so rounds grow with the logarithm
of the size; a star is done in one. Each round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granthi.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b); a component is named by its smallest node.

    Self-loops, repeated and reversed edges are allowed; edges with a null end are dropped.
    """
    left = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                       .filter(F.col("a").isNotNull() & (F.col("a") != F.col("b"))).distinct(), "edges")
    labels: DataFrame | None = None
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        joins = materialise(
            both.groupBy("a").agg(F.min(order("b")).alias("near"))
            .select(F.col("a").alias("node"), F.least(order("a"), F.col("near"))["id"].alias("to")), "joins")
        a, b = joins.toDF("a", "ta"), joins.toDF("b", "tb")
        left = materialise(
            left.join(a, "a").join(b, "b").filter(F.col("ta") != F.col("tb"))
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        if labels is None:
            labels = joins
        else:
            moved = joins.select(F.col("node").alias("to"), F.col("to").alias("further"))
            labels = materialise(labels.join(moved, "to", "left")
                                 .select("node", F.coalesce("further", "to").alias("to")), "labels")
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # The first of a component in the random order may itself have been no source of an edge: name by the smallest.
    names = labels.groupBy("to").agg(F.min(F.least("node", "to")).alias("component"))
    return labels.join(names, "to").select("node", "component")
