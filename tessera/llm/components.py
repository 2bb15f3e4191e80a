"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (a, b) of long ids; component: an id in its component.

    Every round sends each node to the least of itself and its neighbours and contracts the graph by that; nodes
    that aren't a local minimum vanish, so the rounds are logarithmic in the nodes. Edges and labels stay
    distributed; each round ends in a reliable checkpoint. An empty table gives an empty table.
    """
    edges = checkpoint(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    labels = None
    while not edges.isEmpty():
        least = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).groupBy("e.u").agg(F.least(F.min("e.v"), F.col("u")).alias("p"))
        least = checkpoint(least)
        if labels is None:
            labels = least.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            step = least.select(F.col("u").alias("component"), "p")
            labels = labels.join(step, "component", "left").select("node", F.coalesce("p", "component").alias("component"))
        to = least.select(F.col("u"), "p")
        edges = edges.join(to.select(F.col("u").alias("a"), F.col("p").alias("pa")), "a").join(to.select(F.col("u").alias("b"), F.col("p").alias("pb")), "b")
        edges = checkpoint(edges.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a < b").distinct())
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return checkpoint(labels)
