"""Connected components of a link table by repeated contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.llm.common import Workspace


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(node, label) for every node of `edges` (u, v): equal labels if and only if connected.

    In each round every node takes its smallest neighbour (or itself) as its label and edges are rewritten
    in labels; a component with edges at least halves, so rounds grow with the logarithm of its size.
    No row holds more than one link, and each round is written to the workspace.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct()
    both = work.stored(both, "links")
    nodes = None
    while both.limit(1).count():
        parent = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("p"))
        if nodes is None:
            nodes = work.stored(parent.select(F.col("u").alias("node"), F.col("p").alias("label")), "labels")
        else:
            moved = nodes.join(parent, nodes.label == parent.u, "left").select("node", F.coalesce("p", "label").alias("label"))
            nodes = work.stored(moved, "labels")
        left = both.join(parent, "u").select(F.col("p").alias("a"), "v")
        far = parent.select(F.col("u").alias("v"), F.col("p").alias("b"))
        both = work.stored(left.join(far, "v").filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "links")
    if nodes is None:
        return both.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes
