"""Connected components of a distributed edge list, by contraction.

Every node hooks onto its smallest neighbour; edges are renamed to those
labels and the smaller graph is contracted again, until no edge is left.
Each round costs one pre-aggregated groupBy and two equi-joins, which AQE
may split on hot nodes; rounds grow with the logarithm of the graph.
Neither edges nor labels reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laconic.llm.common import files, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node that can be reached.

    Loops and repeated edges are allowed; an empty edge list has no nodes.
    edges are read twice.
    """
    pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    pairs = materialise(pairs.union(pairs.select("v", "u")).distinct().coalesce(files(2 * edges.count())), "edges")
    label: DataFrame | None = None
    nodes = 0
    while left := pairs.count():
        nodes = nodes or left  # the first edges name every node
        hook = materialise(pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("to")).coalesce(files(left)), "hooks")
        if label is None:
            label = hook.select(F.col("u").alias("node"), F.col("to").alias("component"))
        else:
            label = label.join(hook.select(F.col("u").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        label = materialise(label.coalesce(files(nodes)), "labels")
        there = hook.select("u", F.col("to").alias("x"))
        other = hook.select(F.col("u").alias("v"), F.col("to").alias("y"))
        pairs = pairs.join(there, "u").join(other, "v").where("x <> y").select(F.col("x").alias("u"), F.col("y").alias("v"))
        pairs = materialise(pairs.distinct().coalesce(files(left)), "edges")
    if label is None:
        return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return label
