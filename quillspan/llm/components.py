"""Connected components by hooking and pointer jumping: distributed, with every step written to the shared folder.

Each round hooks every root to its smallest neighbour, which makes trees of falling ids; jumping (a node's parent becomes its
parent's parent) then flattens them in the logarithm of their depth, so a chain of 10,000 ids in order takes one round of about 14 jumps.
The ends of the edges are replaced by their roots, loops and repeats go, until no edge is left. A root is always the
smallest node hooked to it, so it is the component's smallest node. Nodes that aren't listed are alone.

Edge cases: loops and repeated or reversed links change nothing; without links the components stay as they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import discard, materialize


def flattened(up: DataFrame, steps: list[str]) -> DataFrame:
    """``up`` (x, p; a written table of trees) with the root of each x as its p."""
    spark = up.sparkSession
    while True:
        above = up.select(F.col("x").alias("p"), F.col("p").alias("q"))
        after = materialize(up.join(above, "p", "left").select("x", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "cc-up")
        steps.append("jump")
        discard(spark, up)
        up = after
        if up.where("moved").isEmpty():
            return up


def contract(labels: DataFrame | None, links: DataFrame, steps: list[str] | None = None) -> DataFrame:
    """(node, root) after adding ``links`` (u, v) to the components ``labels`` (node, root; None: all nodes alone); a written table.

    ``steps`` gets the name of each step taken.
    """
    spark, steps = links.sparkSession, [] if steps is None else steps
    nodes = links.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("root", F.col("node"))
    if labels is not None:
        nodes = labels.unionByName(nodes.join(labels, "node", "left_anti"))
    nodes = materialize(nodes, "cc-nodes")
    at = lambda side: nodes.select(F.col("node").alias(side), F.col("root").alias(f"{side}r"))
    edges = links.join(at("u"), "u").join(at("v"), "v").select(F.least("ur", "vr").alias("a"), F.greatest("ur", "vr").alias("b")).where("a < b").distinct()
    edges = materialize(edges, "cc-edges")
    while not edges.isEmpty():
        steps.append("hook")
        up = flattened(materialize(edges.groupBy(F.col("b").alias("x")).agg(F.min("a").alias("p")), "cc-up"), steps)
        root = lambda side: up.select(F.col("x").alias(side), F.col("p").alias(f"{side}p"))  # noqa: B023, E731
        after = materialize(nodes.join(up, nodes.root == up.x, "left").select("node", F.coalesce("p", "root").alias("root")), "cc-nodes")
        moved = edges.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("ap", "a").alias("a"), F.coalesce("bp", "b").alias("b"))
        left = materialize(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "cc-edges")
        discard(spark, nodes, edges, up)
        nodes, edges = after, left
    discard(spark, edges)
    return nodes
