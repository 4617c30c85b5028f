"""Connected components of a large graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlog.llm.common import keep


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )


def _star(sides: DataFrame, keep_side: str) -> DataFrame:
    """Hang the neighbours of each node on the smallest of them and the node."""
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = sides.join(least, "u")
    if keep_side == "larger":
        return joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    hung = joined.select(F.col("v").alias("a"), F.col("m").alias("b"))
    return hung.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def _is_done(edges: DataFrame) -> bool:
    """Whether every node hangs on one root: no node has two parents, or a parent and children."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
        F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")),
    )).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
    return nodes.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``links`` (a, b); a component is its smallest node.

    Each round hangs larger neighbours, then smaller ones, on the least neighbour; both passes
    only group and join on the node. Rounds grow with the logarithm of the longest path.
    """
    edges = links.select("a", "b").where("a != b")
    while True:
        edges = _star(_both_ways(edges), "larger").where("a != b")
        lower = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        edges = keep(_star(lower, "smaller").where("a != b").distinct(), "edges")
        if _is_done(edges):
            break
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
