"""Connected components by alternating large-star and small-star.

Each round is two joins on the edge table. No node's neighbours are gathered: a
star needs only the least neighbour, which is an aggregate with a map-side part,
and the join back can be split where a node is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runaudit.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every neighbour above a node is linked to the node's least
    neighbour or itself. Small: every neighbour below it, and it, likewise."""
    if large:
        around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = around.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))
        )
    return out.where("a != b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node above has one link, to a node that is above none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
        edges.select(F.col("b").alias("node"), F.lit(0), F.lit(1))
    )
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): component is the least
    node that can be reached. Loops, repeats and both directions are fine; null ends
    are dropped. Without edges there are no rows."""
    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = stored(edges.where("a != b").select(high, low).distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    while not _stars(edges):
        edges = stored(_star(_star(edges, large=True), large=False), "edges")
    return nodes.join(edges.select(F.col("a").alias("node"), "b"), "node", "left").select(
        "node", F.coalesce("b", "node").alias("component")
    )
