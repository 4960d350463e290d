"""Connected components of a link table by alternating star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.session import stored

# Rounds needed grow with the logarithm of the longest chain; far more than any real table needs.
MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node reachable.

    Links may repeat, point either way or join a node to itself; they are read twice and should be
    a written table. Every round writes its links to the shared folder. A node's neighbours are never
    gathered into one row: the smallest is an aggregate, and the others are joined to it. A node with very
    many neighbours is one key of that join, whose large side Spark's skew join may split.
    """
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    for _ in range(MAX_ROUNDS):
        edges = stored(_small_star(_large_star(edges)), "star")
        if _is_forest_of_stars(edges):
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest neighbour or itself."""
    both = edges.union(edges.select("v", "u")).toDF("node", "other")
    least = both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("least"))
    return both.where("other > node").join(least, "node").select(
        F.col("other").alias("u"), F.col("least").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    moved = edges.join(least, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.union(least).distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node has one link up at most, and none of those linked to has one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where(
        "up > 1 or (up = 1 and down = 1)").isEmpty()
