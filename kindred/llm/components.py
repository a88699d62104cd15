"""Connected components by alternating large-star and small-star.

Each round reads and writes a table of edges; no node's neighbours are gathered in one task, only their minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kindred.llm.workspace import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # Links that come out twice are merged by the small star.
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them; edges point from larger to smaller."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, ws: Workspace, name: str = "components") -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``, the component named by its smallest node.

    Self-links and repeated links change nothing; without links the result is empty.
    """
    at = 0
    now = ws.save(edges.select("u", "v").where("u <> v"), f"{name}-0")
    while True:
        at += 1
        after = ws.save(_small_star(_large_star(now)), f"{name}-{at}")
        ws.drop(f"{name}-{at - 1}")
        now = after
        if _is_star_forest(now):
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node is either a root or has one link, to a root; then each component is one star."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("down")))).alias("e"))
    seen = ends.select("e.*").groupBy("x").agg(F.sum("down").alias("links"), F.min("down").alias("root"))
    wrong = F.when((F.col("links") > 1) | ((F.col("links") > 0) & (F.col("root") == 0)), 1)
    return seen.agg(F.count(wrong)).first()[0] == 0
