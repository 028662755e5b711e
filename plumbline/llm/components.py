"""Connected components by alternating large-star and small-star rounds; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (u, v), u > v.  Large: connect all larger neighbours to the least neighbour; small: all smaller ones and the node itself."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        linked = edges.join(least, "u")
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b); root is the least node of its component.  Ends when a double round changes no edge."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = common.written(edges, "components")
    mark = None
    while True:
        half = common.written(_star(edges, True), "components")
        nxt = common.written(_star(half, False), "components")
        now = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        common.dropped(edges, half)
        edges = nxt
        if mark == now:
            break
        mark = now
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
