"""Weisfeiler-Leman refinement of trees given as node tables.

A round relabels every node by a hash of its label and the sorted labels of its
children.  Children are counted by label before they are listed, so a node with very many
children moves a row a distinct label and not a row a child.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 64


def refine(nodes: DataFrame) -> DataFrame:
    """One round over (tree, node_id, parent_id, label)."""
    counted = nodes.where(F.col("parent_id").isNotNull()).groupBy("tree", "parent_id", "label").agg(F.count(F.lit(1)).alias("n"))
    kids = counted.groupBy("tree", "parent_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "label", F.col("n").cast("string")))), ",").alias("kids"))
    kids = kids.withColumnRenamed("parent_id", "node_id")
    joined = nodes.join(kids, ["tree", "node_id"], "left")
    return joined.select("tree", "node_id", "parent_id", F.md5(F.concat_ws("|", "label", F.coalesce("kids", F.lit("")))).alias("label"))


def bin_of(label: Column) -> Column:
    return (F.conv(F.substring(label, 1, 8), 16, 10).cast("long") % BINS).cast("int")


def histogram(nodes: DataFrame, rounds: int) -> DataFrame:
    """(tree, bin, n, share) over the labels of all rounds, the first by type; ``nodes`` has tree, node_id, parent_id, type."""
    now = nodes.select("tree", "node_id", "parent_id", F.md5(F.col("type")).alias("label"))
    all_ = now
    for _ in range(rounds):
        now = refine(now)
        all_ = all_.unionByName(now)
    bins = all_.groupBy("tree", bin_of(F.col("label")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = bins.groupBy("tree").agg(F.sum("n").alias("t"))
    return bins.join(total, "tree").select("tree", "bin", "n", (F.col("n") / F.col("t")).alias("share"))
