"""Connected components of a table of links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import forget, gathered, settle


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): for every node that has a link, the smallest node it can reach, itself included.

    Each round takes the smallest label among a node's neighbours and then the label of that label; the number
    of rounds grows with the logarithm of the longest way.  Null ends and loops don't link; repeated links are
    harmless; no links give an empty table.  Labels are written to the shared folder after each round.
    """
    links = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("a"), F.col(b).alias("b"))
    written = settle(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    both = gathered(written)
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    alone = both is not written
    while True:
        labels = labels.coalesce(1) if alone else labels
        told = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("told"))
        near = labels.join(told, "node").select("node", F.col("label").alias("was"), F.least("label", "told").alias("label"))
        roots = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        new = settle(near.join(roots, "label").select("node", "was", F.least("label", "root").alias("label")))
        changed = not new.where("label != was").isEmpty()
        forget(labels)
        labels = new.select("node", "label")
        if not changed:
            forget(written)
            return labels
