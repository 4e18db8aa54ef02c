"""Connected components of a table of links, by least labels and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, written


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that occurs in a link; root is the least node reachable.

    Every round takes the least label among a node's neighbours (a sum-like aggregate, combined before the shuffle)
    and then the label of that label, so the rounds follow the logarithm of the longest path.
    """
    both = links.select(F.col(a).alias("src"), F.col(b).alias("dst")).unionByName(links.select(F.col(b).alias("src"), F.col(a).alias("dst")))
    edges = written(both.where("src <> dst").distinct())
    step = written(edges.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("src")).alias("root")))
    while True:
        labels = step.select("node", "root")
        near = edges.join(labels, edges["dst"] == labels["node"]).groupBy("src").agg(F.min("root").alias("near"))
        least = labels.join(near, labels["node"] == near["src"]).select("node", F.least("root", "near").alias("root"), F.col("root").alias("before"))
        up = least.select(F.col("node").alias("up"), F.col("root").alias("up_root"))
        after = written(least.join(up, least["root"] == up["up"]).select("node", F.least("root", "up_root").alias("root"), "before"))
        drop(step)
        step = after
        if step.where("root <> before").isEmpty():
            drop(edges)
            return step.select("node", "root")
