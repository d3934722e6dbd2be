"""Connected components by labels that shrink: every node takes the least label around it, then the label of its label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame) -> DataFrame:
    """Rows ``node, label`` for the nodes of ``links`` (columns ``a, b``); label is the least node reachable.

    Nodes are integers. Repeated links, links in both directions and links of a node to itself do no harm; rows with a null are left out.
    The number of rounds follows the logarithm of the longest chain. Each round is written to the shared folder, so a lost
    executor repeats one round; minima are taken before the shuffle, so a node with very many links costs no more than others.
    """
    clean = links.where("a is not null and b is not null and a <> b")
    edges = staged(clean.select("a", "b").union(clean.select("b", "a")).distinct(), "edges")
    labels = staged(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        around = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        best = labels.join(around.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("to"))
        best = staged(best, "labels")
        ahead = best.select(F.col("node").alias("to"), F.col("to").alias("onward"))
        new = staged(best.join(ahead, "to").select("node", "old", F.col("onward").alias("label")), "labels")
        if not new.where("old <> label").limit(1).collect():
            return new.select("node", "label")
        labels = new.select("node", "label")
