"""Connected components of an edge table, without links or labels on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from terravane.llm.shared import discard, materialise

#: Rounds after which something must be wrong: labels at least halve their distance to the root in each.
MOST_ROUNDS = 64


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); the root is a component's smallest node.

    Every round takes the smallest label among a node's neighbours (a join, then a
    minimum that folds before its exchange) and then the label of that label, so long
    chains shrink fast. The joins' hot keys may be split; a round's result is a table in
    the shared folder, and the driver sees one number of changed labels.
    """
    spark = edges.sparkSession
    links = edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    links, links_at = materialise(links.distinct(), "lines")
    labels, at = materialise(links.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "labels")
    for _ in range(MOST_ROUNDS):
        near = links.join(labels, links["a"] == labels["node"]).select(F.col("b").alias("node"), "root")
        own = labels.select("node", "root", F.col("root").alias("old"))
        least = near.unionByName(own, allowMissingColumns=True).groupBy("node").agg(F.min("root").alias("root"), F.max("old").alias("old"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("up"))
        moved = least.join(up, "root").select("node", F.least("root", "up").alias("root"), "old")
        seen = Observation()
        moved = moved.observe(seen, F.count(F.when(F.col("root") != F.col("old"), 1)).alias("changed"))
        new, new_at = materialise(moved.select("node", "root"), "labels")
        discard(spark, at)
        labels, at = new, new_at
        if not seen.get["changed"]:
            break
    else:
        raise RuntimeError("labels still change")
    discard(spark, links_at)
    return labels
