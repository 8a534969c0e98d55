"""Connected components of a table of links, by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of the links (a, b); nodes are longs.

    Each round gives a node the least label among its neighbours and itself, then the label of that label, so a chain
    halves; links inside one component stop counting. Every round is a stored table. A hub's links are joined, not
    collected, and its labels are combined before the shuffle.
    """
    both = stage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        nearer = labels.join(seen.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("component")
        )
        nearer = stage(nearer, "labels")
        jump = nearer.select(F.col("node").alias("component"), F.col("component").alias("further"))
        labels = stage(nearer.join(jump, "component").select("node", "old", F.col("further").alias("component")), "labels")
        if labels.where(F.col("old") != F.col("component")).isEmpty():
            return labels.select("node", "component")
        labels = labels.drop("old")
