"""Connected components of a distributed edge table by smallest labels."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsegrid.session import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) to (node, root): the smallest node that each node reaches.

    Each round takes the smallest label around a node, then the label of that label, until no label changes. The tables are written
    to the shared folder each round, so nothing hangs on executors that may be lost, and nothing but a count reaches the driver.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(around, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("root").alias("further"))
        step = checkpointed(step.join(jump, "new").select("node", "old", F.least("new", "further").alias("root")))
        if step.where("old <> root").isEmpty():
            return step.select("node", "root")
        labels = step.select("node", "root")
