"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id of ``edges`` (a, b): root is the smallest id that can be reached.

    Each round takes the smallest label around every id and then the label of that label, so paths
    shorten by half; rounds end when no label changes. All is joins and pre-aggregated groups on
    Parquet tables, and only a count reaches the driver.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("root")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("m"))
        step = labels.join(near, "id").select("id", F.col("root").alias("old"), F.least("root", "m").alias("mid"))
        jump = labels.select(F.col("id").alias("mid"), F.col("root").alias("far"))
        new = materialize(step.join(jump, "mid", "left").select("id", "old", F.least("mid", F.coalesce("far", "mid")).alias("root")))
        changed = new.where("old <> root").limit(1).count()
        labels = new.select("id", "root")
        if not changed:
            return labels
