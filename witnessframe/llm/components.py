"""Connected components of a link table, computed with joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for every node in ``links(a, b)``: the least node reachable.

    Each round takes the least label among the neighbours and then the label of that
    label, so the reach doubles; every round is checkpointed in the shared folder. Ids
    may be of any orderable type. Links to itself and repeated links do no harm, rows
    with a null end are ignored, an empty table gives an empty table.
    """
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = durable(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")))
    while True:
        near = both.join(labels, both["a"] == labels["node"]).groupBy("b").agg(F.min("label").alias("best"))
        closer = labels.join(near, labels["node"] == near["b"]).select("node", F.least("label", "best").alias("via"))
        hop = labels.select(F.col("node").alias("via"), F.col("label").alias("beyond"))
        found = durable(
            closer.join(hop, "via").select("node", F.least("via", "beyond").alias("label"))
        )
        moved = found.join(labels.withColumnRenamed("label", "old"), "node").where(F.col("label") != F.col("old"))
        labels, done = found, moved.isEmpty()
        if done:
            return labels
