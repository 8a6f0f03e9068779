"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.session import materialize


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component): the least node that each of ``nodes`` (column ``node``) reaches over ``links`` (a, b).

    Each round takes the least label among a node and its neighbours, then the label of that label, until no label changes;
    labels jump ahead by doubling, so rounds grow with the logarithm of the longest path. Only linked nodes take part.
    """
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    both = materialize(both, "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_seen"))
        near = labels.join(seen, "node").select("node", F.col("label").alias("_was"), F.least("label", "_seen").alias("label"))
        ahead = near.select(F.col("node").alias("label"), F.col("label").alias("_next"))
        after = materialize(near.join(ahead, "label").select("node", "_was", F.least("label", "_next").alias("label")), "labels")
        labels = after.select("node", "label")
        if not after.filter("label != _was").limit(1).count():
            break
    return nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("component"))
