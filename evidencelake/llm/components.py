"""Connected components of links, in Spark: every node takes the least label in reach, labels are then followed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.llm import common


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for every node of edges (a, b).

    Each round a node takes the least label of its neighbours and then that label's own label, so the rounds grow
    with the logarithm of a component's width, not with its size. Hot nodes are combined before the shuffle. Only the
    number of changed labels comes to the driver.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    both = common.store(both.distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
    labels = common.store(labels.select("node", F.least("node", "near").alias("root")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        met = labels.join(near, labels["node"] == near["a"]).select("node", "root", F.least("root", "near").alias("next"))
        ahead = labels.select(F.col("node").alias("at"), F.col("root").alias("beyond"))
        new = met.join(ahead, met["next"] == ahead["at"]).select("node", F.least("next", "beyond").alias("root"), (F.least("next", "beyond") < F.col("root")).alias("changed"))
        new = common.store(new, "labels")
        labels = new.select("node", "root")
        if new.filter("changed").limit(1).count() == 0:
            return labels
