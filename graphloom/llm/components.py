"""Connected components of a link table by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links (a, b) -> node, label: the least node reachable, for every node that has a link.

    Each round takes the least label among neighbours, then the label of that label. Rounds are written to the shared
    folder; only a count of changes comes to the driver. Raises if labels still change after ``max_rounds``.
    """
    both = links.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = common.materialize(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = common.materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    for _ in range(max_rounds):
        near = both.join(labels, both.v == labels.node).groupBy(both.u.alias("w")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, labels.node == near.w).select("node", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("up_label"))
        jumped = stepped.join(up, stepped.next == up.up).select("node", F.least("next", "up_label").alias("label"), "old")
        jumped = common.materialize(jumped)
        changed = jumped.where("label <> old").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError("components still change")
