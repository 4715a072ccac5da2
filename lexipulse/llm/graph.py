"""Connected components of an edge table, by distributed minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import dropped, stored


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) of every node of ``edges`` (u, v); nothing reaches the driver but counts.

    Each round takes the smallest label among a node and its neighbours and then that label's label. Rounds are written
    to the shared folder, so a lost executor costs no lineage.
    """
    both = stored(edges.select("u", "v").union(edges.select("v", "u")).where("u <> v").distinct(), "edges")
    label = stored(both.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("node"), F.least("u", "least").alias("label")), "labels")
    last = label
    while True:
        near = both.join(label.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        low = label.join(near, label["node"] == near["u"]).select("node", F.least("label", "near").alias("low"), F.col("label").alias("old"))
        above = label.select(F.col("node").alias("low"), F.col("label").alias("above"))
        step = stored(low.join(above, "low").select("node", F.least("low", "above").alias("label"), "old"), "labels")
        dropped(last)
        last, label = step, step.select("node", "label")
        if step.where("label <> old").isEmpty():
            dropped(both)
            return label
