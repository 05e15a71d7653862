"""Connected components of a link table, by smallest-label propagation with hooked roots and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

def connected(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of links (a, b).  Links are never collected.

    Each round gives a node the smallest label among its own and its neighbours', then the label of that label, and
    gives what the node finds to its former label too: whole trees move at once, so rounds grow with the logarithm of a
    chain's length.  Rounds go on until no label changes.  The tables are written to shared storage each round, so a
    lost executor costs one round's read at most.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    both = materialise(both.where("node <> other").distinct(), "links")
    labels = materialise(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        moved = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("jump"))
        found = moved.join(jump, "next").select("node", "component", F.least("next", "jump").alias("found"))
        own = F.struct("node", "found", F.col("component").alias("old"))
        root = F.struct(F.col("component").alias("node"), "found", F.lit(None).cast(dict(labels.dtypes)["component"]).alias("old"))
        new = found.select(F.inline(F.array(own, root))).groupBy("node").agg(F.min("found").alias("component"), F.max("old").alias("old"))
        new = materialise(new.select("node", "component", (F.col("component") != F.col("old")).alias("changed")), "labels")
        labels = new.select("node", "component")
        if new.where("changed").isEmpty():
            return labels
