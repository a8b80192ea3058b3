"""Connected components of an edge table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, persisted_at


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the least node of each connected component, by min-label hooking and jumping.  Each round's labels are a
    table in the shared folder; that of the round before is deleted."""
    spark = edges.sparkSession
    some = edges.where("src <> dst")
    both, both_path = persisted_at(some.select("src", "dst").unionByName(some.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "links")
    label, path = persisted_at(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("node")).alias("component")), "labels")
    for _ in range(rounds):
        reach = both.join(label, both.dst == label.node).select(F.col("src").alias("node"), "component")
        low = reach.groupBy("node").agg(F.min("component").alias("low"))
        hooked = label.join(low, "node").select("node", F.least("component", "low").alias("component"), F.col("component").alias("old"))
        # the old root learns of it as well, then every node jumps to the label of its label
        roots = hooked.groupBy(F.col("old").alias("node")).agg(F.min("component").alias("root_low"))
        hooked = hooked.join(roots, "node", "left").select("node", F.least("component", "root_low").alias("component"), "old")
        up = hooked.select(F.col("node").alias("component"), F.col("component").alias("up"))
        step, step_path = persisted_at(hooked.join(up, "component", "left").select("node", F.least("component", "up").alias("component"), "old"), "labels")
        drop(spark, path)
        label, path = step.select("node", "component"), step_path
        if step.where("component <> old").isEmpty():
            drop(spark, both_path)
            return label
    raise RuntimeError("components did not settle")
