"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label: the smallest node reachable from each node of links (a, b: long).

    Each round takes the smallest label among the neighbours and then that label's own label, so
    that labels travel twice as far each round. Minima are combined before rows are shuffled, so a
    hub costs one row per task. Every round is written to the shared folder.
    """
    links = scratch.save(links.select("a", "b").filter("a <> b").distinct(), "links")
    both = links.unionByName(scratch.again(links).select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = scratch.save(both, "both")
    scratch.drop(links)
    labels = scratch.save(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")), "labels")
    while True:
        near = scratch.again(both).join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("low"))
        old = scratch.again(labels)
        step = scratch.save(old.join(near, old.node == near.a).select("node", F.col("label").alias("was"), F.least("label", "low").alias("label")), "step")
        jump = scratch.again(step).select(F.col("node").alias("at"), F.col("label").alias("far"))
        fresh = scratch.save(step.join(jump, step.label == jump["at"], "left").select("node", "was", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        changed = fresh.filter("was <> label").limit(1).count()
        scratch.drop(labels, step)
        labels = scratch.save(fresh.select("node", "label"), "labels") if not changed else fresh
        if not changed:
            scratch.drop(fresh, both)
            return labels
