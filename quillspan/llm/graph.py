"""Connected components of an edge table, without the driver seeing an edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.store import drop, settle


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b): root is the smallest vertex reachable.

    Each round takes the smallest label among the neighbours and then the label of
    that label (pointer jumping), so the rounds grow with the logarithm of the
    diameter.  Every round is written to the shared folder.
    """
    both = settle(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), name)
    labels = settle(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("root")), name)
    held = [labels]
    while True:
        told = both.join(labels, both.b == labels.v).select("a", "root", F.lit(None).cast("long").alias("old"))
        own = labels.select(F.col("v").alias("a"), "root", F.col("root").alias("old"))
        moved = told.unionByName(own).groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near"), F.max("old").alias("old"))
        up = labels.select(F.col("v").alias("u"), F.col("root").alias("up"))
        jumped = moved.join(up, moved.near == up.u, "left").select("v", F.least("near", "up").alias("root"), "old")
        step = settle(jumped, name)
        changed = not step.where("old <> root").isEmpty()
        labels = step.select("v", "root")
        for old in held:
            drop(old)
        held = [step]
        if not changed:
            drop(both)
            return labels
