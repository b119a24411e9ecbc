"""Connected components by min-label propagation with pointer jumping, all on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import materialise, release


def components(links: DataFrame) -> DataFrame:
    """node, label (the least node reachable) for every node of links (a, b).

    Labels only travel as minima, so a node with many links is pre-aggregated before the
    shuffle.  Each round is written to the shared folder; self-links are allowed.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")).distinct()
    both = materialise(both, "links")
    nodes = both.groupBy("node").agg(F.min("other").alias("other"))
    label = materialise(nodes.select("node", F.least("node", "other").alias("label")), "labels")
    written = label
    while True:
        seen = label.select(F.col("node").alias("other"), F.col("label").alias("offered"))
        near = both.join(seen, "other").groupBy("node").agg(F.min("offered").alias("offered"))
        # written, so that the join with the labels' own labels can be split at a hot label
        step = materialise(label.join(near, "node", "left").select("node", F.least("label", "offered").alias("next"), "label"), "steps")
        root = step.select(F.col("node").alias("next"), F.col("next").alias("jump"))
        jumped = step.join(root, "next", "left").select("node", F.least("next", "jump").alias("label"), (F.least("next", "jump") != F.col("label")).alias("moved"))
        before, written = written, materialise(jumped, "labels")
        release(before, step)
        label = written.select("node", "label")
        if written.where("moved").isEmpty():
            release(both)
            label._tidemark_path = written._tidemark_path
            return label
