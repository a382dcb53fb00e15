"""Connected components of links between long node ids, on executors only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import discard, stored


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, label), label the smallest node reachable; nodes without links don't appear.

    In each round an end of a link whose label is the larger takes the other's, and so does the node which that larger
    label names, so that whole trees move at once; then each takes the label of its label. That ends after about as
    many rounds as the logarithm of the longest path. Rounds are written to the shared folder, so that a lost executor
    repeats one round at most.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(both.where("a <> b").distinct(), "edges")
    labels = stored(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        far = labels.select(F.col("node").alias("b"), F.col("label").alias("low"))
        own = labels.select(F.col("node").alias("a"), F.col("label").alias("high"))
        seen = edges.join(far, "b").join(own, "a").where("low < high")
        hooks = seen.select(F.explode(F.array("a", "high")).alias("of"), "low").groupBy("of").agg(F.min("low").alias("low"))
        hooked = labels.join(hooks, labels.node == hooks["of"], "left").select("node", F.col("label").alias("was"), F.least("label", "low").alias("label"))
        # the label of a label: labels are nodes themselves
        up = hooked.select(F.col("node").alias("of"), F.col("label").alias("above"))
        jumped = hooked.join(up, hooked.label == up["of"], "left").select("node", "was", F.least("label", "above").alias("label"))
        after = stored(jumped, "labels")
        moved = after.where("was <> label").limit(1).count()
        discard(labels)
        if not moved:
            discard(edges)
            return after.select("node", "label")
        labels = after.select("node", "label")
        labels._quillon_path = after._quillon_path
