"""Connected components of a table of links, by hooking and pointer jumping in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlake.llm.common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for each end of a link (a, b); component is the smallest node reachable. Each round
    gives a node the smallest label near it, then the label of its label, so rounds grow as the logarithm
    of the longest path. Labels are written each round; links stay where they are."""
    both = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("before"))
        # A root learns what its members have seen, so whole trees hook at once.
        roots = hooked.groupBy(F.col("before").alias("root")).agg(F.min("component").alias("seen"))
        lower = hooked.join(roots, hooked["before"] == roots["root"]).select("node", F.col("seen").alias("component"), "before")
        lower = stored(lower, "labels")
        jump = lower.select(F.col("node").alias("at"), F.col("component").alias("further"))
        after = stored(
            lower.join(jump, lower["component"] == jump["at"]).select("node", F.least("component", "further").alias("component"), (F.least("component", "further") < F.col("before")).alias("moved")),
            "labels",
        )
        moved = after.where("moved").limit(1).count()
        labels = after.drop("moved")
        if not moved:
            return labels
