"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from curascore.llm.base import stored


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; the root is the smallest node of the component.

    Each round takes the smallest label among a node and its neighbours, then jumps to the label of that label, so
    the rounds grow with the logarithm of a component's diameter. Labels are written once per round; only the count
    of changed labels comes to the driver. Links of nulls are ignored; no links give no rows.
    """
    links = links.where("a <> b")
    edges = stored(links.union(links.select("b", "a")).distinct().toDF("a", "b"), "edges")
    labels = (edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")))
    for _ in range(max_rounds):
        near = edges.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("root").alias("low"))
        hooked = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "low").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("far"))
        after = hooked.join(jump, "low", "left").select("node", "was", F.least("low", "far").alias("root"))
        moved = Observation()
        labels = stored(after.observe(moved, F.count_if(F.col("root") != F.col("was")).alias("n")).select("node", "root"), "labels")
        if not moved.get["n"]:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
