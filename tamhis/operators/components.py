"""Connected components of an undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamhis.session import pin


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(id, component)`` where the component is its smallest id.

    Each round takes the smallest label among the neighbours, combined before the shuffle, then follows the
    label one step on, which halves the remaining distance. Labels are checkpointed every round, so lineage
    stays short and a lost executor costs one round.
    """
    both = pin(
        edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).where("src <> dst").distinct()
    )
    labels = nodes.select("id", F.col("id").alias("label"))
    for _ in range(max_rounds):
        seen = both.join(labels.select(F.col("id").alias("dst"), "label"), "dst")
        lowest = seen.groupBy(F.col("src").alias("id")).agg(F.min("label").alias("lowest"))
        stepped = labels.join(lowest, "id", "left").select(
            "id", F.col("label").alias("before"), F.least("label", "lowest").alias("label")
        )
        jump = stepped.select(F.col("id").alias("label"), F.col("label").alias("next"))
        moved = pin(
            stepped.join(jump, "label").select("id", F.col("next").alias("label"), (F.col("next") != F.col("before")).alias("moved"))
        )
        labels = moved.select("id", "label")
        if moved.where("moved").isEmpty():
            return labels.select("id", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
