"""Connected components of a table of links, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import materialize


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links (a, b): component is the smallest node that it reaches.

    Each round every node takes the least label around it, then the label of its
    label (labels are nodes), so chains shorten by doubling. Rounds are written to the
    shared folder. Only the number of changes reaches the driver. Nulls link nothing;
    an empty table gives an empty one. Sums and joins on a hub's label combine or
    split by rows, as labels are looked up by plain equi-joins.
    """
    edges = links.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b")
    both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    for _ in range(most_rounds):
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("around"))
        near = labels.join(around, labels["node"] == around["a"], "left").select("node", F.col("label").alias("old"), F.least("label", "around").alias("near"))
        up = labels.select(F.col("node").alias("near"), F.col("label").alias("up"))
        moved = materialize(near.join(up, "near", "left").select("node", "old", F.coalesce(F.least("near", "up"), "near").alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.where("label <> old").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return labels.select("node", F.col("label").alias("component"))
