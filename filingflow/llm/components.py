"""Connected components of an edge table, as rounds of DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

ROUNDS = 60


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: the smallest node of the component of every node that has an edge.

    Each round takes the smallest label of a node and its neighbours, then the label of that label, so labels travel twice
    as far in every round. Labels are written to the shared folder each round; a node without edges has no row.
    """
    both = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).union(edges.select(F.col(b), F.col(a))).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    for _ in range(ROUNDS):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        later = low.join(jump, F.col("low") == F.col("_n"), "left")
        later = written(later.select("node", F.least("low", F.coalesce("_l", "low")).alias("label"), (F.least("low", F.coalesce("_l", "low")) != F.col("label")).alias("moved")), "labels")
        labels = later.select("node", "label")
        if not later.where("moved").take(1):
            return labels
    raise RuntimeError(f"labels still move after {ROUNDS} rounds")
