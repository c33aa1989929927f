"""Connected components over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import dropped, written_at


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Connected components of an undirected graph.

    edges: two bigint columns (a, b). Returns (node, label) for each node of an edge; label is the least node of
    its component. Each round takes the least label among neighbours, then jumps from a label to that label's own;
    every round's table is written to the shared folder, so lineage stays short, and dropped when the next ones are. A
    hub's or a large component's rows are on one side only of each join, which adaptive execution splits. An empty input
    gives an empty result.
    """
    spark = edges.sparkSession
    a, b = edges.columns
    one = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both, kept = written_at(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels, at = written_at(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("l"))
        lower, low = written_at(lower, "lower")
        jump = lower.select(F.col("node").alias("l"), F.col("l").alias("far"))
        after, now = written_at(lower.join(jump, "l", "left").select("node", F.least("l", F.coalesce("far", "l")).alias("label"), "was"), "labels")
        settled = after.where("label <> was").isEmpty()
        labels = after.select("node", "label")
        dropped(spark, at, low)
        at = now
        if settled:
            dropped(spark, kept)
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
