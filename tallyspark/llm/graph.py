"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import checkpoints


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of every vertex of edges (a, b): the least vertex that it is connected with.

    Each round takes the least label among a vertex's neighbours, then the label of its
    label, so long paths shorten by halves; it ends when a round changes nothing.
    """
    checkpoints(edges.sparkSession)
    edges = edges.select("a", "b").where("a <> b")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("root")).checkpoint()
    while True:
        near = both.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("root").alias("m"))
        step = labels.join(near, F.col("v") == F.col("a")).select("v", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        jump = step.select(F.col("v").alias("r"), F.col("root").alias("far"))
        new = step.join(jump, F.col("root") == F.col("r"), "left").select("v", "old", F.least("root", "far").alias("root")).checkpoint()
        labels = new.select("v", "root")
        if new.where("old <> root").isEmpty():
            return labels
