"""Connected components of a large edge table, as joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlytics.llm.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b longs); comp is the
    smallest node reachable.

    Each round every node takes the smallest label among its neighbours and
    then its label's label, so that chains halve.  Labels are written to the
    shared folder each round; hubs meet a partial aggregate and AQE's skew
    join, never one task.
    """
    both, _ = scratch.write(
        edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        .union(edges.select("b", "a")).where("u != v").distinct())
    labels, old = scratch.write(
        both.groupBy("u").agg(F.min("v").alias("m"))
        .select(F.col("u").alias("node"), F.least("u", "m").alias("comp"), F.lit(True).alias("moved")))
    while not labels.where("moved").isEmpty():
        near = (both.join(labels.select(F.col("node").alias("v"), "comp"), "v")
                .groupBy(F.col("u").alias("node")).agg(F.min("comp").alias("near")))
        hooked = labels.join(near, "node").select("node", F.col("comp").alias("old"),
                                                  F.least("comp", "near").alias("comp"))
        root = labels.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        jumped = (hooked.join(root, "comp")
                  .select("node", F.col("up").alias("comp"), (F.col("up") != F.col("old")).alias("moved")))
        labels, new = scratch.write(jumped)
        scratch.drop(old)
        old = new
    return labels.select("node", "comp")
