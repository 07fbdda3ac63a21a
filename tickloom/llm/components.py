"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links (a, b)``; nodes have one label exactly if links connect them.

    In each round every node moves to the neighbour, or stays, whichever has the smallest hash; links follow
    their ends, and those that meet go. A fixed random order of the nodes makes the rounds few: a star takes
    two, a path about the logarithm of its length. Only the emptiness of a table comes to the driver.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("node"))
    edges = links.select("a", "b").where("a <> b")
    steps: list[DataFrame] = []
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moved = both.groupBy("a").agg(F.min(rank("b")).alias("least"))
        moved = moved.select(F.col("a").alias("node"), F.least(F.col("least"), rank("a"))["node"].alias("label"))
        step = saved(moved, "component-step")
        steps.append(step)
        ends = edges.join(step.select(F.col("node").alias("a"), F.col("label").alias("to_a")), "a")
        ends = ends.join(step.select(F.col("node").alias("b"), F.col("label").alias("to_b")), "b")
        ends = ends.where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        edges = saved(ends.distinct(), "component-links")
        if edges.isEmpty():
            break
    labels = steps[0]
    for step in steps[1:]:
        later = step.select(F.col("node").alias("label"), F.col("label").alias("then"))
        labels = labels.join(later, "label", "left").select("node", F.coalesce("then", "label").alias("label"))
    return labels
