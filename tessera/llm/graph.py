"""Connected components of an edge list by hooking and contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def follow(hooks: DataFrame) -> DataFrame:
    """hooks (src, dst) with dst the end of its chain; chains halve in each step."""
    while True:
        up = hooks.select(F.col("src").alias("dst"), F.col("dst").alias("top"))
        moved = checkpoint(hooks.join(up, "dst", "left").select("src", F.coalesce("top", "dst").alias("dst"), F.col("top").isNotNull().alias("moved")))
        if moved.where("moved").isEmpty():
            return hooks
        hooks = moved.select("src", "dst")


def merge(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, comp) after joining the components that edges (a, b) link; comp stays the smallest comp.

    Every end of an edge must be a node of labels. In each round every component hooks to its
    smallest neighbour, chains of hooks are followed to their ends, and edges inside a component
    fall away. Stars and paths need one or two rounds, any graph about the logarithm of its size.
    """
    a, b = labels.select(F.col("node").alias("a"), F.col("comp").alias("la")), labels.select(F.col("node").alias("b"), F.col("comp").alias("lb"))
    links = edges.select("a", "b").join(a, "a").join(b, "b").where(F.col("la") != F.col("lb"))
    links = checkpoint(links.select(F.least("la", "lb").alias("lo"), F.greatest("la", "lb").alias("hi")).distinct())
    while not links.isEmpty():
        hooks = follow(checkpoint(links.groupBy(F.col("hi").alias("src")).agg(F.min("lo").alias("dst"))))
        moves = hooks.select("src", "dst")
        labels = checkpoint(labels.join(moves, F.col("comp") == F.col("src"), "left").select("node", F.coalesce("dst", "comp").alias("comp")))
        lo, hi = hooks.select(F.col("src").alias("lo"), F.col("dst").alias("x")), hooks.select(F.col("src").alias("hi"), F.col("dst").alias("y"))
        moved = links.join(lo, "lo", "left").join(hi, "hi", "left").select(F.coalesce("x", "lo").alias("p"), F.coalesce("y", "hi").alias("q"))
        links = checkpoint(moved.where(F.col("p") != F.col("q")).select(F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi")).distinct())
    return labels
