"""Connected components of a graph given as links, by repeated contraction.

Each round points every node at the smallest of itself and its neighbours, replaces the links' ends by what they point
at and drops loops and repeats. At least half of the nodes of a component vanish per round, so the number of rounds
is the logarithm of the largest component. Links and labels stay distributed; each round's tables are written out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.storage import stored


def components(links: DataFrame) -> DataFrame:
    """`node` and `label`, the smallest node it reaches, for every node of `links` (long columns `a`, `b`)."""
    edges = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while True:
        if labels is not None and edges.isEmpty():
            return labels
        ends = edges.select("a", "b").unionAll(edges.select("b", "a"))
        points = stored(ends.groupBy(F.col("a").alias("at")).agg(F.least(F.min("b"), F.col("at")).alias("to")), "points")
        if labels is None:
            labels = points.select(F.col("at").alias("node"), F.col("to").alias("label"))
        else:
            moved = labels.join(points, F.col("label") == F.col("at"), "left")
            labels = stored(moved.select("node", F.coalesce("to", "label").alias("label")), "labels")
        first = edges.join(points, F.col("a") == F.col("at")).select(F.col("to").alias("a"), "b")
        both = first.join(points, F.col("b") == F.col("at")).select("a", F.col("to").alias("b")).where("a <> b")
        edges = stored(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
