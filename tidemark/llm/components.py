"""Connected components of a graph given by its edges, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._arrow import keep


def _state(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of an edge (u, v), the smallest node that it is connected with.

    Large and small stars in turn: every node's neighbours are tied to the smallest of them, until nothing changes, which
    takes about the logarithm of the number of nodes in rounds.  Minima are taken by aggregation before rows meet.
    Loops and repeated edges do no harm; an empty frame gives an empty frame.
    """
    edges = keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # all edges now lead from a larger node to a smaller one
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(lowest.select("u", F.col("m").alias("v"))).distinct()
        edges, before = keep(small), state
        state = _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").union(roots)
