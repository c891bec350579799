"""Connected components by alternating star contraction, without any driver-side graph.

Each round is two joins on the node, each against a table with one row per
node, so a hub costs partial aggregation rather than a collected neighbour list;
the rows of hubs stay where they are and meet a broadcast of the few hubs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_join


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
    return hot_join(both, least, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` run from the larger node u to the smaller v."""
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    hooked = hot_join(edges, least, ["u"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hooked.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` to ``(node, root)`` for every node that has an edge; root is the component's least node.

    Self-loops, repeated and reversed edges are allowed; no edges give no rows.
    """
    ordered = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current = cut(ordered)
    seen = None
    for _ in range(rounds):
        current = cut(_small_star(cut(_large_star(current))))
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components have not converged in {rounds} rounds")
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
