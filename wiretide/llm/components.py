"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wiretide.llm.common import cut


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.col("u").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["x"], row["s"]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node that can be reached. Nodes without an edge are absent.

    edges has two long columns u and v; nulls, loops and repeated edges are ignored. Each round joins every node with the
    least of its neighbours and is written to the checkpoint folder. The number of rounds grows with the logarithm of the
    number of nodes; nothing but a count and two sums comes to the driver. A node with many neighbours is one row of the
    small side of the join, and its neighbours are rows of the side that adaptive execution splits.
    """
    now = cut(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        last, state = state, _state(now)
        if state == last:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
