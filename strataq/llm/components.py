"""Connected components by alternating large-star and small-star steps.

Edges stay a distributed table of (u, v); every step writes it to the shared folder.
A node with very many neighbours is met by a partial aggregation (its least
neighbour) and by a join whose large partitions Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for each node of edges (u, v longs), label the least node of its component."""
    hi, lo = F.greatest("u", "v"), F.least("u", "v")
    now = materialize(edges.where("u != v").select(hi.alias("u"), lo.alias("v")).distinct(), "cc")
    mark = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: the larger neighbours of u point to the least of u and its neighbours
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours point to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        new = materialize(small, "cc")
        got = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(now)
        now = new
        if mark == tuple(got):
            break
        mark = tuple(got)
    else:
        raise RuntimeError("components did not settle")
    tops = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(tops.select("node", F.col("node").alias("label")))
