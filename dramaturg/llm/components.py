"""Connected components over a distributed edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dramaturg.llm._shared import cut


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, label`` for every node of ``edges`` (``a``, ``b``): the smallest node it reaches.

    Each half-round takes a minimum per node (combined on the map side) and one equi-join, whose
    hot nodes adaptive execution can split; the edge table is cut into the shared folder after
    each round. Ends when a round changes nothing; the number of rounds is logarithmic.
    """
    e = cut(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).filter("u <> v").distinct())
    before = None
    for _ in range(rounds):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionAll(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = cut(
            small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
