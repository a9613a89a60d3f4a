"""Deterministic samples, quotas and weights; hashes stand for seeded shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dramaturg.operators.dialogue import hash_order


def stratified(rows: DataFrame, stratum: str, key: str, quota: int) -> DataFrame:
    """The first ``quota`` rows of each stratum in hash order."""
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(hash_order(key), key))
    return rows.withColumn("place", rank).filter(F.col("place") <= quota)


def proportional_quotas(counts: DataFrame, group: str, n: str, total: int) -> DataFrame:
    """At least one row a group, ``total`` in all, as near to proportion as whole numbers allow.

    ``counts`` has one row a group. Fractions are rounded down; the largest remainders get one more.
    Sums over groups are scalars; the remainders that get one more are the first by a limit.
    """
    share = F.col(n) * F.lit(total) / counts.agg(F.sum(n)).scalar()
    floors = counts.withColumn("_share", share).withColumns({"_floor": F.greatest(F.floor("_share"), F.lit(1)), "_rest": F.col("_share") - F.floor("_share")})
    spare = total - (floors.agg(F.sum("_floor").alias("f")).first()["f"] or 0)
    lucky = floors.orderBy(F.desc("_rest"), group).limit(max(spare, 0)).select(group, F.lit(1).alias("_more"))
    return floors.join(lucky, group, "left").withColumn("quota", F.least(F.col(n), F.col("_floor") + F.coalesce("_more", F.lit(0)))).select(group, n, "quota")


def mixture_weights(counts: DataFrame, group: str, n: str, floor: float = 0.1) -> DataFrame:
    """Uniform, size, root and inverse weights, none below ``floor`` of the largest; each adds to 1."""
    names = {"uniform": F.lit(1.0), "size": F.col(n).cast("double"), "root": F.sqrt(n), "inverse": 1.0 / F.col(n)}
    raw = counts.select(group, *[w.alias(name) for name, w in names.items()])
    raised = raw.select(group, *[F.round(F.greatest(F.col(c), F.lit(floor) * raw.agg(F.max(c)).scalar()), 9).alias(c) for c in names])
    return raised.select(group, *[F.round(F.col(c) / raised.agg(F.sum(c)).scalar(), 6).alias(c) for c in names])


def round_robin(rows: DataFrame, key: str, shards: int) -> DataFrame:
    """A shard for each row by its key's hash; no global order is needed."""
    return rows.withColumn("shard", F.pmod(F.conv(F.substring(hash_order(key), 1, 8), 16, 10).cast("bigint"), F.lit(shards)).cast("int"))
