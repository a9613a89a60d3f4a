"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")



def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as evidence: character, day as episode, significance by value (from 300 high, from 100 medium)."""
    e = read(spark, sf_dir, "events")
    level = F.when(F.col("value") >= 300, "high").when(F.col("value") >= 100, "medium").otherwise("low")
    return e.select("event_id", F.col("user_id").alias("character"), F.dayofmonth("ts").alias("ep"), "event_type", "value", level.alias("significance"))


EVIDENCE_SQL = """ev AS (
  SELECT event_id, user_id AS "character", CAST(day(ts) AS INT) AS ep, event_type, value,
    CASE WHEN value >= 300 THEN 'high' WHEN value >= 100 THEN 'medium' ELSE 'low' END AS significance FROM events
)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scores: method, split, role, question, score."""
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(
        F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("split"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_quantity").alias("score"), "l_extendedprice", "l_shipdate",
    )
