"""The folder for written intermediate results."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, shared by all executors; a temporary folder only in local runs."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("dramaturg.scratch.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = tempfile.mkdtemp(prefix="spark-dramaturg-", dir="/tmp")
        spark.conf.set("dramaturg.scratch.dir", place)
    return place.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget how it was made."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(scratch_dir(df.sparkSession))
    return df.checkpoint(eager=True)
