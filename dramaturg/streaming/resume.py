"""Incremental runs over a folder or file of Parquet: what is done already is skipped."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dramaturg.sources.scratch import scratch_dir


def source(spark: SparkSession, path: str) -> DataFrame:
    """A file stream with the schema of the table as it is now; the path may be one file or a folder."""
    schema = spark.read.parquet(path).schema
    parent, _, name = path.rstrip("/").rpartition("/")
    # a single file or a folder of part files: either is matched as a glob, so the stream can list it
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{parent}/{name[:-1]}[{name[-1]}]")


def run_resume(spark: SparkSession, path: str, done: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose id isn't done, written once each by an available-now stream with a checkpoint."""
    place = f"{scratch_dir(spark)}/resume-{uuid.uuid4().hex}"

    def save(batch: DataFrame, number: int) -> None:
        # the batch's own folder makes a repeated batch overwrite itself
        batch.join(done, columns[0], "left_anti").select(columns).distinct().write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    stream = source(spark, path).select(columns)
    stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema.add("batch", "integer")).parquet(f"{place}/out").select(columns).distinct()

