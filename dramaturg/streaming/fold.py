"""A fold in keyed state over a stream of evidence."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dramaturg.sources.scratch import scratch_dir
from dramaturg.streaming.resume import source


def high_events(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, last = state.get if state.exists else (0, 0)
    for batch in batches:
        n += len(batch)
        last = max(last, int(batch["ep"].max()))
    state.update((n, last))
    yield pd.DataFrame({"character": [key[0]], "high": [n], "last_ep": [last]})


def folded(stream: DataFrame) -> DataFrame:
    """``character, high, last_ep`` so far, each time a character has new evidence."""
    return stream.groupBy("character").applyInPandasWithState(
        high_events, "character bigint, high bigint, last_ep int", "n bigint, last int", "update", GroupStateTimeout.NoTimeout
    )


def run_fold(spark: SparkSession, path: str) -> DataFrame:
    """The state after all files: the latest row of each character."""
    place = f"{scratch_dir(spark)}/fold-{uuid.uuid4().hex}"
    high = source(spark, path).filter("value >= 300").select(F.col("user_id").alias("character"), F.dayofmonth("ts").alias("ep"))

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    folded(high).writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema("character bigint, high bigint, last_ep int, batch int").parquet(f"{place}/out")
    return out.groupBy("character").agg(F.max("high").alias("high"), F.max("last_ep").alias("last_ep"))
