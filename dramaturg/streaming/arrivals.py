"""Tables that arrive in parts, and streams over them that stop and go on from their checkpoint."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dramaturg.sources.scratch import scratch_dir

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in a store that can hold several variables and timers a key."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class Arrivals:
    """A folder into which the parts of a table come one after the other, and streams over it.

    With ``files`` a part is that many files, so that a stream of limited triggers has as many of them
    whatever the size of the table: each trigger has its price for all keys that it touches.
    """

    def __init__(self, rows: DataFrame, part: Column, parts: int, name: str, last: DataFrame | None = None, files: int | None = None):
        self.rows, self.part, self.parts, self.last, self.files = rows, part, parts, last, files
        self.spark = rows.sparkSession
        self.place = f"{scratch_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        self.progress: list = []

    def come(self, k: int) -> None:
        # a part may be several files, which have no order among each other
        rows = self.rows.filter(self.part == k) if k < self.parts else self.last
        (rows.repartition(self.files) if self.files and k < self.parts else rows).write.parquet(f"{self.place}/in/part-{k}")

    def stream(self, files_per_trigger: int | None = None) -> DataFrame:
        reader = self.spark.readStream.schema(self.rows.schema).option("recursiveFileLookup", "true")
        return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(f"{self.place}/in")

    def process(self, make: Callable[[DataFrame], DataFrame], files_per_trigger: int | None = None) -> None:
        """All that has come and isn't done yet; stops at its end, the checkpoint stays for the next call."""
        out = make(self.stream(files_per_trigger))
        with keyed_state(self.spark):
            query = out.writeStream.format("parquet").option("path", f"{self.place}/out").option("checkpointLocation", f"{self.place}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
        self.progress += query.recentProgress

    def run(self, make: Callable[[DataFrame], DataFrame], restart: bool = True, files_per_trigger: int | None = None) -> DataFrame:
        """What the stream has written in the end. With ``restart`` it stops after each part and starts anew for the next."""
        parts = self.parts + (self.last is not None)
        for k in range(parts):
            self.come(k)
            if restart or k == parts - 1:
                self.process(make, files_per_trigger)
        return self.spark.read.schema(make(self.stream()).schema).parquet(f"{self.place}/out")


def ending(rows: DataFrame, time: str, end: Column, **values: object) -> DataFrame:
    """One more row for ``rows`` (none if they are empty): it says that time has come to ``end``, so that all before is decided.

    ``values`` are its other columns. Keys should be given one that no row has: a null among whole
    numbers makes all keys of its batch fractions in pandas.
    """
    own = rows.agg(end.alias(time)).filter(F.col(time).isNotNull())
    given = {c: F.lit(values.get(c)).cast(rows.schema[c].dataType) for c in rows.columns if c != time}
    return own.withColumns(given).select(rows.columns)


def by_time(rows: DataFrame, time: str, parts: int) -> Column:
    """The part of a row if the table's span of time is cut into ``parts`` equal pieces."""
    low, high = (int(x.timestamp()) if x else 0 for x in rows.agg(F.min(time), F.max(time)).first())
    width = max(1, -(-(high + 1 - low) // parts))
    return F.least(F.floor((F.unix_timestamp(time) - low) / width), F.lit(parts - 1))
