"""Event-time windows, sessions and repeated rows under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counted(stream: DataFrame, by: str, time: str, width: str, late: str) -> DataFrame:
    """Rows by ``by`` and window of time, written once the watermark has passed the window; later rows are dropped."""
    rows = stream.withWatermark(time, late).groupBy(by, F.window(time, width).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(by, "w.start", "w.end", "n")


def sessions(stream: DataFrame, by: str, time: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Scene-like sessions: start, end (a gap after the last row) and size of each run without a longer gap."""
    return stream.withWatermark(time, late).groupBy(by, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(by, "w.start", "w.end", "n")


def deduplicated(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """One row a key within the watermark; rows behind the watermark are dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
