"""An extension: daily bars of a stream of priced events, with late rows up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(events: DataFrame, late: str = "2 days", key: str = "user_id") -> DataFrame:
    """(key, date, open, high, low, close, n) once the watermark has passed a day; state holds one row for each key and open day."""
    day = F.window("ts", "1 day")
    out = events.withWatermark("ts", late).groupBy(F.col(key), day.alias("day")).agg(
        F.min_by("value", F.struct("ts", "event_id")).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", F.struct("ts", "event_id")).alias("close"), F.count("*").alias("n")
    )
    return out.withColumn("date", F.col("day.start").cast("date")).drop("day")
