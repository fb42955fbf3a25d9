"""Time averages over an unbounded source: the batch average with a watermark."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from driftline.functions.times import bin_seconds
from driftline.operators.timebin import bin_means


def stream_time_average(df: DataFrame, every: str = "1 minute", late: str = "10 minutes",
                        by: Iterable[str] = (), time: str = "date", **options) -> DataFrame:
    """``time_average`` whose bins close once ``late`` has passed.

    The watermark bounds the state kept to the bins still open. Watermarks need a
    zoned instant, so the session time zone has to be UTC.
    """
    window = F.window("__event", f"{bin_seconds(every)} seconds")
    stamped = df.withColumn("__event", F.col(time).cast("timestamp")).withWatermark("__event", late)
    binned = stamped.withColumn("__window", window).drop(time, "__event")
    means = bin_means(binned, by, "__window", **options)
    return means.withColumn(time, F.col("__window.start").cast("timestamp_ntz")).drop("__window")
