"""Group-by aggregation of an unbounded input: the same specs, by event-time window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import Spec, expressions


def window_agg(stream: DataFrame, time: str, width: str, by: Sequence[str], aggs: Sequence[Spec], late: str = "10 minutes") -> DataFrame:
    """Aggregates per window and key of a batch or stream; rows later than ``late`` are dropped from a stream."""
    if stream.isStreaming:
        stream = stream.withWatermark(time, late)
    out = stream.groupBy(F.window(time, width).alias("w"), *by).agg(*expressions(stream, aggs))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, *[a[0] for a in aggs])
