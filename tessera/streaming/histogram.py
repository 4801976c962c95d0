"""An incremental colour histogram: bins merge, so a stream of pixels can keep one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def binned(px: DataFrame) -> DataFrame:
    """bin and weight of pixels; works alike on a batch and on a stream (update mode)."""
    key = F.shiftleft(F.shiftright("r", 2), 12) + F.shiftleft(F.shiftright("g", 2), 6) + F.shiftright("b", 2)
    return px.groupBy(key.alias("bin")).agg(F.count("*").alias("weight"))


def windowed(px: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """The histogram of each event-time window of pixels with a ts column; rows later than `late` are dropped."""
    key = F.shiftleft(F.shiftright("r", 2), 12) + F.shiftleft(F.shiftright("g", 2), 6) + F.shiftright("b", 2)
    return px.withWatermark("ts", late).groupBy(F.window("ts", size).alias("window"), key.alias("bin")).agg(F.count("*").alias("weight"))
