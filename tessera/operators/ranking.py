"""A global order without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.lineage import written


def ranked(df: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """df with each row's place (from 1) in the order given, which has to be total: ranges are sorted each
    by itself, and the sizes of the ranges before are added. Only a row for each range meets the others."""
    at = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    at = written(at, "ranked")
    size = at.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("n"))
    ahead = size.select("_range", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("_ahead"))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return at.withColumn("_range", F.shiftright("_at", 33)).join(F.broadcast(ahead), "_range").withColumn(name, (F.col("_ahead") + within + 1).cast("long")).drop("_range", "_at", "_ahead")
