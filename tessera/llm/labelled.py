"""Bounded samples of labelled rows for the two classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fold


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, rest: int, rows: int) -> DataFrame:
    """(doc_id, text, y) of about `rows` labelled documents at most, drawn by a hash of
    their id, outside the fold crc32(doc_id) mod parts = rest. Labels that are null
    don't count; of several labels for one id the larger counts."""
    known = labels.select("doc_id", F.col(label).alias("y")).where("y IS NOT NULL AND doc_id IS NOT NULL").where(fold("doc_id", parts) != rest)
    every = max(1, -(-known.count() // rows))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    # about `rows` ids of 12 bytes: its size is bounded by the parameter
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
