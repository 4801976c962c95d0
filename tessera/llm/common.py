"""Shared pieces of the training-data operators.

Conventions every operator here follows:

* only the columns it needs are selected first, so extra columns, whatever
  their names, neither crash nor leak into results;
* a null text is an empty text, a null doc_id is an ordinary row that belongs
  to no fold and loses every tie;
* lineage is cut with ``written()``: Parquet in the folder that the session
  names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.graphs import connected_components
from tessera.operators.lineage import checkpoint_dir, written

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "Recent", "checkpoint_dir", "connected_components", "documents", "fold", "held_out", "partitions_for", "tune", "without", "written"]


#: Rows and bytes of an Arrow batch, whichever is reached first: the same for all operators.
BATCH_ROWS, BATCH_BYTES = 1024, "8m"


def tune(spark: SparkSession) -> None:
    """Arrow batches small enough that two workers of long texts or of chunks fit an executor."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")


class Recent:
    """A worker's cache, bounded by bytes: entries of the last two generations. What missing()
    leaves in `now` stays there until it is called again."""

    def __init__(self, limit: int) -> None:
        self.limit, self.held = limit, 0
        self.now: dict = {}
        self.old: dict = {}

    def missing(self, keys: set) -> list[str]:
        """Those keys that are in neither generation; the others are in `now` afterwards."""
        if self.held > self.limit:
            self.old, self.now, self.held = self.now, {}, 0
        fresh = keys.difference(self.now)
        if self.old:
            known = [k for k in fresh if k in self.old]
            self.learn(known, [self.old[k] for k in known])
            fresh.difference_update(known)
        return list(fresh)

    def learn(self, keys: list[str], values: list) -> None:
        """Entries; values that are bytes count by their length."""
        self.now.update(zip(keys, values, strict=True))
        self.held += 160 * len(keys) + sum(map(len, keys)) + (sum(map(len, values)) if values and isinstance(values[0], bytes) else 0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo parts (null for a null id)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % parts


def held_out(doc_id: str | Column, parts: int, rest: int) -> Column:
    return F.coalesce(fold(doc_id, parts) == rest, F.lit(False))


#: Ids that are broadcast at most (some tens of MB); beyond, the rows are shuffled.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs less the rows whose doc_id is in dropped. Rows without an id stay: nothing names them."""
    dropped = written(dropped.select("doc_id").where("doc_id IS NOT NULL").distinct(), "dropped")
    return docs.join(F.broadcast(dropped) if dropped.count() <= BROADCAST_IDS else dropped, "doc_id", "left_anti").select(*docs.columns)


def partitions_for(rows: int, each: int) -> int:
    """As many partitions as keep about `each` rows in one, with no upper limit."""
    return max(1, -(-rows // each))
