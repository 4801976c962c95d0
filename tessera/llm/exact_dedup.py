"""Exact deduplication against immutable snapshots.

A snapshot is a table of exact entries, one per distinct normalised text, cut
into buckets by digest; each bucket carries a static three-wise binary-fuse
filter of 8-bit fingerprints. An incoming batch is first grouped by itself, one
row per distinct digest. Those digests meet the filter of their bucket; what
the filter rules out is new and touches nothing else. Positives join the exact
entries and the two texts are compared byte for byte.

Defined cases: null text is empty text; texts are equal when they agree after
each run of [\\x20\\x09-\\x0D] becomes one space; of equal texts the smallest
doc_id stays; rows that repeat a doc_id share its fate; null ids lose to any
other id; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, partitions_for, tune, written

#: Keys of one filter, so the memory of one screening group, are about this many.
KEYS_PER_BUCKET = 100_000
#: Ids whose texts are fetched by broadcast at most; beyond, by a shuffled join.
BROADCAST_IDS = 1_000_000


def normalised(text: str | Column = "text") -> Column:
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(col, F.lit("")), r"[\x20\x09-\x0D]+", " ")


# ---------------------------------------------------------------- filter ----
def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = keys + np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slots(h: np.ndarray, seg: int, count: int) -> np.ndarray:
    """Three slots of each hash in consecutive segments of length seg (a power of two)."""
    mask = np.uint64(seg - 1)
    start = ((h >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64) * seg
    a = start + (h & mask).astype(np.int64)
    b = start + seg + ((h >> np.uint64(18)) & mask).astype(np.int64)
    c = start + 2 * seg + ((h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) & mask).astype(np.int64)
    return np.stack([a, b, c])


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(37))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(56)).astype(np.uint8)


def fuse_build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segment starts, fingerprints) for distinct uint64 keys."""
    keys = np.unique(np.asarray(keys, dtype=np.uint64))
    n = len(keys)
    if not n:
        return 0, 4, 1, bytes(12)
    seg = 1 << max(2, int(np.log(max(n, 2)) / np.log(3.33) + 2.25))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 4)))
    for seed in range(1, 200):
        count = max(1, int(np.ceil(n * factor * (1 + seed // 20 * 0.1) / seg)))
        h = _mix(keys, seed)
        at = _slots(h, seg, count)
        size = (count + 2) * seg
        degree = np.bincount(at.ravel(), minlength=size)
        held = np.zeros(size, np.int64)
        for row in at:
            np.bitwise_xor.at(held, row, np.arange(n))
        rounds, frontier, done = [], np.flatnonzero(degree == 1), 0
        while len(frontier):
            key, first = np.unique(held[frontier], return_index=True)
            rounds.append((key, frontier[first]))
            done += len(key)
            touched = at[:, key].ravel()
            np.subtract.at(degree, touched, 1)
            np.bitwise_xor.at(held, touched, np.tile(key, 3))
            touched = np.unique(touched)
            frontier = touched[degree[touched] == 1]
        if done < n:
            continue
        table, want = np.zeros(size, np.uint8), _prints(h)
        for key, slot in reversed(rounds):
            a, b, c = at[:, key]
            table[slot] = 0
            table[slot] = want[key] ^ table[a] ^ table[b] ^ table[c]
        return seed, seg, count, table.tobytes()
    raise RuntimeError("no seed peels this key set")


def fuse_has(filter_: tuple[int, int, int, bytes], keys: np.ndarray) -> np.ndarray:
    """No false negatives; false positives about one in 256."""
    seed, seg, count, raw = filter_
    table = np.frombuffer(raw, np.uint8)
    h = _mix(np.asarray(keys, dtype=np.uint64), seed)
    a, b, c = _slots(h, seg, count)
    return (table[a] ^ table[b] ^ table[c]) == _prints(h)


# -------------------------------------------------------------- snapshot ----
@dataclass
class Snapshot:
    """entries: sha, h64, bucket, keep_id, n; filters: bucket, seed, seg, starts, prints."""

    entries: DataFrame
    filters: DataFrame
    buckets: int


def distinct_texts(rows: DataFrame) -> DataFrame:
    """One row per digest of rows (doc_id, sha, h64); aggregated map-side first."""
    return rows.groupBy("sha").agg(F.first("h64").alias("h64"), F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))


def bucket_of(h64: str, buckets: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h64, 17), F.lit(buckets)).cast("int")


def build_snapshot(rows: DataFrame, incoming: int = 0) -> Snapshot:
    """An immutable snapshot of rows (doc_id, sha, h64), with as many buckets as keep both its
    own digests and those of a batch of `incoming` to KEYS_PER_BUCKET in one."""
    entries = written(distinct_texts(rows), "snapshot")
    buckets = partitions_for(max(entries.count(), incoming), KEYS_PER_BUCKET)
    entries = entries.withColumn("bucket", bucket_of("h64", buckets))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        seed, seg, starts, prints = fuse_build(part["h64"].to_numpy().view(np.uint64))
        return pd.DataFrame({"bucket": [part["bucket"].iloc[0]], "seed": [seed], "seg": [seg], "starts": [starts], "prints": [prints]})

    filters = entries.select("bucket", "h64").groupBy("bucket").applyInPandas(build, "bucket int, seed int, seg int, starts int, prints binary")
    return Snapshot(entries, written(filters, "filters"), buckets)


def screen(snapshot: Snapshot, incoming: DataFrame) -> DataFrame:
    """Rows of incoming (sha, h64, keep_id, n) that the filters cannot rule out."""
    keyed = incoming.withColumn("bucket", bucket_of("h64", snapshot.buckets))

    def probe(part: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        if part.empty or filters.empty:
            return part.iloc[:0]
        f = filters.iloc[0]
        return part[fuse_has((f["seed"], f["seg"], f["starts"], f["prints"]), part["h64"].to_numpy().view(np.uint64))]

    return keyed.groupBy("bucket").cogroup(snapshot.filters.groupBy("bucket")).applyInPandas(probe, keyed.schema)


def same_bytes(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those pairs (sha, old_id, new_id, ...) whose two normalised texts are equal bytes.
    A side without an id has no text to fetch; there the SHA-256 decides."""
    nameless = pairs.where("old_id IS NULL OR new_id IS NULL")
    ids = pairs.select(F.explode(F.array("old_id", "new_id")).alias("doc_id")).distinct()
    ids = F.broadcast(ids) if pairs.count() * 2 <= BROADCAST_IDS else ids
    texts = docs.select("doc_id", normalised().alias("t")).join(ids, "doc_id")
    old, new = texts.select(F.col("doc_id").alias("old_id"), F.col("t").alias("t1")), texts.select(F.col("doc_id").alias("new_id"), F.col("t").alias("t2"))
    return pairs.join(old, "old_id").join(new, "new_id").where(F.col("t1").cast("binary") == F.col("t2").cast("binary")).select(*pairs.columns).distinct().union(nameless)


def exact_dedup(docs: DataFrame, split_at: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    Ids below split_at (by default about their median) make the snapshot, the others
    arrive as a batch, so both paths carry real load.
    """
    tune(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    if split_at is None:
        split_at = docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0] or 0
    text = normalised()
    rows = docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("sha"), F.xxhash64(text).alias("h64"), F.when(F.col("doc_id") < split_at, 0).otherwise(1).alias("batch"))
    rows = written(rows, "digests")
    incoming = written(distinct_texts(rows.where("batch = 1")), "incoming")
    snapshot = build_snapshot(rows.where("batch = 0"), incoming.count())
    positive = screen(snapshot, incoming)
    old = snapshot.entries.select("sha", F.col("keep_id").alias("old_id"), F.col("n").alias("old_n"))
    pairs = written(positive.select("sha", F.col("keep_id").alias("new_id"), F.col("n").alias("new_n")).join(old, "sha"), "pairs")
    equal = written(same_bytes(pairs, docs).select("sha", F.least("old_id", "new_id").alias("keep"), (F.col("old_n") + F.col("new_n")).alias("total")), "equal")
    sides = snapshot.entries.select("sha", F.lit(0).alias("batch"), "keep_id", "n").union(incoming.select("sha", F.lit(1).alias("batch"), "keep_id", "n"))
    classes = sides.join(equal, "sha", "left").select("sha", "batch", F.coalesce("keep", "keep_id").alias("keep_id"), F.coalesce("total", "n").alias("group_size"))
    return rows.join(classes, ["sha", "batch"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
