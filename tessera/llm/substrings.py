"""Substring dedup by fixed-block anchors.

A window is WINDOW words of one document; it repeats if its words also start in
a document with a smaller doc_id. Any window of 13 words holds a whole block of 7
that starts at a multiple of 7 in its document. So the reference index holds
non-overlapping blocks only, and every document probes it with every rolling
run of 7 words.

1. Each chunk of documents deals the hashes of its blocks and of its rolling
   runs into buckets; a bucket tells each chunk which of its runs hit a block
   of a smaller document, and which of its blocks were hit by a larger one.
2. Hits are extended: the windows around a hit, on both sides, are compared by
   96-bit digests of their words, again in buckets, where only the
   smallest document of each window matters; a chunk learns which of its windows
   stand in smaller documents elsewhere. Neighbouring windows join into maximal
   exact repeats. Answers are bits in the order of the questions, which a chunk
   works out again.
3. Words in repeats are removed.

All questions are asked once for each chunk and distinct run or window, so a passage that
a third of all documents share costs a row per chunk, not pairs of documents.

Defined cases: null text has no words; texts of fewer than 13 words lose
nothing; rows that repeat a doc_id are the same document, so they don't shadow
each other; a null doc_id ranks behind all others; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.chunks import chunk_store, expand, squash, unpack_lines
from tessera.llm.common import documents, partitions_for, tune, written

WINDOW = 13
BLOCK = (WINDOW + 1) // 2  # the longest block that every window holds wherever it starts
LAST = np.int64(2**63 - 1)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MUL2 = np.uint64(0xC2B2AE3D27D4EB4F)


class Words:
    """The words of a chunk: a document index, a place and two hashes for each."""

    def __init__(self, ids: list, lines: list[bytes]) -> None:
        import xxhash

        split = [x.split(b" ") if x else [] for x in lines]
        self.sizes = np.fromiter(map(len, split), np.int64, len(split))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ids = np.array([LAST if i is None else i for i in ids], np.int64)
        self.lines = split
        distinct = list(set().union(*split)) if split else []
        wide = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, distinct)), "<u8").reshape(-1, 2) if distinct else np.zeros((0, 2), np.uint64)
        place = dict(zip(distinct, range(len(distinct)), strict=True))
        at = np.fromiter((i for w in split for i in map(place.__getitem__, w)), np.int64, int(self.sizes.sum()))
        self.hash, self.hash2 = wide[at, 0], wide[at, 1]
        self.doc = np.repeat(np.arange(len(split)), self.sizes)
        self.place = np.arange(len(at)) - self.starts[self.doc]

    def runs(self, k: int) -> np.ndarray:
        """Where runs of k words of one document start, as indices of words."""
        return np.flatnonzero(self.place + k <= self.sizes[self.doc])


def rolling(hashes: np.ndarray, k: int, mul: np.uint64) -> np.ndarray:
    """A hash of each run of k consecutive hashes (those that cross a border are not used)."""
    n = len(hashes) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(k if n > 0 else 0):
        out = out * mul + hashes[j : j + n]
        out ^= out >> np.uint64(29)
    return out


def planes(values: np.ndarray) -> bytes:
    """64-bit values compressed with their byte planes apart."""
    return squash(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unplanes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(expand(blob), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted uint64 as compressed differences."""
    return planes(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unplanes(blob), dtype=np.uint64)


def pack_bits(flags: np.ndarray) -> bytes:
    return squash(np.packbits(flags).tobytes())


def unpack_bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(expand(blob), np.uint8), count=n).astype(bool)


def dealt(values: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """(bucket, slice) of sorted uint64 values: ranges of equal width."""
    if not len(values):
        return
    which = values // np.uint64(min((1 << 64) // buckets + 1, (1 << 64) - 1))
    edges = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(which)], strict=True):
        yield int(which[a]), slice(a, b)


def least_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, least value of each)."""
    order = np.lexsort((values, keys))
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], values[first]


SPARE_BITS = 12


def travelling_bits(size: int) -> int:
    """Leading bits of a run's hash that travel: so many that about one run in 2**SPARE_BITS
    meets a block by chance, whatever the size of the corpus in bytes. Step 2 is exact."""
    return min(64, max(24, int(np.ceil(np.log2(size / 6 + 2)))) + SPARE_BITS)


class Anchors:
    """Runs of BLOCK words of a chunk: distinct hashes, and those of the aligned blocks."""

    def __init__(self, w: Words, bits: int) -> None:
        drop = np.uint64(64 - bits)
        self.at = w.runs(BLOCK)
        h = (rolling(w.hash, BLOCK, _MUL)[self.at] >> drop) << drop
        self.keys, self.index = np.unique(h, return_inverse=True)
        self.aligned = w.place[self.at] % BLOCK == 0
        self.blocks, self.low = least_by(h[self.aligned], w.ids[w.doc[self.at[self.aligned]]])
        self.block_index = np.searchsorted(self.blocks, h[self.aligned])
        # what the chunk can tell by itself: a block and a run of it in two of its own documents
        doc = w.ids[w.doc[self.at]]
        high = np.full(len(self.keys), np.iinfo(np.int64).min)
        np.maximum.at(high, self.index, doc)
        place = np.searchsorted(self.keys, self.blocks)
        least = np.full(len(self.keys), LAST)
        least[place] = self.low
        self.local = least[self.index] < doc
        self.local[self.aligned] |= high[place][self.block_index] > doc[self.aligned]

    def marked(self, w: Words, answers: list, buckets: int) -> np.ndarray:
        """Words where a run starts that hit a block, or a block that was hit."""
        hit, used = np.zeros(len(self.keys), bool), np.zeros(len(self.blocks), bool)
        runs, own = dict(dealt(self.keys, buckets)), dict(dealt(self.blocks, buckets))
        for one in answers or []:
            b = one["bucket"]
            hit[runs[b]] = unpack_bits(one["hit"], runs[b].stop - runs[b].start)
            if b in own:
                used[own[b]] = unpack_bits(one["used"], own[b].stop - own[b].start)
        found = hit[self.index] | self.local
        found[self.aligned] |= used[self.block_index]
        out = np.zeros(len(w.hash) + 1, np.int64)
        out[self.at[found]] = 1
        return out


class Windows:
    """Windows of a chunk that hold a marked run: distinct digests with their least document."""

    def __init__(self, w: Words, marked: np.ndarray) -> None:
        before = np.r_[0, np.cumsum(marked)]
        start = w.runs(WINDOW)
        self.start = start = start[before[start + WINDOW - BLOCK + 1] > before[start]]
        h, h2 = rolling(w.hash, WINDOW, _MUL)[start], (rolling(w.hash2, WINDOW, _MUL2)[start] >> np.uint64(32)).astype(np.uint32)
        self.ids = w.ids[w.doc[start]]
        order = np.lexsort((self.ids, h2, h))
        h, h2 = h[order], h2[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])] if len(h) else np.zeros(0, bool)
        self.index = np.empty(len(order), np.int64)
        self.index[order] = np.cumsum(new) - 1
        self.h, self.h2, self.low = h[new], h2[new], self.ids[order][new]

    def covered(self, w: Words, answers: list, buckets: int) -> np.ndarray:
        """Words in a window that also starts in a smaller document, in this chunk or another."""
        earlier = np.zeros(len(self.h), bool)
        where = dict(dealt(self.h, buckets))
        for one in answers:
            s = where[one["bucket"]]
            earlier[s] = unpack_bits(one["earlier"], s.stop - s.start)
        start = self.start[earlier[self.index] | (self.ids > self.low[self.index])]
        edge = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + WINDOW, -1)
        return np.cumsum(edge)[:-1] > 0


def _columns(batch: pa.RecordBatch, names: tuple[str, ...]):
    return zip(*(batch.column(c).to_pylist() for c in names), strict=True)


def _batch(columns: list, kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], names)


def anchor_answers(store: DataFrame, buckets: int, bits: int) -> DataFrame:
    """chunk_id, bucket, hit (of the chunk's runs in the bucket, those that meet a block of a smaller document), used (of its blocks, those that a larger one meets), as bits."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, ids, n, blob in _columns(batch, ("chunk_id", "ids", "n", "lines")):
                w = Words(ids, unpack_lines(blob, n))
                if not len(w.hash):
                    continue
                anchors, where = Anchors(w, bits), {}
                where = dict(dealt(anchors.blocks, buckets))
                base, top = int(w.ids.min()), int(w.ids.max())
                rows = []
                for b, s in dealt(anchors.keys, buckets):
                    mine = where.get(b, slice(0, 0))
                    rows.append((b, chunk, base, top, pack_sorted(anchors.keys[s]), pack_sorted(anchors.blocks[mine]), planes(anchors.low[mine] - base)))
                if rows:
                    yield _batch(list(map(list, zip(*rows, strict=True))), [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()], ["bucket", "chunk_id", "base", "top", "runs", "blocks", "low"])

    def meet(asked: pd.DataFrame) -> pd.DataFrame:
        """Each chunk against the blocks and runs of the other chunks."""
        blocks = [unpack_sorted(b) for b in asked["blocks"]]
        lows = [unplanes(x).view("<i8") + base for x, base in zip(asked["low"], asked["base"], strict=True)]
        n = [len(x) for x in blocks]
        chunk = np.repeat(np.arange(len(blocks)), n)
        key, every = np.concatenate(blocks), np.concatenate(lows)
        order = np.lexsort((every, key))
        key, every, chunk = key[order], every[order], chunk[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        keys, low, holder = key[first], every[first], chunk[first]
        # the least document of each block outside the chunk that holds the least one
        group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(key)]))
        second = np.full(len(keys), LAST)
        away = chunk != holder[group]
        np.minimum.at(second, group[away], every[away])
        # likewise the largest chunk top among those whose runs meet a block, and the next from another chunk
        least_possible = np.iinfo(np.int64).min
        high, next_high, owner = np.full(len(keys), least_possible), np.full(len(keys), least_possible), np.full(len(keys), -1)
        hits: list = [None] * len(blocks)
        tops = asked["top"].tolist()
        for c in np.argsort(tops, kind="stable").tolist():
            runs = unpack_sorted(asked["runs"].iloc[c])
            if not len(keys):
                hits[c] = np.zeros(len(runs), bool)
                continue
            at = np.minimum(np.searchsorted(keys, runs), len(keys) - 1)
            ok = keys[at] == runs
            hits[c] = ok & (np.where(holder[at] == c, second[at], low[at]) < tops[c])
            at = at[ok]
            next_high[at], high[at], owner[at] = high[at], tops[c], c
        used = []
        for c, (b, mine) in enumerate(zip(blocks, lows, strict=True)):
            at = np.searchsorted(keys, b)
            used.append(np.where(owner[at] == c, next_high[at], high[at]) > mine)
        keep = [bool(h.any() or u.any()) for h, u in zip(hits, used, strict=True)]
        return pd.DataFrame({"chunk_id": asked["chunk_id"], "bucket": asked["bucket"], "hit": [pack_bits(x) for x in hits], "used": [pack_bits(x) for x in used]})[keep]

    asked = store.mapInArrow(ask, "bucket int, chunk_id long, base long, top long, runs binary, blocks binary, low binary")
    return asked.groupBy("bucket").applyInPandas(meet, "chunk_id long, bucket int, hit binary, used binary")


def window_answers(marked: DataFrame, buckets: int, bits: int) -> DataFrame:
    """chunk_id, bucket, earlier: of the chunk's marked windows in the bucket, those that a document smaller than any of the chunk's holds."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, ids, n, blob, anchors in _columns(batch, ("chunk_id", "ids", "n", "lines", "anchors")):
                w = Words(ids, unpack_lines(blob, n))
                if not len(w.hash):
                    continue
                found = Windows(w, Anchors(w, bits).marked(w, anchors, buckets))
                base = int(w.ids.min())
                rows = [(b, chunk, base, pack_sorted(found.h[s]), squash(found.h2[s].tobytes()), planes(found.low[s] - base)) for b, s in dealt(found.h, buckets)]
                if rows:
                    yield _batch(list(map(list, zip(*rows, strict=True))), [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 3], ["bucket", "chunk_id", "base", "h", "h2", "low"])

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        h, h2 = [unpack_sorted(b) for b in group["h"]], [np.frombuffer(expand(b), np.uint32) for b in group["h2"]]
        low = [unplanes(x).view("<i8") + base for x, base in zip(group["low"], group["base"], strict=True)]
        all_h, all_h2, all_low = np.concatenate(h), np.concatenate(h2), np.concatenate(low)
        order = np.lexsort((all_low, all_h2, all_h))
        first = np.r_[True, (all_h[order][1:] != all_h[order][:-1]) | (all_h2[order][1:] != all_h2[order][:-1])]
        least = np.empty(len(order), np.int64)
        least[order] = all_low[order][np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        out, at = [], 0
        for mine in low:
            flags = least[at : at + len(mine)] < mine
            at += len(mine)
            out.append(pack_bits(flags) if flags.any() else None)
        found = pd.DataFrame({"chunk_id": group["chunk_id"], "bucket": group["bucket"], "earlier": out})
        return found[found["earlier"].notna()]

    asked = marked.mapInArrow(ask, "bucket int, chunk_id long, base long, h binary, h2 binary, low binary")
    return asked.groupBy("bucket").applyInPandas(meet, "chunk_id long, bucket int, earlier binary")


def substring_dedup(docs: DataFrame, spans: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; with spans also the
    maximal repeats as lists of first and last word, and the kept text."""
    spark = docs.sparkSession
    if dict(docs.dtypes)["doc_id"] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("substring dedup orders documents by an integer doc_id")
    store = chunk_store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), False)
    size = store.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(partitions_for(size, 16_000_000), int(spark.conf.get("spark.sql.shuffle.partitions")))
    bits = travelling_bits(size)
    anchors = written(anchor_answers(store, buckets, bits), "anchors").groupBy("chunk_id").agg(F.collect_list(F.struct("bucket", "hit", "used")).alias("anchors"))
    seen = window_answers(store.join(anchors, "chunk_id", "left"), buckets, bits).groupBy("chunk_id").agg(F.collect_list(F.struct("bucket", "earlier")).alias("seen"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, n, blob, hits, found in _columns(batch, ("ids", "n", "lines", "anchors", "seen")):
                w = Words(ids, unpack_lines(blob, n))
                gone = Windows(w, Anchors(w, bits).marked(w, hits, buckets)).covered(w, found or [], buckets)
                removed, digest, where, kept = [], [], [], []
                for words, a, m in zip(w.lines, w.starts.tolist(), w.sizes.tolist(), strict=True):
                    mine = gone[a : a + m]
                    left = words if not mine.any() else [x for x, g in zip(words, mine.tolist(), strict=True) if not g]
                    text = b" ".join(left)
                    removed.append(m - len(left))
                    digest.append(hashlib.sha256(text).hexdigest())
                    if spans:
                        edge = np.flatnonzero(np.diff(np.r_[False, mine, False].astype(np.int8)))
                        where.append([[int(x), int(y) - 1] for x, y in edge.reshape(-1, 2)])
                        kept.append(text.decode("utf-8", "replace"))
                columns, kinds, names = [ids, w.sizes, removed, digest], [pa.int64(), pa.int64(), pa.int64(), pa.string()], ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if spans:
                    columns, kinds, names = [*columns, where, kept], [*kinds, pa.list_(pa.list_(pa.int64())), pa.string()], [*names, "spans", "kept"]
                yield _batch(columns, kinds, names)

    joined = store.join(anchors, "chunk_id", "left").join(seen, "chunk_id", "left").select("ids", "n", "lines", "anchors", "seen")
    tune(spark)
    return joined.mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", spans array<array<long>>, kept string" if spans else ""))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))
