"""Near-duplicates by SimHash fingerprints and a binary-trie self-join.

Fingerprint: A-Z lower-cased, words [^\\x20\\x09-\\x0D]+, shingles of three
words joined by a space, XXH64 with seed 42; a bit is 1 if set in over half of
the shingles. Two fingerprints link at two or fewer differing bits.

The join never meets documents: it runs on distinct fingerprints. With a budget
of e bits, one of e+1 blocks of bits agrees exactly, so each fingerprint enters
e+1 tries, each keyed by one block. Inside a trie, pairs of nodes are
traversed together from the root pair, differing bits are accumulated, and a
pair is dropped as soon as they exceed the budget. A trie of more than
TRIE_KEYS fingerprints is first cut into pairs of subtrees, with the same
budget, and the pairs that still hold too many are cut again, deeper, until none does; so
no task holds an unbounded trie, however the fingerprints are spread. A task emits a spanning forest of
the links it has found, not all pairs, which loses no component.

Defined cases: null text and text without words have fingerprint zero and link
like any other; fewer than three words make one shingle; repeated rows share
their fingerprint; component_id is the smallest doc_id reachable (null ids
never name a component unless a component has no other); an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tessera.llm.common import connected_components, documents, partitions_for, tune, written

BITS = 64
BUDGET = 2
SEED = 42
#: A trie of more fingerprints is cut into pairs of subtrees.
TRIE_KEYS = 50_000
#: Node pairs with fewer fingerprint pairs are compared directly.
LEAF_PAIRS = 64


def fingerprint(text: str | None, size: int = 3) -> int:
    """The 64-bit fingerprint of one text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line, h64 = b" ".join(words), xxhash.xxh64_intdigest
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    hashes = np.array([h64(line[a:b], SEED) for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = ones * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


@F.arrow_udf(LongType())
def fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Signed view of the fingerprint."""
    for texts in batches:
        yield pa.array(np.array([fingerprint(t) for t in texts.to_pylist()], dtype=np.uint64).view(np.int64), pa.int64())


# ---------------------------------------------------------------- tries ----
def blocks(budget: int = BUDGET) -> list[tuple[int, int]]:
    """(shift, width) of budget + 1 blocks that cover the 64 bits."""
    edges = [BITS * i // (budget + 1) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def rotated(fp: np.ndarray, shift: int, width: int) -> np.ndarray:
    """Bits rotated so that the block stands on top."""
    up = (BITS - shift - width) % BITS
    return fp if not up else (fp << np.uint64(up)) | (fp >> np.uint64(BITS - up))


def trie_pairs(keys: np.ndarray, roots: list[tuple[int, int, int, int, int]] | np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of sorted distinct keys at most budget bits apart.

    roots: node pairs (lo1, hi1, lo2, hi2, depth) as ranges of keys whose first
    `depth` bits agree within a node; both nodes of a pair have one depth.
    """
    found_i, found_j = [], []
    front = np.asarray(roots, dtype=np.int64).reshape(-1, 5)
    while len(front):
        lo1, hi1, lo2, hi2, depth = front.T
        same = lo1 == lo2
        n1, n2 = hi1 - lo1, hi2 - lo2
        front = front[(n1 > 0) & (n2 > 0) & ~(same & (n1 < 2))]
        if not len(front):
            break
        lo1, hi1, lo2, hi2, depth = front.T
        # bits in which the two prefixes differ, counted on any member of each node
        differ = keys[lo1] ^ keys[lo2]
        spent = np.bitwise_count(np.where(depth > 0, differ >> (np.uint64(BITS) - np.maximum(depth, 1).astype(np.uint64)), np.uint64(0)))
        front = front[spent <= budget]
        if not len(front):
            break
        lo1, hi1, lo2, hi2, depth = front.T
        size = (hi1 - lo1) * (hi2 - lo2)
        small = (size <= LEAF_PAIRS) | (depth >= BITS)
        if small.any():
            a, m = front[small], size[small]
            row = np.repeat(np.arange(len(a)), m)
            k = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            w2 = (a[:, 3] - a[:, 2])[row]
            i, j = a[row, 0] + k // w2, a[row, 2] + k % w2
            ok = i < j
            i, j = i[ok], j[ok]
            ok = np.bitwise_count(keys[i] ^ keys[j]) <= budget
            found_i.append(i[ok])
            found_j.append(j[ok])
        front = front[~small]
        if not len(front):
            break
        lo1, hi1, lo2, hi2, depth = front.T
        bit = np.uint64(1) << (np.uint64(BITS - 1) - depth.astype(np.uint64))

        def split(lo, hi):  # noqa: ANN001, ANN202
            above = (keys[lo] & ~(bit | (bit - np.uint64(1)))) | bit
            return np.clip(np.searchsorted(keys, above), lo, hi)  # noqa: B023

        m1, m2 = split(lo1, hi1), split(lo2, hi2)
        same = lo1 == lo2
        children = [np.stack(x, 1) for x in ((lo1, m1, lo2, m2, depth + 1), (m1, hi1, m2, hi2, depth + 1), (lo1, m1, m2, hi2, depth + 1))]
        children.append(np.stack((m1, hi1, lo2, m2, depth + 1), 1)[~same])
        front = np.concatenate(children)
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_i), np.concatenate(found_j)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links, each node hung on the root of its tree."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    touched = np.unique(np.concatenate([i, j])).tolist()
    return [(r, x) for x in touched if (r := root(x)) != x]


def links(prints: DataFrame, budget: int = BUDGET, trie_keys: int = TRIE_KEYS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints fp that connect exactly what links."""
    spark = prints.sparkSession
    total = prints.count()
    spans = blocks(budget)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            key = np.concatenate([(rotated(fp, s, w) >> np.uint64(BITS - w)).astype(np.int64) * len(spans) + k for k, (s, w) in enumerate(spans)])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.tile(fp.view(np.int64), len(spans)))], ["trie", "fp"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each fingerprint of a pair of subtrees (lo, hi) that holds too many goes to every pair of
        deeper subtrees that it takes part in and that is within the budget."""
        for batch in batches:
            trie, fp, low, high, depth, count = (batch.column(c).to_numpy() for c in ("trie", "fp", "lo", "hi", "depth", "count"))
            out: list = [[], [], [], [], []]
            key = np.stack([trie, low, high, depth.astype(np.int64)], 1)
            for one in np.unique(key, axis=0):
                mine = np.flatnonzero((key == one).all(axis=1))
                t, lo, hi, d = one.tolist()
                shift, width = spans[t % len(spans)]
                more = min(BITS - width - d, max(1, int(np.ceil(np.log2(count[mine[0]] / trie_keys))) + 2), 10)
                whole = rotated(fp[mine].view(np.uint64), shift, width) & np.uint64((1 << (BITS - width)) - 1)
                below = (whole >> np.uint64(BITS - width - d - more)).astype(np.int64)
                spent = (lo ^ hi).bit_count()
                # the prefix on the other side: the other subtree's, with up to the rest of the budget flipped below it
                across = (np.where(below >> more == lo, hi, lo) << more) | (below & ((1 << more) - 1))
                for flips in [c for e in range(budget - spent + 1) for c in combinations(range(more), e)]:
                    other = across ^ sum(1 << f for f in flips)
                    for held, x in zip(out, (np.full(len(mine), t), fp[mine], np.minimum(below, other), np.maximum(below, other), np.full(len(mine), d + more, np.int32)), strict=True):
                        held.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["trie", "fp", "lo", "hi", "depth"])

    node = ["trie", "lo", "hi", "depth"]
    pending = prints.select("fp").mapInArrow(route, "trie long, fp long").select("trie", "fp", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), F.lit(0).alias("depth"))
    plain = None
    while True:
        sizes = written(pending.groupBy(*node).count().where((F.col("count") > trie_keys) & (F.col("depth") < BITS - max(w for _, w in spans))), "hot-tries")  # at most one row for every trie_keys of them
        small = pending if sizes.isEmpty() else pending.join(sizes, node, "left_anti").select(*pending.columns)
        plain = small if plain is None else plain.union(small)
        if sizes.isEmpty():
            break
        pending = written(pending.join(sizes, node).mapInArrow(cut, pending.schema), "cut-tries")

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One partition: its tries, one after another in bounded groups."""
        rest = None
        for batch in [*batches, None]:
            if batch is not None:
                table = pa.Table.from_batches([batch])
                rest = table if rest is None else pa.concat_tables([rest, table])
                if rest.num_rows < 4 * trie_keys:
                    continue
            if rest is None or not rest.num_rows:
                return
            trie, lo, hi, depth, fp = (rest.column(c).to_numpy() for c in (*node, "fp"))
            new = np.r_[True, (np.diff(trie) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0) | (np.diff(depth) != 0)]
            end = len(trie) if batch is None else int(np.flatnonzero(new)[-1])  # the last node may go on in the next batch
            yield from edges_of(trie[:end], lo[:end], hi[:end], depth[:end], fp[:end], new[:end])
            rest = rest.slice(end)

    def edges_of(trie, low, high, depth, fp, new) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
        for k, (shift, width) in enumerate(spans):
            mine = np.flatnonzero(trie % len(spans) == k)
            if not len(mine):
                continue
            keys = rotated(fp[mine].view(np.uint64), shift, width)
            border = np.flatnonzero(np.r_[True, new[mine][1:] | (np.diff(trie[mine]) != 0)])
            stop = np.r_[border[1:], len(mine)]
            many = stop - border > 1
            for lo, hi in zip(border[many].tolist(), stop[many].tolist(), strict=True):
                part, at = np.sort(keys[lo:hi]), mine[lo]
                n, d, p, q = len(part), int(depth[at]), int(low[at]), int(high[at])
                if p == q:
                    roots = [(0, n, 0, n, width + d if d else 0)]
                else:  # a pair of subtrees: the two prefixes below the block
                    below = ((part & np.uint64((1 << (BITS - width)) - 1)) >> np.uint64(BITS - width - d)).astype(np.int64)
                    mid = int(np.searchsorted(below, q))
                    roots = [(0, mid, mid, n, width + d)]
                i, j = trie_pairs(part, roots, budget)
                if len(i):
                    up = (BITS - shift - width) % BITS
                    back = part if not up else (part >> np.uint64(up)) | (part << np.uint64(BITS - up))
                    tree = np.array(forest(n, i, j), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(back[tree[:, 0]].view(np.int64)), pa.array(back[tree[:, 1]].view(np.int64))], ["a", "b"])

    parts = max(partitions_for(total * len(spans), 8 * trie_keys), int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = plain.repartition(parts, *node).sortWithinPartitions(*node)
    return placed.mapInArrow(traverse, "a long, b long")


def components(rows: DataFrame) -> DataFrame:
    """(fp, component_id) of rows (doc_id, fp)."""
    groups = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    joined = connected_components(links(groups))
    of = groups.join(joined.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    of = written(of, "classes")
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    return of.join(least, "component").select("fp", "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of docs."""
    tune(docs.sparkSession)
    rows = written(docs.select("doc_id", fingerprints("text").alias("fp")), "simhash")
    return rows.join(components(rows), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir))
