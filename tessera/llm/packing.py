"""Best-fit packing refined by swap-based local search.

Tokenising: a document is the ids of its text and one end id 0; only longer
ones than CAPACITY are cut, into pieces of CAPACITY. Ids of a pre-token are
looked up in a worker's cache; a text outside the plain repertoire goes through
the library as a whole, so ids always equal the library's.

Packing: pieces are dealt evenly into shards of about SHARD pieces, by their place
and not by their content. In a shard the pieces are packed best-fit, longest first;
then every underfull bin, the emptiest first, hands pieces on: it moves one, or
exchanges one or two for one, always into a bin that is fuller, so that the sum of
squared fills grows, until bins are empty. Partners are found in an index of all underfull
bins; passes go on while they empty bins. Bins that stay underfull meet those of other
shards in further rounds; a shard passes on its emptiest bins, with at most half of its
pieces, so rounds shrink and no shard ever grows.

Defined cases: null or empty text is one piece of length 1 (the end id);
repeated rows are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Recent, documents, partitions_for, tune, written

CAPACITY = 2048
END = 0
#: Pieces of one shard: the memory and the time of one packing task.
SHARD = 40_000
#: Bytes of each generation of a worker's caches, of words and of pre-tokens.
WORD_BYTES, PRE_BYTES = 80_000_000, 40_000_000
#: The search ends after so many exchanges for each piece of a shard, or when a pass empties no bin.
EXCHANGES = 5

# ------------------------------------------------------------ tokenising ----
#: Characters whose lower case, normal form and class need no library: ASCII without
#: separators of files, and Latin letters up to U+017F.
_PLAIN = re.compile(r"[\x00-\x1b\x20-\x7e\xa1\xab\xbb\xbf-ſ]*\Z")
_PRE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def byte_letters() -> dict[int, str]:
    """Letters that stand for bytes outside the printable ones in a byte-level vocabulary."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return dict(zip(printable, map(chr, printable), strict=True)) | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(printable)))}


class Ids:
    """Packed little-endian ids of texts, with caches of words and pre-tokens."""

    def __init__(self, name: str) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizers.path(name))
        self.model = self.library.model
        self.raw = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]
        self.letters = byte_letters()
        self.cache, self.words = Recent(PRE_BYTES), Recent(WORD_BYTES)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Ids of pre-tokens, straight from the vocabulary's model: they need no normalising and no cutting."""
        split, letters, raw = self.model.tokenize, self.letters, self.raw
        self.cache.learn(words, [b"".join([raw[t.id] for t in split(w if w.isascii() else "".join([letters[b] for b in w.encode()]))]) for w in words])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Words between white space first, as no pre-token reaches across it."""
        words = [t.lower().split() if _PLAIN.match(t) and "<|" not in t else None for t in texts]
        new = self.words.missing(set().union(*[w for w in words if w is not None]))
        parts = [[w] if w.isalpha() else _PRE.findall(w) for w in new]
        self.learn(self.cache.missing(set().union(*parts)))
        get = self.cache.now.__getitem__
        self.words.learn(new, [get(p[0]) if len(p) == 1 else b"".join(map(get, p)) for p in parts])
        get = self.words.now.__getitem__
        return [b"".join(map(get, w)) if w is not None else self.whole(t) for w, t in zip(words, texts, strict=True)]


@cache
def ids_of(name: str) -> Ids:
    """One for each vocabulary and worker process, which outlives a task."""
    return Ids(name)


def pieces(docs: DataFrame, name: str = "word_bpe_49k.json", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every row of docs."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(name)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), 256):
                for k, raw in enumerate(ids.encode(texts[at : at + 256]), at):
                    raw += END.to_bytes(4, "little")
                    for p, a in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[a : a + 4 * capacity]
                        row.append(k)
                        piece.append(p)
                        start.append(a // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


# --------------------------------------------------------------- packing ----
def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of indices: longest first, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what is free in them
    open_ = 0  # bit r is set if some bin has r free
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = open_ >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_ &= ~(1 << r)
        else:
            r, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if r - s:
            room[r - s].append(b)
            open_ |= 1 << (r - s)
    return bins


class Partners:
    """Where pieces could go: for every underfull bin and every size t of its pieces (or 0, no
    piece), the bin could take up to reach = t + what is free in it, if t came back."""

    def __init__(self, capacity: int) -> None:
        self.held: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]  # by reach: heaps of (t, bin, version)
        self.least = np.full(capacity + 1, capacity + 1, np.int64)  # the least t of each reach
        self.version: dict[int, int] = {}

    def put(self, k: int, sizes: set[int], free: int) -> None:
        self.drop(k)
        if free > 0:
            for t in (0, *sizes):
                heappush(self.held[t + free], (t, k, self.version[k]))
                self.least[t + free] = min(self.least[t + free], t)

    def drop(self, k: int) -> None:
        self.version[k] = self.version.get(k, 0) + 1

    def top(self, reach: int) -> tuple[int, int] | None:
        """(t, bin) of the least t, entries that no longer hold thrown away."""
        held = self.held[reach]
        while held and self.version[held[0][1]] != held[0][2]:
            heappop(held)
        self.least[reach] = held[0][0] if held else len(self.least)
        return (held[0][0], held[0][1]) if held else None

    def best(self, amount: int) -> tuple[int, int, int] | None:
        """(reach, t, bin) of the least reach that takes amount for a smaller t: it fills a bin the most."""
        while True:
            at = np.flatnonzero(self.least[amount:] < amount)
            if not len(at):
                return None
            reach = amount + int(at[0])
            found = self.top(reach)
            if found is not None and found[0] < amount:
                return reach, *found


def local_search(bins: list[list[int]], sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Drain the emptiest bins into fuller underfull ones while squared fill grows.

    Ends when a pass over all underfull bins empties none, or when no packing could have fewer.
    """
    size = sizes.tolist()
    fill = [sum(size[i] for i in b) for b in bins]
    spare = len(bins) - -(-sum(size) // capacity)  # bins above the least possible
    left, emptied = EXCHANGES * len(size), True
    while spare > 0 and emptied and left > 0:
        emptied = False
        order = sorted((k for k in range(len(bins)) if 0 < fill[k] < capacity), key=lambda k: (fill[k], k))
        partners = Partners(capacity)
        for k in order:
            partners.put(k, {size[i] for i in bins[k]}, capacity - fill[k])
        for source in order:
            partners.drop(source)  # and it does not come back: all later sources are fuller
            while bins[source] and left > 0 and (found := _exchange(bins[source], size, partners)) is not None:
                target, out, t = found
                back = [next(j for j in bins[target] if size[j] == t)] if t else []
                bins[source] = [i for i in bins[source] if i not in out] + back
                bins[target] = [i for i in bins[target] if i not in back] + out
                gain = sum(size[i] for i in out) - t
                fill[source] -= gain
                fill[target] += gain
                partners.put(target, {size[i] for i in bins[target]}, capacity - fill[target])
                left -= 1
            if not bins[source]:
                spare, emptied = spare - 1, True
            if spare <= 0 or left <= 0:
                break
    return [b for b in bins if b]


def _exchange(source: list[int], size: list[int], partners: Partners) -> tuple[int, list[int], int] | None:
    """(target, pieces that leave, size of the piece that comes back or 0): the move or exchange of one or two
    pieces that leaves the least free in its target; of equal ones, what moves most."""
    of: dict[int, list[int]] = {}
    for i in source:
        of.setdefault(size[i], []).append(i)
    kinds = sorted(of)
    one = [(s, [of[s][0]]) for s in kinds]
    two = [(s + t, [of[s][0], of[t][-1]]) for k, s in enumerate(kinds) for t in kinds[k:] if s != t or len(of[s]) > 1]
    best, found = (len(partners.least), 0), None
    for amount, out in one + two:
        if amount < len(partners.least) and (hit := partners.best(amount)) is not None and (hit[0] - amount, hit[1] - amount) < best:
            best, found = (hit[0] - amount, hit[1] - amount), (hit[2], out, hit[1])
    return found


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    return local_search(best_fit(sizes, capacity), sizes, capacity)


def _solver(columns: list[str], capacity: int, level: int, last: bool):
    """Packs one shard. Unless this round is the last, its emptiest underfull bins wait for other shards, with at most
    half of its pieces, so the pieces that wait at least halve in every round."""

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(columns, kind="stable").reset_index(drop=True)
        size = part["length"].to_numpy()
        seq, off = np.full(len(part), -1, np.int64), np.full(len(part), -1, np.int64)
        number, waiting = (level << 52) + (int(part["_shard"].iloc[0]) << 20), 0
        for b in sorted(pack(size, capacity), key=lambda b: int(size[b].sum())):
            if not last and int(size[b].sum()) < capacity - 8 and 2 * (waiting + len(b)) <= len(part):
                waiting += len(b)
                continue
            seq[b], off[b] = number, np.cumsum(size[b]) - size[b]
            number += 1
        return part.assign(sequence_id=seq, offset=off)[[*columns, "sequence_id", "offset"]]

    return solve


def packed(table: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """sequence_id and offset for every row of table (length and any other columns)."""
    columns = table.columns
    kind = ", ".join(f"{n} {t}" for n, t in table.dtypes)
    done: DataFrame | None = None
    left, level = table, 0
    while True:
        shards = partitions_for(left.count(), shard)
        last = shards == 1
        # by a row's place in its written table, so rows that are equal are dealt apart
        dealt = left.withColumn("_shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
        solve = _solver(columns, capacity, level, last)
        result = written(dealt.groupBy("_shard").applyInPandas(solve, f"{kind}, sequence_id long, offset long"), "packed")
        full = result if last else result.where("sequence_id >= 0")
        done = full if done is None else done.union(full)
        if last:
            return done
        left, level = result.where("sequence_id < 0").select(*columns), level + 1


def best_fit_packing(docs: DataFrame, name: str = "word_bpe_49k.json", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    tune(docs.sparkSession)
    return packed(written(pieces(docs, name, capacity), "pieces"), capacity)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(documents(spark, sf_dir))
