"""Token counts by a map-side two-tier lookup.

Tier one is a compact hash table of the lengths of frequent pre-tokens, built
once and broadcast (at most FREQUENT entries). Tier two is a cache in each
Python worker; what both miss is encoded by the library, one call for all new
pre-tokens of a batch. No pre-token is ever shuffled.

A pre-token is a run of spaces with the characters up to the next space or
newline; no piece of the vocabulary crosses such a border (checked when the
model is loaded), so lengths add up to the library's own count.

Defined cases: null or empty text has 0 bytes and 0 tokens; repeated rows are
counted each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Recent, documents, tune

#: Entries of the broadcast table; a few hundred kB once packed.
FREQUENT = 32_768
#: Rows whose texts choose which pre-tokens count as frequent: speed only, never results.
SAMPLE_ROWS = 1_000
#: Bytes of each generation of a worker's cache.
CACHE_BYTES = 60_000_000
LIMIT = 4096

SPACE = "▁"
_PIECES = re.compile(r" *[^ \n]+|\n| +")


def pre_tokens(text: str) -> list[str]:
    """The text as the model sees it, with the space it puts before any text."""
    return _PIECES.findall(" " + text.replace(SPACE, " ")) if text else []


def load(name: str):
    """The processor, refused if a piece could cross the borders used here."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(SPACE in x.lstrip(SPACE) or "\n" in x for x in pieces):
        raise ValueError(f"{name} has pieces that cross pre-tokens")
    return model


def lengths(model, words: list[str]) -> list[int]:
    """Tokens of each pre-token. The library adds a space, so one is taken off first."""
    out = []
    for w, ids in zip(words, model.encode([w[1:] if w[0] == " " else w for w in words], num_threads=1), strict=True):
        # without a leading space (a newline, a word after one) the added space is a token or part of one
        out.append(1 if w == " " else len(ids) if w[0] == " " else _bare(model, w))
    return out


def _bare(model, word: str) -> int:
    """Tokens of a pre-token that follows a newline: counted behind one, less what the newline alone takes."""
    return len(model.encode("\n" + word)) - len(model.encode("\n"))


def pack(table: dict[str, int]) -> bytes:
    words = sorted(table)
    return zlib.compress("\0".join(words).encode() + b"\0\0" + np.array([table[w] for w in words], "<u4").tobytes())


def unpack(blob: bytes) -> dict[str, int]:
    words, _, counts = zlib.decompress(blob).partition(b"\0\0")
    return dict(zip(words.decode().split("\0"), np.frombuffer(counts, "<u4").tolist(), strict=True)) if words else {}


def frequent_table(docs: DataFrame, name: str) -> bytes:
    """Lengths of the commonest pre-tokens of about SAMPLE_ROWS rows, chosen by a hash of their id."""
    every = max(1, docs.count() // SAMPLE_ROWS)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(w for w in pre_tokens(text) if "\0" not in w)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([pack(dict(seen.most_common(FREQUENT)))])], ["packed"])

    total: Counter[str] = Counter()
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text")
    for (packed,) in sample.mapInArrow(tally, "packed binary").toLocalIterator():
        total.update(unpack(packed))
    words = [w for w, _ in total.most_common(FREQUENT)]
    return pack(dict(zip(words, lengths(load(name), words), strict=True)) if words else {})


def token_counts(docs: DataFrame, name: str = "piece_bpe_32k.model", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    table = spark.sparkContext.broadcast(frequent_table(docs, name))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, frequent, cache = load(name), unpack(table.value), Recent(CACHE_BYTES)
        for batch in batches:
            texts = [pre_tokens(t) for t in batch.column("text").to_pylist()]
            new = cache.missing(set().union(*texts))
            first = [w for w in new if w in frequent]
            cache.learn(first, [frequent[w] for w in first])
            lacking = [w for w in new if w not in frequent]
            for at in range(0, len(lacking), 20_000):
                cache.learn(lacking[at : at + 20_000], lengths(model, lacking[at : at + 20_000]))
            n = [sum(map(cache.now.__getitem__, t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(count, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
