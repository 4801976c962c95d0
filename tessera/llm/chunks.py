"""A chunk store: documents as word lines, some megabytes in a row, compressed.

Operators that read a corpus several times, or that ask it questions about
its words, work on chunks: one row holds the ids of its documents and their
lines (words joined by one space), so questions are asked once for each distinct word or
window of a chunk, and answers come back to a chunk instead of to millions of rows.
The table lies in the shared folder, so it is computed once and survives lost executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import tune, written

#: Bytes of lines in one chunk (a longer document is a chunk by itself).
CHUNK_BYTES = 3_000_000


def squash(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def expand(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def pack_lines(lines: list[bytes]) -> bytes:
    return squash(b"\n".join(lines))


def unpack_lines(blob: bytes, n: int) -> list[bytes]:
    return expand(blob).split(b"\n") if n else []


def words_of(text: str | None, lower: bool) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a text in UTF-8; A-Z lower-cased on request."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def chunk_store(docs: DataFrame, lower: bool, flag=None, size: int = CHUNK_BYTES) -> DataFrame:
    """chunk_id, ids, flags, n, n_bytes, lines (packed) of all rows; flag: a boolean column."""
    tune(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, flags, lines, held = TaskContext.get().partitionId() << 32, [], [], [], 0
        id_type = pa.int64()

        def row() -> pa.RecordBatch:
            values = [[number], [ids], [bytes(flags)], [len(ids)], [held], [pack_lines(lines)]]
            kinds = [pa.int64(), pa.list_(id_type), pa.binary(), pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["chunk_id", "ids", "flags", "n", "n_bytes", "lines"])

        for batch in batches:
            id_type = batch.column("doc_id").type
            for doc_id, f, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "f", "text")), strict=True):
                line = b" ".join(words_of(text, lower))
                if lines and held + len(line) > size:
                    yield row()
                    number, ids, flags, lines, held = number + 1, [], [], [], 0
                ids.append(doc_id)
                flags.append(bool(f))
                lines.append(line)
                held += len(line)
        if ids:
            yield row()

    rows = docs.select("doc_id", (F.lit(False) if flag is None else flag).alias("f"), "text")
    return written(rows.mapInArrow(gather, f"chunk_id long, ids array<{kind}>, flags binary, n int, n_bytes long, lines binary"), "chunks")
