"""Rasters as relations: pixel(image_id, pixel_id, x, y, r, g, b, a), row-major.

`from_events` derives pictures from the events table by integer arithmetic, so
every operator can run on ordinary tables; `read_netpbm` decodes real files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size of the derived pictures; the last one may be lower.
WIDTH, HEIGHT = 100, 40
#: r, g, b of the four zones of the derived picture.
BASE = ((200, 40, 40), (40, 60, 200), (120, 180, 90), (240, 235, 225))


def from_events(events: DataFrame) -> DataFrame:
    at = events.select(F.expr(f"event_id div {WIDTH * HEIGHT}").alias("image_id"), F.col("event_id").alias("pixel_id"), (F.col("event_id") % WIDTH).alias("x"), F.expr(f"event_id div {WIDTH} % {HEIGHT}").alias("y"), "user_id")
    at = at.withColumns({"zone": F.expr("((x div 12) * 3 + (y div 9) * 5 + image_id) % 4"), "noise": F.expr("(x * 7 + y * 13 + user_id) % 9")})

    def channel(k: int) -> Column:
        base = F.when(F.col("zone") == 0, BASE[0][k]).when(F.col("zone") == 1, BASE[1][k]).when(F.col("zone") == 2, BASE[2][k]).otherwise(BASE[3][k])
        return F.least(F.greatest(base + F.col("noise") * 2 - 8, F.lit(0)), F.lit(255)).cast("long")

    clear = (F.col("noise") == 8) & (F.col("zone") == 3)
    alpha = F.when(clear & (F.col("x") % 2 == 0), 0).when(clear, 128).otherwise(255).cast("long")
    return at.select("image_id", "pixel_id", "x", "y", "zone", "noise", channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"), alpha.alias("a"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id"))


# --------------------------------------------------------------- netpbm ----
LIMIT_PIXELS = 64_000_000


def decode_netpbm(raw: bytes) -> tuple[int, int, bytes]:
    """(width, height, RGBA bytes) of a P6 or P7 file with 8-bit samples."""
    if raw[:2] == b"P6":
        fields, at = [], 2
        while len(fields) < 3:
            while at < len(raw) and (raw[at : at + 1].isspace() or raw[at : at + 1] == b"#"):
                at = raw.index(b"\n", at) + 1 if raw[at : at + 1] == b"#" else at + 1
            end = at
            while end < len(raw) and raw[end : end + 1].isdigit():
                end += 1
            fields.append(int(raw[at:end]))
            at = end
        (width, height, top), depth, at = fields, 3, at + 1
    elif raw[:2] == b"P7":
        head, _, _ = raw.partition(b"ENDHDR\n")
        keys = dict(line.split(None, 1) for line in head.decode("ascii").splitlines()[1:] if line.strip() and not line.startswith("#"))
        width, height, depth, top = (int(keys[k]) for k in ("WIDTH", "HEIGHT", "DEPTH", "MAXVAL"))
        at = len(head) + 7
    else:
        raise ValueError("only P6 and P7 files are read")
    if top != 255 or depth not in (3, 4):
        raise ValueError("only 8-bit RGB and RGBA are read")
    if width <= 0 or height <= 0 or width * height > LIMIT_PIXELS:
        raise ValueError("size out of limits")
    body = raw[at : at + width * height * depth]
    if len(body) < width * height * depth:
        raise ValueError("file ends early")
    if depth == 3:
        rgba = bytearray(b"\xff" * (width * height * 4))
        for k in range(3):
            rgba[k::4] = body[k::3]
        body = bytes(rgba)
    return width, height, body


def read_netpbm(spark: SparkSession, path: str) -> DataFrame:
    """pixel rows of all matching files, with image_id (the file's SHA-256)."""
    import hashlib

    import numpy as np

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                width, height, body = decode_netpbm(raw)
                rgba = np.frombuffer(body, np.uint8).reshape(-1, 4).astype(np.int64)
                at = np.arange(width * height)
                columns = [pa.array([hashlib.sha256(raw).hexdigest()] * len(at)), *(pa.array(v) for v in (at, at % width, at // width, *rgba.T))]
                yield pa.RecordBatch.from_arrays(columns, ["image_id", "pixel_id", "x", "y", "r", "g", "b", "a"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(unpack, "image_id string, pixel_id long, x long, y long, r long, g long, b long, a long")


def sniff(content: Column) -> Column:
    """MIME type by the first bytes, null if unknown."""
    head = F.hex(F.substring(content, 1, 12))
    known = {"89504E470D0A1A0A": "image/png", "FFD8FF": "image/jpeg", "474946383761": "image/gif", "474946383961": "image/gif", "424D": "image/bmp", "49492A00": "image/tiff", "4D4D002A": "image/tiff", "5036": "image/x-portable-pixmap", "5035": "image/x-portable-graymap", "5037": "image/x-portable-arbitrarymap"}
    out = F.when(F.lit(False), F.lit(""))
    for magic, kind in known.items():
        out = out.when(F.startswith(head, F.lit(magic)), kind)
    return out.when(F.startswith(head, F.lit("52494646")) & (F.substring(head, 17, 8) == "57454250"), "image/webp")


def decoded(files: DataFrame, key: str) -> DataFrame:
    """key, x, y, r, g, b, a of files (key, content); those that are no Netpbm file read here are left out."""
    import numpy as np

    kind = dict(files.dtypes)[key]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(key).to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    width, height, body = decode_netpbm(bytes(raw))
                except (ValueError, KeyError):
                    continue
                at = np.arange(width * height)
                rgba = np.frombuffer(body, np.uint8).reshape(-1, 4).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), *(pa.array(v) for v in (at % width, at // width, *rgba.T))], [key, "x", "y", "r", "g", "b", "a"])

    return files.select(key, "content").mapInArrow(unpack, f"{key} {kind}, x long, y long, r long, g long, b long, a long")
