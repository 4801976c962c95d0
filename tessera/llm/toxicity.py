"""Toxicity: a linear classifier over character n-grams scaled by naive-Bayes
log-count ratios.

A document's features are the n-grams (ORDERS bytes, word borders included) of
its distinct lower-cased words; a feature's value is the number of distinct
words that hold it, times its log-count ratio between toxic and other labelled
documents. Words are runs of letters: digits, punctuation and n-grams across words are
no features. Logistic regression is fitted on the SELECTED features whose counts differ most,
both kinds of documents weighing the same in all. As scores add up over distinct words, a worker scores each word
once and keeps it.

Defined cases: null text is empty; an empty text scores the intercept alone;
without labels of both kinds the score is their smoothed share; repeated rows
get the same score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.llm.common import Recent, documents, held_out, tune, written
from tessera.llm.labelled import labelled_sample

#: Bound of the labelled sample.
LABELLED_ROWS = 6_000
ORDERS = (3, 4, 5)
SLOTS = 1 << 18
#: Features that enter the regression, so a bound on what the driver holds.
SELECTED = 8_000
ITERATIONS, RIDGE = 300, 3e-3
#: Bytes of each generation of a worker's cache.
CACHE_BYTES = 60_000_000
THRESHOLD = 0.7

_WORD = re.compile(r"[^\W\d_]+")


def distinct_words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slot, index of its word) of every n-gram of the words, borders marked."""
    coded = [b"<" + w.encode("utf-8", "surrogatepass") + b">" for w in words]
    raw = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    owner = np.repeat(np.arange(len(words)), sizes)
    slots, owners = [], []
    for n in ORDERS:
        if len(raw) < n:
            continue
        h = np.full(len(raw) - n + 1, n, np.uint32)
        for k in range(n):
            h = (h ^ raw[k : len(raw) - n + 1 + k]) * np.uint32(0x01000193)
        inside = owner[: len(h)] == owner[n - 1 :]
        slots.append((((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(14))[inside].astype(np.int64))
        owners.append(owner[: len(h)][inside])
    if not slots:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(slots), np.concatenate(owners)


@dataclass
class Model:
    """weight: for each slot, regression weight times log-count ratio (zero if not selected)."""

    weight: np.ndarray
    bias: float
    cache: Recent = field(default_factory=lambda: Recent(CACHE_BYTES))

    def margins(self, texts: list[str | None]) -> np.ndarray:
        sets = [distinct_words(t) for t in texts]
        words = sorted(self.cache.missing(set().union(*sets)))
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            slot, owner = grams(part)
            self.cache.learn(part, np.bincount(owner, self.weight[slot], len(part)).tolist())
        get = self.cache.now.__getitem__
        return np.array([self.bias + sum(map(get, sorted(s))) for s in sets])

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(texts), -50, 50)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights over len(ratio) features of rows (feature, count) and an intercept, by Adam on the whole sample, in which both kinds weigh the same."""
    size = np.array([len(f) for f, _ in rows], np.int64)
    owner = np.repeat(np.arange(len(rows)), size)
    owner, feature = owner.astype(np.int32), np.concatenate([f for f, _ in rows])
    value = (np.concatenate([c for _, c in rows]) * ratio[feature]).astype(np.float32)
    w, share = np.zeros(len(ratio)), y.mean()
    each = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)
    b = np.log(share / (1 - share))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, ITERATIONS + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(owner, value * w[feature], len(y)), -50, 50)))
        err = (p - y) * each
        g = np.bincount(feature, value * err[owner], len(w)) + RIDGE * w
        gb = err.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.02 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= rate * m / (np.sqrt(v) + 1e-9)
        b -= rate * mb / (np.sqrt(vb) + 1e-9)
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 3, rest: int = 1, rows: int = LABELLED_ROWS) -> Model:
    sample = written(labelled_sample(docs, labels, label, parts, rest, rows), "toxicity-sample")
    size = dict(sample.groupBy("y").count().collect())
    if len(size) < 2:
        share = (size.get(1, 0) + 1) / (sum(size.values()) + 2)
        return Model(np.zeros(SLOTS), float(np.log(share / (1 - share))))

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In how many documents of each kind each slot occurs: one row a slot and task."""
        seen = np.zeros((2, SLOTS), np.int64)
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                seen[int(y == 1)] += np.bincount(np.unique(grams(sorted(distinct_words(text)))[0]), minlength=SLOTS)
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[0, at]), pa.array(seen[1, at])], ["slot", "no", "yes"])

    found = sample.select("text", "y").coalesce(8).mapInArrow(presence, "slot long, no long, yes long").groupBy("slot").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes")).toPandas()
    slot, no, yes = (found[c].to_numpy() for c in ("slot", "no", "yes"))
    n0, n1 = size.get(0, 0), size.get(1, 0)
    # how far apart the two shares are, in standard errors
    pooled = (no + yes + 1) / (n0 + n1 + 2)
    apart = np.abs(yes / n1 - no / n0) / np.sqrt(pooled * (1 - pooled) * (1 / n0 + 1 / n1) + 1e-12)
    top = np.lexsort((slot, -apart))[:SELECTED]
    chosen, no, yes = slot[top], no[top] + 1.0, yes[top] + 1.0
    ratio = np.log(yes / (n1 + 2)) - np.log(no / (n0 + 2))
    place = np.full(SLOTS, -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                at = shared.value[grams(sorted(distinct_words(text)))[0]]
                f, c = np.unique(at[at >= 0], return_counts=True)
                out.append(np.stack([f, c]).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(out, pa.binary())], ["doc_id", "y", "x"])

    got = sample.mapInArrow(vectors, f"doc_id {dict(sample.dtypes)['doc_id']}, y int, x binary").toPandas().sort_values("doc_id")
    x = [np.frombuffer(b, "<i4").reshape(2, -1) for b in got.pop("x")]
    w, b = fit([(r[0], r[1]) for r in x], (got["y"].to_numpy() == 1).astype(float), ratio)
    weight = np.zeros(SLOTS)
    weight[chosen] = w * ratio
    return Model(weight, b)


def toxicity(docs: DataFrame, labels: DataFrame, parts: int = 3, rest: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    spark = docs.sparkSession
    tune(spark)
    model = train(docs, labels, "toxic", parts, rest)
    at = np.flatnonzero(model.weight)
    shared = spark.sparkContext.broadcast((at.astype(np.int32), model.weight[at], model.bias))

    @F.arrow_udf(DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        slots, values, bias = shared.value
        mine = Model(np.zeros(SLOTS), bias)
        mine.weight[slots] = values
        for texts in batches:
            yield pa.array(mine.score(texts.to_pylist()), pa.float64())

    scored = docs.select("doc_id", held_out("doc_id", parts, rest).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
