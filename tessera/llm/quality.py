"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of each whole text are taken with numpy; the trees are grown on a
bounded labelled sample over at most BINS quantile bins for each statistic, and
flattened into arrays of complete binary trees, which a batch of documents
descends level by level, all rows and trees at once.

Defined cases: null text is empty; an empty text has all-zero statistics and a
score like any other; without labels of both kinds the score is their share
(0.5 if there are none); repeated rows get the same score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from tessera.llm.common import documents, held_out, tune
from tessera.llm.labelled import labelled_sample

#: Bound of the labelled sample.
LABELLED_ROWS = 20_000
BINS, TREES, DEPTH, RATE, LEAF_ROWS, RIDGE = 64, 120, 5, 0.1, 20, 1.0
THRESHOLD = 0.3

# ------------------------------------------------------------ statistics ----
CLASSES = ("upper", "lower", "digit", "space", "newline", "stop", "comma", "bang", "bar", "other", "high")


def _byte_classes() -> np.ndarray:
    table = np.full(256, CLASSES.index("other"), np.uint8)
    for name, members in {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": b" \t\r\x0b\x0c", "newline": b"\n", "stop": b".", "comma": b",", "bang": b"!?", "bar": b"|", "high": range(128, 256)}.items():
        table[list(members)] = CLASSES.index(name)
    return table


_TABLE = _byte_classes()
STATISTICS = (*(f"share_{c}" for c in CLASSES), "log_bytes", "log_words", "word_bytes", "distinct_words", "commonest_word", "short_words", "lines", "line_bytes", "repeated_lines", "case_runs", "class_changes", "odd_words", "entropy", "distinct_lines", "longest_line")


def statistics(text: str | None) -> list[float]:
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n = len(raw)
    if not n:
        return [0.0] * len(STATISTICS)
    kinds = _TABLE[raw]
    share = np.bincount(kinds, minlength=len(CLASSES)) / n
    words = (text or "").split()
    w = len(words)
    sizes = np.fromiter(map(len, words), np.int64, w)
    tally: dict[str, int] = {}
    for x in words:
        tally[x] = tally.get(x, 0) + 1
    lines = (text or "").split("\n")
    counts = np.bincount(raw, minlength=256)
    counts = counts[counts > 0] / n
    wide = np.fromiter(map(len, lines), np.int64, len(lines))
    upper = kinds == 0
    return [
        *share.tolist(), np.log1p(n), np.log1p(w), sizes.mean() if w else 0.0, len(tally) / w if w else 0.0, max(tally.values()) / w if w else 0.0,
        float((sizes <= 3).mean()) if w else 0.0, np.log1p(len(lines)), wide.mean(), 1 - len(set(lines)) / len(lines), float((upper[1:] & upper[:-1]).mean()) if n > 1 else 0.0,
        float((kinds[1:] != kinds[:-1]).mean()) if n > 1 else 0.0, sum(not x[-1].isalnum() for x in words) / w if w else 0.0, float(-(counts * np.log2(counts)).sum()), len(set(lines)) / (w + 1), float(wide.max()) / n,
    ]


@F.arrow_udf(ArrayType(FloatType()))
def statistics_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([statistics(t) for t in texts.to_pylist()], pa.list_(pa.float32()))


# ----------------------------------------------------------------- trees ----
@dataclass
class Forest:
    """feature, cut: (trees, 2**DEPTH - 1); leaf: (trees, 2**DEPTH); a row goes right if its value > cut."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not len(self.feature):
            return out
        trees, depth = np.arange(len(self.feature)), int(np.log2(self.leaf.shape[1]))
        for at in range(0, len(x), 1024):
            rows = x[at : at + 1024]
            node = np.zeros((len(rows), len(trees)), np.int64)
            index = np.arange(len(rows))[:, None]
            for _ in range(depth):
                node = 2 * node + 1 + (rows[index, self.feature[trees, node]] > self.cut[trees, node])
            out[at : at + 1024] += self.leaf[trees, node - (self.leaf.shape[1] - 1)].sum(axis=1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def grow(x: np.ndarray, y: np.ndarray) -> Forest:
    """Second-order boosting of the logistic loss, level by level over histograms."""
    none = Forest(np.zeros((0, 2**DEPTH - 1), np.int64), np.zeros((0, 2**DEPTH - 1), np.float32), np.zeros((0, 2**DEPTH)), 0.0)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        none.base = float(np.log(share / (1 - share)))
        return none
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")).astype(np.float32) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)  # bin b: value <= cuts[b]
    share = y.mean()
    base = float(np.log(share / (1 - share)))
    margin, out = np.full(len(y), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf, np.float32)
        for d in range(DEPTH):
            width, local = 2**d, node - (2**d - 1)
            best, choice = np.full(width, 1e-6), np.full((width, 2), -1)
            for f, c in enumerate(cuts):
                key = local * BINS + binned[:, f]
                G, H, N = (np.bincount(key, v, width * BINS).reshape(width, BINS).cumsum(1) for v in (g, h, None))
                left_g, left_h, left_n = G[:, :-1], H[:, :-1], N[:, :-1]
                right_g, right_h, right_n = G[:, -1:] - left_g, H[:, -1:] - left_h, N[:, -1:] - left_n
                gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - G[:, -1:] ** 2 / (H[:, -1:] + RIDGE)
                gain = np.where((left_n >= LEAF_ROWS) & (right_n >= LEAF_ROWS), gain, -1)[:, : len(c)]
                if not gain.shape[1]:
                    continue
                b = gain.argmax(axis=1)
                top = gain[np.arange(width), b]
                better = top > best
                best[better] = top[better]
                choice[better] = np.stack([np.full(width, f), b], 1)[better]
            for k in np.flatnonzero(choice[:, 0] >= 0):
                feature[width - 1 + k], cut[width - 1 + k] = choice[k, 0], cuts[choice[k, 0]][choice[k, 1]]
            split = np.where(choice[local, 0] >= 0, choice[local, 1], BINS)
            node = 2 * node + 1 + (binned[np.arange(len(y)), np.maximum(choice[local, 0], 0)] > split)
        at = node - (2**DEPTH - 1)
        leaf = -RATE * np.bincount(at, g, 2**DEPTH) / (np.bincount(at, h, 2**DEPTH) + RIDGE)
        margin += leaf[at]
        out.append((feature, cut, leaf))
    return Forest(*(np.stack(v) for v in zip(*out, strict=True)), base)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 5, rest: int = 0, rows: int = LABELLED_ROWS) -> Forest:
    sample = labelled_sample(docs, labels, label, parts, rest, rows)
    got = sample.select("doc_id", "y", statistics_of("text").alias("x")).toPandas().sort_values("doc_id")
    x = np.array(got["x"].tolist(), np.float32).reshape(-1, len(STATISTICS))
    return grow(x, got["y"].to_numpy(dtype=float))


def quality(docs: DataFrame, labels: DataFrame, parts: int = 5, rest: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    spark = docs.sparkSession
    tune(spark)
    forest = spark.sparkContext.broadcast(train(docs, labels, "quality", parts, rest))

    @F.arrow_udf(DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            x = np.array([statistics(t) for t in texts.to_pylist()], np.float32).reshape(-1, len(STATISTICS))
            yield pa.array(forest.value.score(x), pa.float64())

    scored = docs.select("doc_id", held_out("doc_id", parts, rest).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
