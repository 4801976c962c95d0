"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text. A text is
parsed greedily against every automaton: a phrase runs as long as the automaton
can follow it, so each phrase is a longest match, and the next phrase starts
at the character that broke it. A pointer into N characters costs log2(N) bits, so a
language's normalised phrase count is phrases * log2(N) for each character. The
language that needs fewest wins (ties: the first by name).

A language's alphabet is all letters of its training text, however many, with one class for
every run of other characters and one for letters it has never seen, which no phrase crosses. Its
automaton is a dense table of states by letters while that takes up to DENSE_BYTES, else a sorted list
of transitions; both parse alike. All texts of a batch are cut into segments of SEGMENT
characters (a phrase also ends there, for every language alike) and parsed in lockstep by numpy.

Defined cases: null text, empty text and text without letters are `und` with
score 0; so is everything if there is nothing to learn from. Repeated rows get
the same answer. Rows without lang are predicted, never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tessera.llm.common import documents, fold, held_out, tune

#: Bound of the labelled sample: about this many rows of each language are drawn, by a hash of their id ...
SAMPLE_ROWS = 120
#: ... and at most this many characters of each language go into its automaton.
SAMPLE_CHARS = 30_000
SEGMENT = 512
#: Size of a dense table at most.
DENSE_BYTES = 32_000_000
#: Classes of every alphabet; letters come after them.
GAP, PAD, UNSEEN = 0, 1, 2
BROKEN = np.int64(1 << 40)
UND = "und"

_letters: list[np.ndarray] = []
_built: dict[tuple, tuple] = {}


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")


class Automaton:
    """A suffix automaton over codes below width. step() follows one code from each state and adds
    BROKEN where a match breaks, to the state after a fresh start."""

    def __init__(self, codes: np.ndarray, width: int) -> None:
        nxt: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in codes.tolist():
            new = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        self.bits = max(2, (width - 1).bit_length())  # a state is kept shifted by these
        self.fresh = np.full(1 << self.bits, BROKEN, np.int64)
        for c, s in nxt[0].items():
            self.fresh[c] += s << self.bits
        self.fresh[PAD] = 0
        self.table = self.keys = None
        if len(nxt) << self.bits + 3 <= DENSE_BYTES:
            self.table = np.tile(self.fresh, (len(nxt), 1))
            for s, to in enumerate(nxt):
                for c, t in to.items():
                    self.table[s, c] = t << self.bits
            self.table = self.table.ravel()
        else:
            pairs = sorted(((s << self.bits) | c, t << self.bits) for s, to in enumerate(nxt) for c, t in to.items())
            self.keys, self.to = (np.array(x, np.int64) for x in zip(*pairs, strict=True))

    def step(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[state | codes]
        key = state | codes
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], self.fresh[codes])


@dataclass
class Parser:
    """Class of each code point, and for each language its name, its code of each class, its automaton, the bits of a pointer."""

    classes: np.ndarray
    names: list[str]
    own: list[np.ndarray]
    automata: list[Automaton]
    bits: np.ndarray


def build(model: tuple[tuple[str, str], ...]) -> Parser:
    """The parser of a model; kept in the worker process."""
    if model not in _built:
        _built.clear()
        seen = np.unique(np.concatenate([points(text) for _, text in model]))
        known = seen[letters()[seen]]
        classes = np.where(letters(), UNSEEN, GAP).astype(np.int32)
        classes[known] = np.arange(UNSEEN + 1, UNSEEN + 1 + len(known))
        own, automata, sizes = [], [], []
        for _, text in model:
            codes = squeeze(classes[points(text)])
            mine = np.unique(codes[codes > UNSEEN])
            to = np.full(UNSEEN + 1 + len(known), UNSEEN, np.int64)
            to[[GAP, PAD]], to[mine] = (GAP, PAD), np.arange(UNSEEN + 1, UNSEEN + 1 + len(mine))
            own.append(to)
            automata.append(Automaton(to[codes], UNSEEN + 1 + len(mine)))
            sizes.append(max(len(codes), 2))
        _built[model] = Parser(classes, [lang for lang, _ in model], own, automata, np.log2(sizes))
    return _built[model]


def squeeze(codes: np.ndarray) -> np.ndarray:
    """One gap for each run of gaps."""
    if not len(codes):
        return codes
    return codes[np.r_[True, (codes[1:] != GAP) | (codes[:-1] != GAP)]]


def phrases(texts: list[str | None], model: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrases by text and language, codes of each text, whether it has a letter)."""
    parser = build(model)
    parsed = [squeeze(parser.classes[points(t)]) for t in texts]
    sizes = np.array([len(p) for p in parsed], np.int64)
    lettered = np.array([bool((p != GAP).any()) for p in parsed])
    pieces = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(texts)), pieces)
    lanes = np.full((len(owner), SEGMENT), PAD, np.int32)
    flat, row = lanes.ravel(), 0
    for p in parsed:
        flat[row * SEGMENT : row * SEGMENT + len(p)] = p
        row += -(-len(p) // SEGMENT)
    steps = np.ascontiguousarray(lanes.T)
    out = np.zeros((len(texts), len(parser.names)))
    for k, (own, one) in enumerate(zip(parser.own, parser.automata, strict=True)):
        state, broken = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
        for codes in steps:
            state = one.step(state, own[codes])
            broken += state >> 40
            state &= BROKEN - 1
        out[:, k] = np.bincount(owner, broken + 1.0, len(texts))
    return out, sizes, lettered


def predict(texts: list[str | None], model: tuple) -> tuple[list[str], list[float]]:
    if not model:
        return [UND] * len(texts), [0.0] * len(texts)
    count, sizes, lettered = phrases(texts, model)
    bits = count * build(model).bits
    best = bits.argmin(axis=1)
    odds = np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000))
    score = 1 / odds.sum(axis=1)
    names = build(model).names
    return [names[b] if ok else UND for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)], np.where(lettered, score, 0.0).tolist()


def train(rows: DataFrame, rows_each: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> tuple[tuple[str, str], ...]:
    """Sample text of each language of rows (doc_id, text, lang): the whole model."""
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = dict(rows.groupBy("lang").count().collect())
    if not counts:
        return ()
    wanted = F.create_map([F.lit(x) for lang, n in counts.items() for x in (lang, rows_each / n)])
    chance = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    drawn = rows.where(chance < wanted[F.col("lang")]).select("lang", chance.alias("at"), F.substring("text", 1, chars).alias("text"))
    text: dict[str, str] = {}
    for lang, _, t in sorted(drawn.toLocalIterator(), key=lambda r: (r[0], r[1], r[2])):
        if len(text.get(lang, "")) < chars:
            text[lang] = (text.get(lang, "") + " " + t)[:chars]
    return tuple(sorted(text.items()))


def predictor(spark: SparkSession, model: tuple):
    """A column function: text -> struct(lang_pred, score)."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
    def lang_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            names, scores = predict(texts.to_pylist(), shared.value)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    def of(text: str | Column) -> Column:
        return lang_of(F.col(text) if isinstance(text, str) else text)

    return of


def language_id(docs: DataFrame, parts: int = 5, rest: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from rows outside the held-out fold."""
    spark = docs.sparkSession
    tune(spark)
    of = predictor(spark, train(docs.where(fold("doc_id", parts) != rest).select("doc_id", "text", "lang")))
    return docs.select("doc_id", held_out("doc_id", parts, rest).alias("held_out"), of("text").alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))
