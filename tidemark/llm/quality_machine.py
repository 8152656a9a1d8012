"""Quality classifier: a factorisation machine over hashed words, structure and size of a text.

    score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

The identity makes the pairwise interactions of all features linear in their number. Features
come from the whole text alone: words hashed to ``BUCKETS`` (square roots of their shares),
shares of character classes, repetition of words and word pairs, and the text's size.

The machine is fitted on at most ``SAMPLE`` labelled rows, those with the smallest hashes of
doc_id among the rows that ``may_learn`` allows; a row is at most ``BUCKETS`` numbers, so the
driver's share is bounded. Scoring is one pass over the texts without a shuffle.

Defined results: null and empty texts have no words; they are scored from the other features.
Of several labels of one doc_id the largest counts; null labels are not learnt from. Without
any labelled row, or with one label only, every score is that label's (1 if there is none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import ship
from tidemark.llm.word_hashes import hashed_words, mix, raw_texts

BUCKETS, FACTORS, SAMPLE, EPOCHS = 1 << 13, 8, 4096, 12
_BITS = 13
_CLASSES = 7
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = 1  # upper case
_CLASS[48:58] = 2  # digits
_CLASS[[33, 63]] = 3  # exclamation and question marks
_CLASS[[ord(c) for c in "#*$%&|<>{}[]=_~^\\/@+"]] = 4  # symbols
_CLASS[[10, 13]] = 5  # line ends
_CLASS[[ord(c) for c in ".,;:"]] = 6  # punctuation
STATISTICS = 14
WIDTH = BUCKETS + STATISTICS


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, values) of each text of a column."""
    data, at = raw_texts(column)
    row = 0
    for _, offsets, hashes in hashed_words(column, lower=False):
        for i in range(len(offsets) - 1):
            words = hashes[offsets[i] : offsets[i + 1]]
            part = data[at[row] : at[row + 1]]
            row += 1
            n, size = len(words), max(len(part), 1)
            kinds = np.zeros(_CLASSES)
            for begin in range(0, len(part), 1 << 20):
                kinds += np.bincount(_CLASS[part[begin : begin + (1 << 20)]], minlength=_CLASSES)
            counts = np.bincount((words >> np.uint64(64 - _BITS)).astype(np.int64), minlength=BUCKETS) if n > BUCKETS else None
            if counts is None:
                index, seen = np.unique((words >> np.uint64(64 - _BITS)).astype(np.int64), return_counts=True)
            else:
                index = np.flatnonzero(counts)
                seen = counts[index]
            own, times = np.unique(words, return_counts=True)
            pairs = len(np.unique(mix(words[:-1] * np.uint64(3) + words[1:]))) if n > 1 else 1
            shape = np.concatenate(
                [
                    np.sqrt(kinds[1:] / (size + 64)),
                    [
                        1.0,
                        np.log1p(n) / 10,
                        np.log1p(size / max(n, 1)) / 3,
                        len(own) / max(n, 1),
                        pairs / max(n - 1, 1),
                        (times.max() / n) if n else 0.0,
                        float(np.mean(words[1:] == words[:-1])) if n > 1 else 0.0,
                        np.sqrt(np.count_nonzero(part > 127) / size),
                    ],
                ]
            )
            yield np.concatenate([index, BUCKETS + np.arange(STATISTICS)]), np.concatenate([np.sqrt(seen / (n + 16)), shape])


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margin(self, index: np.ndarray, values: np.ndarray) -> float:
        v = self.factors[index] * values[:, None]
        sums = v.sum(axis=0)
        return float(self.bias + self.weights[index] @ values + 0.5 * (sums @ sums - (v * v).sum()))

    def score(self, index: np.ndarray, values: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(index, values), -35, 35))))


def constant(label: int) -> Machine:
    return Machine(35.0 if label else -35.0, np.zeros(WIDTH), np.zeros((WIDTH, 1)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, factors: int = FACTORS, rate: float = 0.05, decay: float = 1e-5) -> Machine:
    """Adam on the logistic loss, in batches."""
    if not len(labels) or labels.min() == labels.max():
        return constant(int(labels[0]) if len(labels) else 1)
    random = np.random.default_rng(11)
    w = np.zeros((WIDTH, factors + 1))
    w[:, 1:] = random.normal(0, 0.05, (WIDTH, factors))
    bias, moment, square = 0.0, np.zeros_like(w), np.zeros_like(w)
    bias_m = bias_s = 0.0
    step = 0
    for _ in range(epochs):
        order = random.permutation(len(labels))
        for at in range(0, len(order), 128):
            chosen = order[at : at + 128]
            lengths = [len(rows[j][0]) for j in chosen]
            index = np.concatenate([rows[j][0] for j in chosen])
            x = np.concatenate([rows[j][1] for j in chosen])
            begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            v = w[index, 1:] * x[:, None]
            sums = np.add.reduceat(v, begin, axis=0)
            margin = bias + np.add.reduceat(w[index, 0] * x, begin) + 0.5 * ((sums**2).sum(1) - np.add.reduceat((v * v).sum(1), begin))
            gap = (1 / (1 + np.exp(-np.clip(margin, -35, 35))) - labels[chosen]) / len(chosen)
            each = np.repeat(gap, lengths)
            touched, inverse = np.unique(index, return_inverse=True)
            slope = np.empty((len(touched), factors + 1))
            slope[:, 0] = np.bincount(inverse, each * x, len(touched))
            pull = (np.repeat(sums, lengths, axis=0) - v) * (each * x)[:, None]
            for f in range(factors):
                slope[:, f + 1] = np.bincount(inverse, pull[:, f], len(touched))
            slope += decay * w[touched]
            step += 1
            moment[touched] = 0.9 * moment[touched] + 0.1 * slope
            square[touched] = 0.999 * square[touched] + 0.001 * slope**2
            scale = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            w[touched] -= scale * moment[touched] / (np.sqrt(square[touched]) + 1e-8)
            bias_m, bias_s = 0.9 * bias_m + 0.1 * gap.sum(), 0.999 * bias_s + 0.001 * gap.sum() ** 2
            bias -= scale * bias_m / (np.sqrt(bias_s) + 1e-8)
    return Machine(float(bias), w[:, 0].copy(), w[:, 1:].copy())


def held_out() -> Column:
    """Rows that are never learnt from: crc32 of doc_id as text leaves 1 modulo 3."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, sample: int = SAMPLE) -> Machine:
    """A machine fitted to ``labels`` (doc_id, quality) of ``docs`` (doc_id, text)."""
    ship(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
    allowed = known.where(~held_out() if may_learn is None else may_learn)
    one = allowed.groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(features(batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([i.astype("<i4").tobytes() for i, _ in found], pa.binary()),
                    pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary()),
                ],
                names=["doc_id", "quality", "index", "value"],
            )

    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    got = joined.mapInArrow(run, "doc_id long, quality int, index binary, value binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["index"], r["value"]))
    rows = [(np.frombuffer(r["index"], "<i4").astype(np.int64), np.frombuffer(r["value"], "<f4").astype(float)) for r in got]
    return fit(rows, np.array([r["quality"] for r in got], int))


def scored(docs: DataFrame, machine: Machine, name: str = "score") -> DataFrame:
    """``docs`` with the score of each text as a further column ``name``."""
    ship(docs.sparkSession)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [machine.score(i, v) for i, v in features(batch.column(place))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is more likely of label 1 than 0."""
    name = "quality_score"
    while name in docs.columns:
        name += "_"
    return scored(docs, train(docs, labels, sample=sample), name).where(F.col(name) >= 0.5).drop(name)
