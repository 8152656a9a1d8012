"""Toxicity: maximal scoring segments of token log-odds, calibrated by extreme values.

1. Log-odds. Words are counted once per labelled document and class, as are their prefixes of 3
   to 8 bytes, in ``BUCKETS`` hashed counters. A word's share of toxic documents has a Dirichlet prior of
   weight ``PRIOR`` around the share of its longest prefix, that one around the next shorter, down to the
   share of all documents; so a word never seen is judged by its beginning. A word scores the
   log-odds of its share against that of all documents, less ``CAUTION`` standard deviations.
2. Segments. One scan over a text's running sum finds every maximal scoring segment (each
   is a best run of words and no better run overlaps it), in time linear in its words.
3. Calibration. Under texts of label 0 the best segment of n words follows an extreme-value law:
   segments of a score of at least s are expected K n exp(-lambda s) times. lambda solves E[exp(lambda score)] = 1 over the
   words of label 0, K is the mean of the law. The r best segments together have the law of
   their sum; a text's evidence is the least of those chances over r, as a negative logarithm.
   A logistic curve turns evidence into a score. lambda, K and the curve come from texts that were scored
   with the counts of the other half of the labelled documents.

Training reads all labelled rows that ``may_learn`` allows: counters, sums and histograms of a
fixed size reach the driver, whatever the number of rows. Scoring is one pass without a shuffle.

Words are runs of letters, digits and non-ASCII characters in lower case (ASCII and Latin-1).

Defined results: null and empty texts have no words, so no segment and the least score. Of several
labels of one doc_id the largest counts; null labels are not learnt from. Rows that repeat a doc_id count each.
Without any labelled row every score is 0; with one label only it is that label.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import measured, ship, stored
from tidemark.llm.word_hashes import _BASE, BLOCK, _table, mix, raw_texts

PREFIXES = (3, 4, 5, 6, 7, 8)
BUCKETS, BITS = 1 << 19, 19
#: Weight of a prior, and the part of it that either class has at least.
PRIOR, LEAST_PRIOR = 4.0, 0.5
CAUTION, LEAST_SCORE, DRIFT = 1.0, -1.0, 0.1
#: A segment is a passage if at most so many are expected in a clean text of its length.
SIGNIFICANT = 1e-3
#: Histogram bins: of word scores, and of log(1 + evidence).
SCORE_BIN, EVIDENCE_BIN = 0.05, 0.05

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _buckets(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(levels x words) buckets of ``data``, and the words before each of ``starts``, where texts begin."""
    n = len(data)
    if not n:
        return np.zeros((len(PREFIXES) + 1, 0), np.int32), np.zeros(len(starts), np.int64)
    word = _WORD[data]
    edge = np.zeros(n + 1, bool)
    edge[starts[starts <= n]] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    begin = np.flatnonzero(word & (~before | edge[:n]))
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    low = _LOWER[data]
    capital = np.zeros(n, bool)  # the second byte of a Latin-1 capital
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low[capital] += 32
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _table("up", _BASE, n), out=sums[1:])
    down = _table("down", pow(_BASE, -1, 1 << 64), n)[begin]
    own = sums[begin]
    levels = np.empty((len(PREFIXES) + 1, len(begin)), np.int32)
    for k, size in enumerate((*PREFIXES, n)):
        raw = (sums[np.minimum(end, begin + size)] - own) * down + np.uint64(k + 1)
        levels[k] = (mix(raw) >> np.uint64(64 - BITS)).astype(np.int32)
    return levels, np.searchsorted(begin, starts)


def word_buckets(column: pa.Array) -> Iterator[np.ndarray]:
    """The (levels x words) buckets of each text; long texts are cut between words into blocks."""
    data, at = raw_texts(column)
    row, n = 0, len(at) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(at, at[row] + BLOCK, side="right")) - 1)
        part = data[at[row] : at[last]]
        if last == row + 1 and len(part) > BLOCK:
            found, begin = [], 0
            while begin < len(part):
                to = min(begin + BLOCK, len(part))
                while to < len(part) and _WORD[part[to]]:
                    gaps = np.flatnonzero(~_WORD[part[to : to + BLOCK]])
                    to = to + int(gaps[0]) if len(gaps) else min(to + BLOCK, len(part))
                found.append(_buckets(part[begin:to], np.zeros(1, np.int64))[0])
                begin = to
            yield np.concatenate(found, axis=1)
        else:
            levels, offsets = _buckets(part, at[row : last + 1] - at[row])
            offsets[-1] = levels.shape[1]
            for i in range(last - row):
                yield levels[:, offsets[i] : offsets[i + 1]]
        row = last


@dataclass
class LogOdds:
    """Documents per bucket and class, and the share of all documents that is toxic."""

    toxic: np.ndarray
    clean: np.ndarray
    share: float

    def scores(self, levels: np.ndarray) -> np.ndarray:
        """The score of each word of (levels x words) buckets."""
        share = np.full(levels.shape[1], self.share)
        for own in levels:
            before = np.clip(PRIOR * share, LEAST_PRIOR, PRIOR - LEAST_PRIOR)
            yes, no = self.toxic[own] + before, self.clean[own] + (PRIOR - before)
            share = yes / (yes + no)
        gain = np.log(yes / no) - math.log(self.share / (1 - self.share))
        return np.maximum(gain - CAUTION * np.sqrt(1 / yes + 1 / no), LEAST_SCORE) - DRIFT


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(first, behind, score) of every maximal scoring segment, in order.

    Runs of positive scores are candidates. The newest one is joined with the nearest earlier one that
    begins lower as long as that one ends lower; ``lower`` links each to the nearest that begins lower, so
    none is passed twice.
    """
    up = scores > 0
    if not up.any():
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    edges = np.flatnonzero(np.diff(np.concatenate([[0], up.astype(np.int8), [0]])))
    first, behind, left, right, lower = [], [], [], [], []
    for a, b, l, r in zip(edges[::2].tolist(), edges[1::2].tolist(), sums[edges[::2]].tolist(), sums[edges[1::2]].tolist(), strict=True):
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= l:
                j = lower[j]
            if j < 0 or right[j] >= r:
                break
            a, l = first[j], left[j]
            del first[j:], behind[j:], left[j:], right[j:], lower[j:]
        first.append(a), behind.append(b), left.append(l), right.append(r), lower.append(j)
    return [(a, b, r - l) for a, b, l, r in zip(first, behind, left, right, strict=True)]


@dataclass
class Model:
    odds: LogOdds | None
    scale: float = 1.0
    log_k: float = 0.0
    intercept: float = -35.0
    slope: float = 0.0

    def evidence(self, found: np.ndarray, n: int) -> float:
        """-log of the least chance that a clean text of ``n`` words has the r best of its segment scores."""
        x = np.sort(self.scale * found - self.log_k - math.log(max(n, 1)))[::-1]
        x = x[x > 0]
        if not len(x):
            return 0.0
        r, total = np.arange(1, len(x) + 1), np.cumsum(x)
        logs = np.cumsum(np.log(r))  # log r!
        chance = -total + (r - 1) * np.log(total) - 2 * logs + np.log(r)
        return float(max(0.0, np.max(-chance - r * math.log(2))))

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-min(35.0, max(-35.0, self.intercept + self.slope * math.log1p(evidence)))))

    def judge(self, levels: np.ndarray) -> tuple[float, list[tuple[int, int, float, float]]]:
        """(score, significant passages as (first word, words, score, expected number))."""
        if self.odds is None:
            return self.score(0.0), []
        n = levels.shape[1]
        found = segments(self.odds.scores(levels))
        own = self.score(self.evidence(np.array([s for *_, s in found]), n))
        expected = [math.exp(min(700.0, self.log_k + math.log(max(n, 1)) - self.scale * s)) for *_, s in found]
        return own, [(a, b - a, s, e) for (a, b, s), e in zip(found, expected, strict=True) if e <= SIGNIFICANT]


def solve_scale(values: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of E[exp(x value)] = 1; 1 where there is none (no value above 0, or a mean not below)."""
    p = counts / max(counts.sum(), 1)
    if not (values[counts > 0] > 0).any() or (p * values).sum() >= 0:
        return 1.0
    mass = lambda x: math.log((p * np.exp(x * (values - values.max()))).sum()) + x * values.max()
    low, high = 0.0, 1.0
    while mass(high) < 0:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if mass(mid) < 0 else (low, mid)
    return high


def fit_curve(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> tuple[float, float]:
    """Intercept and slope (not below 0) of a logistic curve over binned counts, by Newton steps with a little shrinkage."""
    w = np.zeros(2)
    design = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -35, 35)))
        slope = design.T @ (toxic - (toxic + clean) * p) - 0.01 * w
        bend = (design * ((toxic + clean) * p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        move = np.linalg.solve(bend, slope)
        w += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[1] > 0 else (math.log((toxic.sum() + 0.5) / (clean.sum() + 0.5)), 0.0)


def held_out() -> Column:
    """Rows that are never learnt from: crc32 of doc_id as text is divisible by 5."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def _counted(known: DataFrame) -> tuple[list[LogOdds], LogOdds] | int:
    """Log-odds from either half of ``known`` (toxic, half, text) and from all, or the only label (0 if none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs = np.zeros((4, BUCKETS), np.int64), np.zeros(4, np.int64)
        for batch in batches:
            kinds = (2 * batch.column(1).to_numpy(zero_copy_only=False) + batch.column(0).to_numpy(zero_copy_only=False)).astype(int)
            for kind, levels in zip(kinds.tolist(), word_buckets(batch.column(2)), strict=True):
                seen[kind, np.unique(levels)] += 1
                docs[kind] += 1
        held = np.flatnonzero(seen.any(axis=0))
        for at in range(0, len(held), 1 << 16):
            part = held[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(row[part]) for row in seen)], names=["b", "n0", "n1", "n2", "n3"])
        yield pa.RecordBatch.from_arrays([pa.array([-1]), *(pa.array([int(n)]) for n in docs)], names=["b", "n0", "n1", "n2", "n3"])

    parts = known.select("toxic", "half", "text").mapInArrow(run, "b long, n0 long, n1 long, n2 long, n3 long")
    found = parts.groupBy("b").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(4))).toArrow()
    place = found.column("b").to_numpy()
    counts, docs = np.zeros((4, BUCKETS)), np.zeros(4)
    for i in range(4):
        values = found.column(f"n{i}").to_numpy()
        counts[i, place[place >= 0]] = values[place >= 0]
        docs[i] = values[place < 0].sum()
    clean, toxic = docs[0] + docs[2], docs[1] + docs[3]
    if not clean or not toxic:
        return int(toxic > 0)

    def odds(kinds: tuple[int, ...]) -> LogOdds:
        no, yes = (sum(counts[k] for k in kinds if k % 2 == c) for c in (0, 1))
        n, m = (sum(docs[k] for k in kinds if k % 2 == c) for c in (0, 1))
        return LogOdds(yes.astype(np.float32), no.astype(np.float32), float((m + 0.5) / (n + m + 1)))

    return [odds((2, 3)), odds((0, 1))], odds((0, 1, 2, 3))


def _cross_scored(known: DataFrame, other: list[LogOdds]) -> DataFrame:
    """Segment scores of every row, by the other half's counts (bin is null); and the histogram
    of the word scores of label 0 (bin, n)."""
    names = ["toxic", "n", "found", "bin"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread: dict[int, int] = {}
        for batch in batches:
            toxic, sizes, found = batch.column(0).to_pylist(), [], []
            for label, half, levels in zip(toxic, batch.column(1).to_pylist(), word_buckets(batch.column(2)), strict=True):
                scores = other[half].scores(levels)
                sizes.append(len(scores))
                found.append([s for *_, s in segments(scores)])
                if not label:
                    bins, counts = np.unique(np.floor(scores / SCORE_BIN).astype(np.int64), return_counts=True)
                    for b, c in zip(bins.tolist(), counts.tolist(), strict=True):
                        spread[b] = spread.get(b, 0) + c
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.float64())), pa.nulls(len(toxic), pa.int64())], names=names)
        n = len(spread)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.array(list(spread.values()), pa.int64()), pa.nulls(n, pa.list_(pa.float64())), pa.array(list(spread), pa.int64())], names=names)

    rows = known.select("toxic", "half", "text").mapInArrow(run, "toxic int, n long, found array<double>, bin long")
    return stored(rows, "toxic-crossed")


def train(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None) -> Model:
    """A model fitted to ``labels`` (doc_id, toxic) of ``docs`` (doc_id, text); all allowed rows count."""
    ship(docs.sparkSession)
    allowed = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out() if may_learn is None else may_learn)
    one = stored(allowed.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")), "toxic-labels")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half")
    known = docs.select("doc_id", "text").join(measured(one), "doc_id").select("toxic", half, "text")
    counted = _counted(known)
    if isinstance(counted, int):
        return Model(None, intercept=35.0 if counted else -35.0)
    halves, every = counted
    crossed = _cross_scored(known, halves)
    bins = crossed.where("bin IS NOT NULL").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    scale = solve_scale((np.array([r.bin for r in bins]) + 0.5) * SCORE_BIN, np.array([r.n for r in bins], float))
    rows = crossed.where("bin IS NULL")
    best = F.coalesce(F.array_max("found"), F.lit(0.0)) * scale - F.log("n")
    mean = rows.where("toxic = 0 AND n > 0").agg(F.avg(best)).first()[0]
    model = Model(every, scale, (mean or 0.0) - float(np.euler_gamma))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bare = Model(None, model.scale, model.log_k)
        for batch in batches:
            held = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            values = [int(math.log1p(bare.evidence(np.array(found or [0.0]), n)) / EVIDENCE_BIN) for n, found in held]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], names=["toxic", "bin"])

    binned = rows.select("toxic", "n", "found").mapInArrow(run, "toxic int, bin long").groupBy("bin").agg(F.sum("toxic").alias("yes"), F.sum(1 - F.col("toxic")).alias("no")).collect()
    x = (np.array([r.bin for r in binned]) + 0.5) * EVIDENCE_BIN
    x[x < EVIDENCE_BIN] = 0.0
    model.intercept, model.slope = fit_curve(x, np.array([r.yes for r in binned], float), np.array([r.no for r in binned], float))
    return model


def _free(names: list[str], name: str) -> str:
    while name in names:
        name += "_"
    return name


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs``, all columns, with ``score`` and ``passages``: array of (first_word, n_words, score, expected).

    A name that ``docs`` has already gets an underscore.
    """
    ship(docs.sparkSession)
    place = docs.columns.index("text")
    own, spans = _free(docs.columns, "score"), _free(docs.columns, "passages")
    kind = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("first_word", "n_words", "score", "expected")
        for batch in batches:
            judged = [model.judge(levels) for levels in word_buckets(batch.column(place))]
            found = [[dict(zip(names, p, strict=True)) for p in passages] for _, passages in judged]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s for s, _ in judged], pa.float64()), pa.array(found, kind)], names=[*batch.schema.names, own, spans])

    passage = T.ArrayType(T.StructType([T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType())]))
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(own, T.DoubleType()), T.StructField(spans, passage)]))
