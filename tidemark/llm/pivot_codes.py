"""Vector code compression: product codes whose nearest entries are searched through pivots (LAESA).

A vector's components become integers floor(``SCALE`` x) and are cut into ``PARTS`` parts. The codebook of a part
position starts as that part of the ``ENTRIES`` smallest vec_ids; ``ROUNDS`` times every part is
assigned to its nearest entry and each entry becomes the floor of the mean of its parts.

1. Of each first codebook, ``PIVOTS`` entries far from each other become fixed pivots. The distances of every
   part to them are computed once and stored with the integers.
2. A round computes the distances between pivots and entries. For a part x and an entry e, the
   largest |d(x, pivot) - d(pivot, e)| is a lower bound of d(x, e).
3. Entries are tried in the order of their bounds, and a part is done when its next bound exceeds its
   best distance. Distances are exact integers; bounds are floats, lowered by more than their error, so the entry
   found is the nearest, the lowest index among equals.

A round reduces each task's parts to counts and sums per entry and Spark adds those, so a vector that
a third of all rows repeat costs nothing extra. The driver holds the codebooks and those sums:
``ENTRIES`` times the dimensions. The integers are stored once, in the shared folder.

Defined results: rows without vector, or with a null or non-finite component, are dropped. Integers
are held within +-2^26 (components of 262,144). Shorter vectors, and lengths that ``PARTS`` does not divide,
are filled with zeros; empty vectors have distance 0 to everything. Null vec_ids come last and seed no codebook
unless there is no other; of several vectors of one vec_id the least one seeds. Repeated rows are each coded.
Fewer than ``ENTRIES`` vec_ids make smaller codebooks. ``label_error`` is null where it exceeds 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import measured, ship, stored

PARTS, ENTRIES, ROUNDS, PIVOTS, SCALE = 16, 64, 2, 4, 256
LARGEST = 1 << 26
#: Share by which a bound made of distances in single precision is lowered.
SLACK = 1e-6


def integers(vectors: list[list[float]] | np.ndarray, width: int) -> np.ndarray:
    """(rows x PARTS x width) integers; missing components are 0."""
    out = np.zeros((len(vectors), PARTS * width))
    for row, vector in zip(out, vectors, strict=True):
        row[: len(vector)] = vector
    return np.clip(np.floor(out * SCALE), -LARGEST, LARGEST).astype(np.int64).reshape(len(vectors), PARTS, width)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between the last axes."""
    gap = a - b
    return np.einsum("...i,...i->...", gap, gap)


def choose_pivots(entries: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """(parts x count x width) entries, each the farthest from those chosen before; the first entry begins."""
    out = []
    for book in entries:
        chosen = [0]
        nearest = squared(book, book[0])
        while len(chosen) < min(count, len(book)):
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, squared(book, book[chosen[-1]]))
        out.append(book[chosen])
    return np.stack(out)


def to_pivots(parts: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(rows x parts x pivots) distances in single precision."""
    return np.sqrt(squared(parts[:, :, None, :], pivots[None])).astype(np.float32)


def nearest(parts: np.ndarray, far: np.ndarray, book: np.ndarray, pivots: np.ndarray, tried: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry for the parts of one position.

    ``far`` has the distances of the parts to the ``pivots``. ``tried`` gets the number of exact distances.
    """
    entry_far = np.sqrt(squared(pivots[:, None, :], book[None])).astype(np.float32)
    own = np.arange(len(parts))
    bounds = np.zeros((len(parts), len(book)), np.float64)
    for p in range(len(pivots)):
        a, b = far[:, p, None].astype(np.float64), entry_far[p].astype(np.float64)
        np.maximum(bounds, np.abs(a - b) - SLACK * (a + b), out=bounds)
    index, best = np.zeros(len(parts), np.int64), np.full(len(parts), np.iinfo(np.int64).max)
    while len(own):
        entry = bounds[own].argmin(axis=1)
        least = bounds[own, entry]
        # the square loses less than the slack; an equal distance must still be tried for its index
        live = np.isfinite(least) & ((least * least) * (1 - SLACK) <= best[own])
        own, entry = own[live], entry[live]
        if tried is not None:
            tried.append(len(own))
        exact = squared(parts[own], book[entry])
        better = (exact < best[own]) | ((exact == best[own]) & (entry < index[own]))
        index[own[better]], best[own[better]] = entry[better], exact[better]
        bounds[own, entry] = np.inf
    return index, best


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list per row of a matrix."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(rows.ravel(), kind))


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return values.reshape(len(column), len(values) // max(1, len(column)))


class Coder:
    """Codebooks (parts x entries x width) and the pivots fixed at the start."""

    def __init__(self, books: np.ndarray, pivots: np.ndarray):
        self.books, self.pivots = books, pivots

    def assign(self, parts: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [nearest(parts[:, p], far[:, p], self.books[p], self.pivots[p]) for p in range(PARTS)]
        return np.stack([i for i, _ in found], axis=1), np.stack([d for _, d in found], axis=1)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _kept(vectors: DataFrame) -> DataFrame:
    """vec_id, vector as doubles, label; rows with a null or non-finite component are out."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    vector = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("bigint"), vector.alias("vector"), F.col("label"))
    return rows.where(F.col("vector").isNotNull() & F.forall("vector", finite))


def _prepared(kept: DataFrame, width: int, pivots: np.ndarray) -> DataFrame:
    """vec_id, label, integers and pivot distances of every vector, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                numbers = integers(part.column(1).to_pylist(), width)
                far = to_pivots(numbers, pivots)
                columns = [part.column(0), part.column(2), _lists(numbers.reshape(len(numbers), -1), pa.int32()), _lists(far.reshape(len(far), -1), pa.float32())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "numbers", "far"])

    label = kept.schema["label"].dataType.simpleString()
    return stored(kept.mapInArrow(run, f"vec_id long, label {label}, numbers array<int>, far array<float>"), "codes-prepared")


def _arrays(batch: pa.RecordBatch, width: int, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    numbers, far = (batch.column(batch.schema.get_field_index(c)) for c in ("numbers", "far"))
    return _matrix(numbers, np.int64).reshape(len(numbers), PARTS, width), _matrix(far, np.float32).reshape(len(far), PARTS, pivots.shape[1])


def _blocks(batches: Iterator[pa.RecordBatch], size: int = 4096) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _round(prepared: DataFrame, coder: Coder) -> np.ndarray:
    """The codebooks after one round: floor of the mean of each entry's parts; unused entries stay."""
    entries, width = coder.books.shape[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(PARTS * entries, np.int64), np.zeros((PARTS * entries, width), np.int64)
        for batch in _blocks(batches):
            parts, far = _arrays(batch, width, coder.pivots)
            place = (coder.assign(parts, far)[0] + np.arange(PARTS) * entries).ravel()
            counts += np.bincount(place, minlength=PARTS * entries)
            np.add.at(sums, place, parts.reshape(len(place), width))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), _lists(sums[used], pa.int64())], names=["place", "n", "sums"])

    partial = prepared.select("numbers", "far").mapInArrow(run, "place long, n long, sums array<long>")
    added = partial.groupBy("place").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)))
    books = coder.books.copy()
    for row in added.collect():
        books[row.place // entries, row.place % entries] = [row[f"s{i}"] // row.n for i in range(width)]
    return books


def coded(vectors: DataFrame) -> tuple[DataFrame, Coder | None]:
    """(vec_id, label, codes array<int>, error) of every kept row of ``vectors`` (vec_id, embedding, label), and the
    final codebooks (None without any kept row)."""
    ship(vectors.sparkSession)
    kept = _kept(vectors)
    width = -(-(kept.agg(F.max(F.size("vector"))).first()[0] or 0) // PARTS)
    ids = [r.vec_id for r in kept.where("vec_id IS NOT NULL").select("vec_id").distinct().orderBy("vec_id").limit(ENTRIES).collect()]
    seeds = [r.vector for r in kept.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy("vec_id").collect()]
    if not seeds:
        seeds = [r[0] for r in kept.agg(F.min("vector")).collect() if r[0] is not None]
    label = kept.schema["label"].dataType.simpleString()
    schema = f"vec_id long, label {label}, codes array<int>, error long"
    if not seeds:
        return vectors.sparkSession.createDataFrame([], schema), None
    books = np.ascontiguousarray(integers(seeds, width).transpose(1, 0, 2))
    pivots = choose_pivots(books)
    prepared = _prepared(kept, width, pivots)
    coder = Coder(books, pivots)
    for _ in range(ROUNDS):
        coder = Coder(_round(prepared, coder), pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            index, far = coder.assign(*_arrays(batch, width, pivots))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(index, pa.int32()), pa.array(far.sum(axis=1))], names=["vec_id", "label", "codes", "error"])

    return prepared.mapInArrow(run, schema), coder


def judged(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept row."""
    codes, coder = coded(vectors)
    rows = stored(codes, "codes-assigned")
    sums = stored(rows.groupBy(F.col("label").alias("label_")).agg(F.try_sum("error").alias("label_error")), "codes-labels")
    digits = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    joined = rows.join(measured(sums), F.col("label").eqNullSafe(F.col("label_")))
    return joined.select("vec_id", digits.alias("code"), "error", "label_error", F.lit(coder.digest() if coder else "").alias("codebooks_sha256"))
