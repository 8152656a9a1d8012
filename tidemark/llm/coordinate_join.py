"""Near-duplicates by an inverted join of MinHash signature coordinates.

A document's set is its distinct ``k``-word shingles; its signature has ``size`` MinHash
coordinates. Documents are posted under (coordinate, value) pairs, and two documents become a
candidate pair if at least ``matches`` coordinates collide. A candidate is a link if the
Jaccard likeness of the full sets is at least ``percent`` / 100.

1. Equal sets are one class, named by its smallest doc_id; one signature stands for all.
2. (coordinate, value) pairs held by a single class cannot collide and are dropped. A class
   with fewer than ``matches`` pairs left cannot reach the threshold and is skipped. That
   removes nearly all documents without a near-duplicate before any pair is formed.
3. Prefix: of the others, only the ``size - matches + 1`` rarest pairs are posted; two
   signatures with ``matches`` collisions share one of those.
4. Hub passes: every posted pair has a hub, the class whose coordinates are the most common (the original that
   copies were made from), later a random one. A class is compared with one hub, the best of its
   postings, so a pass has a pair per class at most and joins the bulk of a group of copies.
5. Rest pass: postings whose classes are in one component by then need no more comparison. In
   the others, classes of different components are joined with each other, a pair under the
   first posting it shares only. No posting is cut.

Sizes filter every join: sets as alike as asked for differ in size by no more. So does a
parity map of ``PARITY`` bits: each shingle of a set flips one bit, so two maps differ in no
more bits than there are shingles in only one of the two sets. That bound is never above the
truth and hardly below it up to some thousand shingles, so that few copies of one original
that are not alike enough become rows.

Candidates are checked on a longer signature too (skip): four bits of each of ``CELLS``
coordinates. Both are compared inside the join, so that pairs below the threshold are not even
rows. Then they are checked on the whole texts.

The thresholds of collisions are set so low that a pair at the likeness asked for misses one
with a probability below 10^-6: the collisions of such a pair are binomial.

Defined results: null and empty texts, and texts without words, have an empty set and no
links. Fewer than k words are one shingle. Rows of one doc_id are one document: it has the
links of all its texts. Rows without doc_id cannot be named in a link: they are counted, and
are kept with a null component. Links rest on 64-bit hashes of shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ship, stored
from tidemark.llm.components import components
from tidemark.llm.word_hashes import hashed_words, mix, shingles

SIZE, CELLS, PARITY = 64, 256, 1024


def _factors(size: int) -> np.ndarray:
    return mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signature(values: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """MinHash coordinates (32 bits each) of a set of well-spread 64-bit hashes."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 2048):
        least = np.minimum(least, (values[at : at + 2048, None] * factors).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32)


def cells(coordinates: np.ndarray) -> np.ndarray:
    """Four bits of every coordinate, sixteen to a number."""
    low = (coordinates & np.uint32(15)).astype(np.uint64).reshape(-1, 16)
    return (low << (np.uint64(4) * np.arange(16, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)


def parity(values: np.ndarray) -> np.ndarray:
    """``PARITY`` bits, 64 to a number, of which each of the hashes flips one."""
    odd = np.bincount((values & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, k: int, size: int = SIZE) -> DataFrame:
    """doc_id, n_shingles, h1, h2 (128 bits that name the set), coordinates, cells, parity; one row per row."""
    schema = "doc_id long, n_shingles long, h1 long, h2 long, coordinates array<int>, cells array<long>, parity array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors(max(size, CELLS))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for first, offsets, hashes in hashed_words(texts):
                n = len(offsets) - 1
                counts, names, rows = np.zeros(n, np.int64), np.zeros((n, 2), np.int64), np.zeros((n, size), np.int32)
                packed, maps = np.zeros((n, CELLS // 16), np.int64), np.zeros((n, PARITY // 64), np.int64)
                for i in range(n):
                    values = shingles(hashes[offsets[i] : offsets[i + 1]], k)
                    counts[i] = len(values)
                    if len(values):
                        names[i] = np.frombuffer(hashlib.blake2b(values.tobytes(), digest_size=16).digest(), np.int64)
                        least = signature(values, factors)
                        rows[i], packed[i], maps[i] = least[:size].view(np.int32), cells(least[:CELLS]).view(np.int64), parity(values)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (rows, packed, maps)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, n), pa.array(counts), pa.array(names[:, 0]), pa.array(names[:, 1]), *lists],
                    names=["doc_id", "n_shingles", "h1", "h2", "coordinates", "cells", "parity"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


WORDS, MAPS = [f"s{i}" for i in range(CELLS // 16)], [f"m{i}" for i in range(PARITY // 64)]


def _alike(a: str, b: str, least: int) -> Column:
    """Whether at least ``least`` cells agree in the columns with prefixes ``a`` and ``b``."""
    apart = F.lit(0)
    for word in WORDS:
        d = F.col(a + word).bitwiseXOR(F.col(b + word))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(0x1111111111111111)
        apart = apart + F.bit_count(d)
    return apart <= CELLS - least


def _near_sizes(a: str, b: str, percent: int) -> Column:
    """Whether sets of these sizes can be as alike as that."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _near_parity(a: str, b: str, percent: int) -> Column:
    """Whether sets of these sizes, of which so many shingles at least are in one only, can be as alike as that."""
    apart = F.lit(0)
    for word in MAPS:
        apart = apart + F.bit_count(F.col(a + word).bitwiseXOR(F.col(b + word)))
    return apart * (100 + percent) <= (F.col(f"{a}n") + F.col(f"{b}n")) * (100 - percent)


def _near(percent: int, least: int) -> Column:
    """Whether sides ``a`` and ``b``, as ``_side`` names them, agree in sizes, parity and cells."""
    return _near_sizes("an", "bn", percent) & _near_parity("a", "b", percent) & _alike("a", "b", least)


def _side(rows: DataFrame, x: str, *more: str | Column) -> DataFrame:
    """What the filters read of ``rows``, under names that begin with ``x``; and ``more``."""
    # Never null, so that the code made for a comparison has no checks of that and is short.
    numbers = {"doc_id": x, "n_shingles": f"{x}n"} | {w: x + w for w in MAPS + WORDS}
    return rows.select(*(F.coalesce(c, F.lit(0).cast("bigint")).alias(name) for c, name in numbers.items()), *more)


def likely(pairs: DataFrame, nodes: DataFrame, least: int, percent: int) -> DataFrame:
    """The ``pairs`` (a < b) whose sizes, parity and cells agree."""
    return pairs.join(_side(nodes, "a"), "a").join(_side(nodes, "b"), "b").where(_near(percent, least)).select("a", "b")


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The links among candidate ``pairs`` (a < b), by the full sets."""
    pairs = stored(pairs.distinct(), "coordinate-likely")
    both = [texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"t_{x}")) for x in "ab"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: list[list[np.ndarray]] = []
            for name in ("t_a", "t_b"):
                column = batch.column(batch.schema.get_field_index(name))
                sets.append([shingles(h[o[i] : o[i + 1]], k) for _, o, h in hashed_words(column) for i in range(len(o) - 1)])
            good = []
            for x, y in zip(*sets, strict=True):
                same = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    full = pairs.join(both[0], "a").join(both[1], "b").select("a", "b", "t_a", "t_b")
    return stored(full.mapInArrow(run, "a long, b long"), "coordinate-links")


def posted(nodes: DataFrame, size: int, matches: int) -> DataFrame:
    """(token, doc_id, weight): the prefix postings of classes that can reach the threshold.

    ``weight`` orders the classes under a token: how common their coordinates are.
    """
    tokens = nodes.select("doc_id", F.posexplode("coordinates").alias("c", "v")).select(
        "doc_id", (F.shiftleft(F.col("c").cast("bigint"), 32) + F.col("v").cast("bigint").bitwiseAND(0xFFFFFFFF)).alias("token")
    )
    counts = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(tokens.join(counts, "token"), "coordinate-shared")
    able = shared.groupBy("doc_id").agg(F.count("*").alias("held"), F.sum(F.log2("n")).alias("weight")).where(F.col("held") >= matches)
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("n", "token"))
    ranked = shared.join(able, "doc_id").withColumn("rank", rank)
    return ranked.where(F.col("rank") <= F.col("held") - matches + 1).select("token", "doc_id", "weight")


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("component", F.col("doc_id"))
    return rows.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def _hub_pairs(rows: DataFrame, step: int) -> DataFrame:
    """(a, b): each class with one hub at most, the best of its postings' that is not under its label."""
    order = F.col("weight") if step == 0 else F.xxhash64(F.lit(step), "doc_id").cast("double")
    top = F.max(F.struct(order.alias("w"), F.col("doc_id").alias("hub"), F.col("component").alias("hub_component")))
    tops = rows.groupBy("token").agg(top.alias("top")).select("token", "top")
    other = rows.join(tops, "token").where("component != top.hub_component")
    best = other.groupBy("doc_id").agg(F.max(F.struct("top.w", "top.hub")).alias("best"))
    return best.select(F.least("best.hub", "doc_id").alias("a"), F.greatest("best.hub", "doc_id").alias("b")).distinct()


def _rest_pairs(postings: DataFrame, spread: DataFrame, labels: DataFrame, least: int, percent: int) -> DataFrame:
    """(a, b): the likely pairs of classes in different components, each under the first posting that both are in."""
    rows = _labelled(postings, labels)
    mixed = rows.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token")
    open_rows = rows.join(mixed, "token").select("token", "doc_id", "component")
    own = open_rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    held = stored(open_rows.join(spread.join(own, "doc_id"), "doc_id"), "coordinate-open")
    sides = [_side(held, x, "token", F.col("component").alias(f"{x}p"), F.col("tokens").alias(f"{x}t")) for x in "ab"]
    near = (F.col("a") < F.col("b")) & (F.col("ap") != F.col("bp")) & _near(percent, least)
    first = F.col("token") == F.get(F.array_intersect("at", "bt"), F.lit(0))
    return sides[0].join(sides[1], "token").where(F.when(near, first).otherwise(False)).select("a", "b")


def links(nodes: DataFrame, texts: DataFrame, k: int, percent: int, size: int, matches: int, hubs: int = 2) -> DataFrame:
    """Links (a < b) between classes; whoever is connected by all links is connected by these.

    ``nodes`` has doc_id, n_shingles, coordinates, cells and parity, ``texts`` doc_id and text of the same classes.
    """
    least = threshold_at(percent / 100 + (1 - percent / 100) / 16, CELLS)
    numbers = {"cells": WORDS, "parity": MAPS}
    spread = nodes.select("doc_id", "n_shingles", *(F.get(c, F.lit(i)).alias(w) for c, words in numbers.items() for i, w in enumerate(words)))
    postings = stored(posted(nodes, size, matches), "coordinate-posted")
    found, labels = None, None
    for step in range(hubs):
        # Labels only have to say who is surely connected: here a class and the hub it was linked with.
        fresh = confirmed(likely(_hub_pairs(_labelled(postings, labels), step), spread, least, percent), texts, k, percent)
        found = fresh if found is None else found.unionByName(fresh)
        labels = components(found, "coordinate-hubs") if step == hubs - 1 else _stars_of(found)
        labels = stored(labels, "coordinate-labels")
    return found.unionByName(confirmed(_rest_pairs(postings, spread, labels, least, percent), texts, k, percent))


def _stars_of(edges: DataFrame) -> DataFrame:
    """(node, component): each node under its smallest neighbour, if that has no smaller one itself; else alone."""
    down = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
    low = down.select(F.col("node").alias("component"))
    return down.join(low, "component", "left_anti").select("node", "component")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, size: int = SIZE, matches: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text).

    ``kept`` marks the document whose doc_id names its component.
    """
    ship(docs.sparkSession)
    matches = threshold(percent, size) if matches is None else matches
    own = stored(signatures(docs, k, size), "coordinate-signatures")
    held = own.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(held.groupBy("h1", "h2").agg(F.min("doc_id").alias("head")), "coordinate-classes")
    nodes = stored(held.join(classes, ["h1", "h2"]).where("doc_id = head").select("doc_id", "n_shingles", "coordinates", "cells", "parity"), "coordinate-nodes")
    texts = docs.select(F.col("doc_id").cast("bigint"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    members = stored(held.select("doc_id", "h1", "h2").join(classes, ["h1", "h2"]).select("doc_id", "head").distinct(), "coordinate-members")
    found = links(nodes, texts, k, percent, size, matches)
    several = members.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").join(members, "doc_id").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    labels = stored(components(found.unionByName(several), "coordinate-all"), "coordinate-result")
    heads = members.groupBy("doc_id").agg(F.min("head").alias("head"))
    named = heads.join(labels.withColumnRenamed("node", "head"), "head", "left").select("doc_id", F.coalesce("component", "head").alias("found"))
    out = own.select("doc_id", "n_shingles").join(named, "doc_id", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("found", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def threshold_at(p: float, size: int) -> int:
    """The largest number of matches that ``size`` trials of chance ``p`` miss with < 10^-6."""
    if p >= 1:
        return size
    below, term = 0.0, (1 - p) ** size
    for m in range(size):
        below += term
        if below > 1e-6:
            return max(1, m)
        term *= (size - m) / (m + 1) * p / (1 - p)
    return size


def threshold(percent: int, size: int = SIZE) -> int:
    """Collisions to ask for at a likeness of ``percent`` / 100."""
    return threshold_at(percent / 100, size)
