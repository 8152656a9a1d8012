"""All levels of a wide cube from rows that add up, without a row per key and level.

A key that is in several cells of a level counts once there, in its first bucket. Counted in every leaf cell it is
in, it counts too often: a row of a key is one too many in each level whose dimensions all agree with an earlier row
of that key. For two rows these are the levels within the dimensions in which they agree, which one row of minus one, placed
on that level and added up from there, takes off everywhere. For more rows the levels taken twice are given
back (inclusion and exclusion). So every key becomes a few rows that add up, and only those go through the levels:

* ``corrections`` meet the rows of a key in one shuffle, as many as there are leaf facts of keys.
* ``cube_changes`` rolls up one dimension after the other, reduced each time to one row per cell and bucket.

A key in more than ``MOST`` leaf cells is passed on as it is and goes through the lattice of
:func:`tidemark.plans.cumulative.level_changes`; its rows in the leaf cells are taken off again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.amounts import part_names
from tidemark.operators.aggregates import BUCKET, LEVEL, PERIOD, key_alias, mask_levels
from tidemark.spec import MetricSpec, quote

#: Leaf cells of a key whose rows are compared in pairs.
MOST = 2048
#: Rows compared at a time.
CHUNK = 1 << 16
#: Dimensions of which all sets are held per row.
MOST_DIMS = 10
RANK, TAKEN, WHOLE = "_rank", "_taken", "_whole"


def repeated_levels(kinds: np.ndarray, rank: np.ndarray, n_dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, set of dimensions and how often to take it off, of rows sorted by key and bucket.

    ``kinds`` has a row of numbers per dimension, ``rank`` a row's place in its key, from 0. A set is a number with
    the bits of ``level_code``, here of the dimensions that are kept.
    """
    seen = np.zeros((1 << n_dims, len(rank)), np.int16)
    later = np.flatnonzero(rank >= 1)
    for back in range(1, int(rank.max(initial=0)) + 1):
        later = later[rank[later] >= back]
        agree = np.zeros(len(later), np.int64)
        for d in range(n_dims):
            agree |= (kinds[d, later] == kinds[d, later - back]).astype(np.int64) << (n_dims - 1 - d)
        seen[agree, later] = 1
    sets = np.arange(1 << n_dims)
    bits = [1 << d for d in range(n_dims)]
    for bit in bits:
        for s in sets[(sets & bit) == 0]:
            seen[s] |= seen[s | bit]
    for bit in bits:
        for s in sets[(sets & bit) == 0]:
            seen[s] -= seen[s | bit]
    sets_, rows = np.nonzero(seen)
    return rows, sets_, seen[sets_, rows].astype(np.int64)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    found = column.combine_chunks().dictionary_encode(null_encoding="encode")
    return (found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found).indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _reduced(rows: np.ndarray, sets: np.ndarray, times: np.ndarray, kinds: np.ndarray, place: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with one row per place, set and cell of it, where their number fits a code."""
    n_dims, code, room = len(kinds), sets.copy(), 1 << len(kinds)
    for numbers, kept in [*[(p, None) for p in place], *[(k, 1 << (n_dims - 1 - d)) for d, k in enumerate(kinds)]]:
        width = int(numbers.max(initial=0)) + 1
        room *= width
        if room >= 1 << 62:
            return rows, sets, times
        code = code * width + (numbers[rows] if kept is None else np.where(sets & kept, numbers[rows], 0))
    _, first, group = np.unique(code, return_index=True, return_inverse=True)
    total = np.zeros(len(first), np.int64)
    np.add.at(total, group, times)
    return rows[first], sets[first], total


def corrections(leaf: DataFrame, spec: MetricSpec, slot: str) -> DataFrame:
    """Rows of what the keys of leaf facts count too often: ``level`` and its cell, the slot, the bucket and how often.

    Rows marked ``_whole`` are the leaf facts of keys in more than ``MOST`` cells; those are taken off at level 0 too.
    """
    dims, keys = list(spec.dims), [key_alias(i) for i in range(len(spec.distincts))]
    own = Window.partitionBy(PERIOD, slot, *keys).orderBy(BUCKET, *spec.dims)
    facts = leaf.filter(F.col(slot) > 0).select(PERIOD, *dims, slot, *keys, BUCKET)
    ranked = facts.withColumn(RANK, F.row_number().over(own) - 1)
    schema = T.StructType(
        [*[T.StructField(f.name, f.dataType) for f in facts.schema.fields], T.StructField(LEVEL, T.IntegerType()), T.StructField(TAKEN, T.LongType()), T.StructField(WHOLE, T.BooleanType())]
    )
    n_dims, most, chunk = len(dims), MOST, CHUNK

    def placed(table: pa.Table, rows: np.ndarray, level: np.ndarray, taken: np.ndarray, whole: bool) -> Iterator[pa.RecordBatch]:
        found = table.take(pa.array(rows)).drop_columns([RANK])
        for d, name in enumerate(dims):
            gone = (level >> (n_dims - 1 - d) & 1).astype(bool)
            column = found.column(name).combine_chunks()
            cut = pa.compute.if_else(pa.array(gone), pa.scalar(None, column.type), column)
            found = found.set_column(found.schema.get_field_index(name), name, cut)
        if not whole:
            for k in keys:
                at = found.schema.get_field_index(k)
                found = found.set_column(at, k, pa.nulls(len(rows), found.schema.field(at).type))
        found = found.append_column(LEVEL, pa.array(level.astype(np.int32))).append_column(TAKEN, pa.array(taken)).append_column(WHOLE, pa.array(np.full(len(rows), whole)))
        yield from found.combine_chunks().to_batches()

    def passed(table: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = np.arange(len(table))
        yield from placed(table, rows, np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), True)
        yield from placed(table, rows, np.zeros(len(rows), np.int64), np.full(len(rows), -1), False)

    def closed(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole keys."""
        rank = table.column(RANK).to_numpy().astype(np.int64)
        starts = np.flatnonzero(rank == 0)
        sizes = np.diff(np.append(starts, len(rank)))
        large = np.repeat(sizes > most, sizes)
        if large.any():
            yield from passed(table.filter(pa.array(large)))
            table, rank = table.filter(pa.array(~large)), rank[~large]
        shared = np.repeat(sizes > 1, sizes)[~large]
        if not shared.any():
            return
        table, rank = table.filter(pa.array(shared)), rank[shared]
        kinds = np.stack([_numbers(table.column(d)) for d in dims])
        rows, sets, times = repeated_levels(kinds, rank, n_dims)
        rows, sets, times = _reduced(rows, sets, times, kinds, [_numbers(table.column(c)) for c in (PERIOD, slot, BUCKET)])
        yield from placed(table, rows, ((1 << n_dims) - 1) ^ sets, -times, False)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n_held, in_large = 0, False
        for batch in batches:
            held.append(batch)
            n_held += len(batch)
            if n_held < chunk:
                continue
            table = pa.Table.from_batches(held)
            starts = np.flatnonzero(table.column(RANK).to_numpy() == 0)
            begun = int(starts[0]) if len(starts) else len(table)
            if in_large and begun:
                yield from passed(table.slice(0, begun))
            last = int(starts[-1]) if len(starts) else len(table)
            if last > begun:
                yield from closed(table.slice(begun, last - begun))
            rest = table.slice(last)
            in_large = len(rest) > most or (in_large and not len(starts))
            if in_large and len(rest):
                yield from passed(rest)
                rest = rest.slice(len(rest))
            held = rest.combine_chunks().to_batches() if len(rest) else []
            n_held = len(rest)
        if held:
            table = pa.Table.from_batches(held)
            starts = np.flatnonzero(table.column(RANK).to_numpy() == 0)
            begun = int(starts[0]) if len(starts) else len(table)
            if begun:
                yield from passed(table.slice(0, begun))
            if begun < len(table):
                yield from closed(table.slice(begun))

    return ranked.mapInArrow(run, schema)


def cube_changes(rows: DataFrame, spec: MetricSpec, values: list[str]) -> DataFrame:
    """Rows that add up, each on a level, on all levels that roll up more dimensions."""
    place = [PERIOD, LEVEL, *spec.dims, BUCKET]
    now = rows.groupBy(*place).agg(*[F.sum(v).alias(v) for v in values])
    for i in range(len(spec.dims)):
        bit = 1 << (len(spec.dims) - 1 - i)
        both = F.expr(f"explode(if(({LEVEL} & {bit}) = 0, array({LEVEL}, {LEVEL} | {bit}), array({LEVEL})))")
        levels = now.withColumn("_to", both).drop(LEVEL).withColumnRenamed("_to", LEVEL)
        now = mask_levels(levels, spec.dims).groupBy(*place).agg(*[F.sum(v).alias(v) for v in values])
    return now


def leaf_counts(leaf: DataFrame, spec: MetricSpec, slot: str, news: list[str]) -> DataFrame:
    """Every leaf fact as a row of level 0: a key counts in each leaf cell it is in."""
    return leaf.selectExpr(PERIOD, f"0 AS {LEVEL}", *[quote(d) for d in spec.dims], BUCKET, *[f"cast({slot} = {i + 1} AS bigint) AS {n}" for i, n in enumerate(news)], *part_names(spec))


def taken_off(fixes: DataFrame, leaf: DataFrame, spec: MetricSpec, slot: str, news: list[str]) -> DataFrame:
    """``corrections`` as rows like ``leaf_counts``."""
    nothing = [F.lit(None).cast(leaf.schema[p].dataType).alias(p) for p in part_names(spec)]
    counts = [F.expr(f"if({slot} = {i + 1}, {TAKEN}, 0L)").alias(n) for i, n in enumerate(news)]
    return fixes.filter(~F.col(WHOLE)).select(PERIOD, LEVEL, *spec.dims, BUCKET, *counts, *nothing)
