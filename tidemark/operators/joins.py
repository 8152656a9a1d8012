"""Grids and joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.minutes import spine_points
from tidemark.operators.aggregates import BUCKET


def join_lookup(facts: DataFrame, lookup: DataFrame, on: Sequence[str], how: str, distinct: bool = False) -> DataFrame:
    """Join a large frame with a lookup of unknown size, without asking for its size beforehand.

    Adaptive execution knows the lookup's bytes when its stage has run: below the broadcast threshold it
    is broadcast. A larger one is joined by a shuffle on the key, where a hot key's rows are split by
    the tasks that wrote them, which works for identical copies too. Both are exact.
    """
    return facts.join(lookup.distinct() if distinct else lookup, list(on), how)


def grid(cells: DataFrame, opens: Column | str, closes: Column | str, step_minutes: int = 10) -> DataFrame:
    """Every cell at every point of the spine, without a cross join."""
    return cells.withColumn(BUCKET, F.explode(spine_points(opens, closes, step_minutes)))


def same_cell(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    """Null-safe equality, since rolled-up dimensions are null."""
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in columns])


def attach_buckets(points: DataFrame, metrics: DataFrame, cell: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Metric values on the grid; 0 where a bucket had none."""
    keys = [*cell, BUCKET]
    left, right = points.alias("p"), metrics.alias("m")
    matched = left.join(
        right, reduce(lambda a, b: a & b, [F.col(f"p.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]), "left"
    )
    return matched.select(
        *[F.col(f"p.{k}").alias(k) for k in keys],
        *[F.coalesce(F.col(f"m.{n}"), F.lit(0)).alias(n) for n in names],
    )


def merge_metrics(frames: Sequence[tuple[DataFrame, Sequence[str]]], keys: Sequence[str]) -> DataFrame:
    """Metric frames side by side, 0 where one has no row.

    Frames are stacked with zeros in the columns they lack and added up once, in place
    of a chain of full outer joins.
    """
    types = {n: frame.schema[n].dataType for frame, names in frames for n in names}
    stacked = [
        frame.select(
            *keys,
            *[F.coalesce(n, F.lit(0)).cast(t).alias(n) if n in names else F.lit(0).cast(t).alias(n) for n, t in types.items()],
        )
        for frame, names in frames
    ]
    return reduce(DataFrame.unionByName, stacked).groupBy(*keys).agg(*[F.sum(n).alias(n) for n in types])


def match_rules(events: DataFrame, rules: DataFrame, on: str = "event_id") -> DataFrame:
    """Each event with each rule of its kind."""
    return join_lookup(events, rules, [on], "inner")


def exists_flag(facts: DataFrame, lookup: DataFrame, key: str, flag: str, lookup_key: str | None = None) -> DataFrame:
    """1 when the id is in the lookup, else 0; ids repeated there add no rows."""
    ids = lookup.select(F.col(lookup_key or key).alias(key)).filter(F.col(key).isNotNull()).distinct()
    joined = join_lookup(facts, ids.withColumn(flag, F.lit(1)), [key], "left")
    return joined.select(*facts.columns, F.coalesce(flag, F.lit(0)).alias(flag))
