"""Exact values at one point in time, without accumulation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.aggregates import BUCKET, PERIOD, key_alias, sum_alias
from tidemark.spec import MetricSpec


def exact_metrics(spec: MetricSpec) -> list[Column]:
    """Distinct keys and sums of a group; a sum over nothing is 0."""
    return [
        *[F.count_distinct(key_alias(i)).alias(out) for i, out in enumerate(spec.distincts.values())],
        *[F.coalesce(F.sum(sum_alias(i)), F.lit(0)).alias(out) for i, out in enumerate(spec.sums.values())],
    ]


def snapshot_at(base: DataFrame, spec: MetricSpec, until: Column) -> DataFrame:
    """One row with everything up to and including the bucket ``until``."""
    return base.filter(F.col(BUCKET) <= until).agg(*exact_metrics(spec))


def snapshot_by(base: DataFrame, spec: MetricSpec, by: list[str], until: Column) -> DataFrame:
    """The same per dimension value; a null value is a group of its own."""
    return base.filter(F.col(BUCKET) <= until).groupBy(*by).agg(*exact_metrics(spec))


def per_bucket(base: DataFrame, spec: MetricSpec) -> DataFrame:
    """Values inside each bucket, not cumulative."""
    return base.groupBy(PERIOD, BUCKET).agg(*exact_metrics(spec))


def two_layer_totals(base: DataFrame, spec: MetricSpec, key: str) -> DataFrame:
    """Sums per dims and key first, then keys and sums per dims."""
    name = key_alias(list(spec.distincts).index(key))
    inner = base.groupBy(PERIOD, *spec.dims, name).agg(
        *[F.sum(sum_alias(i)).alias(sum_alias(i)) for i in range(len(spec.sums))]
    )
    return inner.groupBy(PERIOD, *spec.dims).agg(
        F.count(name).alias(spec.distincts[key]),
        *[F.sum(sum_alias(i)).alias(out) for i, out in enumerate(spec.sums.values())],
    )
