"""Report templates over a table with a day column."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.windows import period_change

# Fixed value: the lowest type partition, which matches all of them.
TYPE_FLOOR = "0000"


def filter_partition_span(
    df: DataFrame,
    start: Column | str | int | dt.date,
    end: Column | str | int | dt.date,
    day: str = "date_p",
    type_column: str | None = None,
    type_floor: str = TYPE_FLOOR,
) -> DataFrame:
    """A span of days, both ends included; plain comparisons that prune partitions."""
    span = (F.col(day) >= start) & (F.col(day) <= end)
    if type_column is not None:
        span = span & (F.col(type_column) >= type_floor)
    return df.filter(span)


def totals(measure: str, scale_type: str = "decimal(32,6)") -> list[Column]:
    return [
        F.sum(F.col(measure).try_cast(scale_type)).alias(f"total_{measure}"),
        F.count(F.lit(1)).alias("row_count"),
    ]


def range_summary(df: DataFrame, start, end, measure: str = "cost", day: str = "date_p", **partition) -> DataFrame:
    """Total and row count of a span of days."""
    return filter_partition_span(df, start, end, day, **partition).agg(*totals(measure))


def daily_summary(df: DataFrame, start, end, measure: str = "cost", day: str = "date_p", **partition) -> DataFrame:
    """R2: the same per day, in order of days."""
    return filter_partition_span(df, start, end, day, **partition).groupBy(day).agg(*totals(measure)).orderBy(day)


def cost_analysis(
    df: DataFrame,
    by: Sequence[str],
    measure: str = "cost",
    scale_type: str = "decimal(32,6)",
    average_digits: int = 6,
) -> DataFrame:
    """Total, calls and average per group."""
    value = F.col(measure).try_cast(scale_type)
    return df.groupBy(*by).agg(
        F.sum(value).alias(f"total_{measure}"),
        F.count(F.lit(1)).alias("calls"),
        F.round(F.sum(value).cast("double") / F.count(value), average_digits).alias(f"avg_{measure}"),
    )


def weekly_report(df: DataFrame, day: str, measures: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """This week, last week and change of the key measures."""
    return period_change(df, day, measures, by)


def table_profile(df: DataFrame, partition_columns: Sequence[str] = ()) -> DataFrame:
    """One row per column with type, partition flag and a sample value, in one scan.

    Each column keeps its smallest text, so the sample is the same on every run.
    """
    described = [
        F.struct(
            F.lit(position).alias("position"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("column_type"),
            F.lit(f.name in set(partition_columns)).alias("is_partition"),
            F.min(F.col(f"`{f.name}`").cast("string")).alias("sample_value"),
        )
        for position, f in enumerate(df.schema.fields)
    ]
    one_row = df.agg(*[d.alias(f"_c{i}") for i, d in enumerate(described)])
    return one_row.select(F.inline(F.array(*[f"_c{i}" for i in range(len(described))])))


def latest_matching(
    df: DataFrame, k: int, words: Sequence[str], title: str = "title", modified: Sequence[str] = ("modified",)
) -> DataFrame:
    """Rows whose title holds any of the words, newest first, at most ``k``.

    The top-k report itself; each task keeps only its own best ``k``.
    """
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(F.col(title), F.lit(word))
    return df.filter(hit).orderBy(*[F.col(m).desc() for m in modified]).limit(k)
