"""Data-quality checks (Q1-Q5). Each gives a frame of findings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import join_lookup


def null_check(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Q1: rows and nulls per column, in one scan."""
    columns = list(columns or df.columns)
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(columns)]
    )
    return counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column_name"),
                        F.col("_rows").alias("row_count"),
                        F.col(f"_n{i}").alias("null_count"),
                    )
                    for i, c in enumerate(columns)
                ]
            )
        )
    )


def duplicate_check(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q2: key values that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def range_check(df: DataFrame, column: str, low, high) -> DataFrame:
    """Q3: how many values lie below, above and inside the bounds."""
    value = F.col(column)
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(value < low).alias("below"),
        F.count_if(value > high).alias("above"),
        F.count_if(value.between(low, high)).alias("inside"),
        F.count_if(value.isNull()).alias("null_count"),
    )


def consistency_check(df: DataFrame, rule: Column) -> DataFrame:
    """Q4: rows for which a rule across columns is not true; unknown counts as broken."""
    return df.filter(~F.coalesce(rule, F.lit(False)))


def reference_check(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Q4, foreign key: child values without a parent, with their row counts.

    Child rows are counted per value first, so a hot value meets the join as one row.
    """
    used = child.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("row_count"))
    known = parent.select(F.col(parent_key).alias(key))
    return join_lookup(used, known, [key], "left_anti", distinct=True)


def reconcile(
    result: DataFrame, oracle: DataFrame, keys: Sequence[str], metrics: Sequence[str], tolerance: float = 0
) -> DataFrame:
    """Q5: rows in which two results differ, also when one side lacks the row.

    Both sides are stacked and grouped, which compares null keys as equal.
    """
    sides = [
        frame.select(*keys, *[F.col(m).cast("decimal(38,6)").alias(m) for m in metrics], F.lit(side).alias("_side"))
        for side, frame in enumerate((result, oracle))
    ]
    both = sides[0].unionByName(sides[1]).groupBy(*keys).agg(
        *[F.count_if(F.col("_side") == side).alias(f"{name}_rows") for side, name in enumerate(("result", "oracle"))],
        *[
            F.sum(F.when(F.col("_side") == side, F.col(m))).alias(f"{m}_{name}")
            for m in metrics
            for side, name in enumerate(("result", "oracle"))
        ],
    )
    differs = (F.col("result_rows") != 1) | (F.col("oracle_rows") != 1)
    for m in metrics:
        left, right = F.col(f"{m}_result"), F.col(f"{m}_oracle")
        differs = differs | (left.isNull() != right.isNull()) | F.coalesce(F.abs(left - right) > tolerance, F.lit(False))
    return both.filter(differs)


def digest(rows: DataFrame, by: Sequence[str], keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """``by, _rows, _sum, _mix``: one digest per group that the order and the partitioning of its rows do not change.

    The sum of two hashes of each row is exact, and repeated rows change it too.
    """
    shown = [F.col(m).cast("decimal(38,6)") for m in metrics]
    # a null and the value beside it must not change places unseen
    marks = [F.col(c).isNull() for c in (*keys, *metrics)]
    both = [F.xxhash64(F.lit(seed), *keys, *shown, *marks).cast("decimal(20,0)") for seed in (1, 2)]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), F.sum(both[0]).alias("_sum"), F.sum(both[1]).alias("_mix"))


def differing(result: DataFrame, oracle: DataFrame, by: Sequence[str], keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """``by`` of the groups whose digests differ, or that one side lacks; null keys are equal."""
    sides = [digest(frame, by, keys, metrics).withColumn("_side", F.lit(side)) for side, frame in enumerate((result, oracle))]
    both = sides[0].unionByName(sides[1]).groupBy(*by)
    marks = ("_rows", "_sum", "_mix")
    grouped = both.agg(F.count(F.lit(1)).alias("_sides"), *[F.min(m).alias(f"{m}_low") for m in marks], *[F.max(m).alias(f"{m}_high") for m in marks])
    same = reduce(lambda a, b: a & b, [F.col(f"{m}_low") == F.col(f"{m}_high") for m in marks], F.col("_sides") == 2)
    return grouped.filter(~same).select(*by)


def within(rows: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of the groups given; a null belongs to the group of null."""
    left, right = rows.alias("l"), groups.alias("r")
    return left.join(right, reduce(lambda a, b: a & b, [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in by]), "left_semi")


def reconcile_digest(
    result: DataFrame,
    oracle: DataFrame,
    steps: Sequence[Sequence[str]],
    keys: Sequence[str],
    metrics: Sequence[str],
    tolerance: float = 0,
) -> tuple[DataFrame, DataFrame]:
    """Q5 for large results: the findings of :func:`reconcile`, and ``step, rows_compared`` beside them.

    ``steps`` are columns that split the rows ever finer, such as ``[["date_p"], ["date_p", "kind"]]``. Of each step only the
    groups with different digests go on, so points are compared in those branches alone. Both tables should be
    stored: each step reads them again, but of a table that is partitioned by the first step's columns only
    the differing parts. Digests are a few numbers per group and are combined before their shuffle.
    """
    if not steps:
        raise ValueError("no steps given")
    sides, counts = [result, oracle], []

    def counted(step: int) -> DataFrame:
        rows = sides[0].select(F.lit(1).alias("n")).unionAll(sides[1].select(F.lit(1).alias("n")))
        return rows.agg(F.lit(step).alias("step"), F.count("n").alias("rows_compared"))

    counts.append(counted(0))
    for number, by in enumerate(steps, 1):
        groups = differing(*sides, by, keys, metrics)
        sides = [within(side, groups, by) for side in sides]
        counts.append(counted(number))
    return reconcile(*sides, keys, metrics, tolerance), reduce(DataFrame.unionAll, counts)


def falling_metrics(result: DataFrame, cell: Sequence[str], order: str, metrics: Sequence[str]) -> DataFrame:
    """Q5: points at which a cumulative metric is lower than at the point before.

    ``cell`` includes the day, so a window partition holds one day of points.
    """
    window = Window.partitionBy(*cell).orderBy(order)
    falls = reduce(lambda a, b: a | b, [F.col(m) < F.lag(m).over(window) for m in metrics])
    return result.withColumn("_falls", falls).filter("_falls").drop("_falls")
