"""Ordered work inside a cell, a calendar week or a session."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.minutes import step
from tidemark.functions.text import strip_space
from tidemark.operators.aggregates import BUCKET, PERIOD, first_seen, new_keys
from tidemark.spec import MetricSpec, quote


def running_sum(df: DataFrame, cell: Sequence[str], columns: Sequence[str], order: str = BUCKET) -> DataFrame:
    """Running totals per cell. Expects one row per cell and bucket."""
    window = Window.partitionBy(*cell).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({c: F.sum(c).over(window) for c in columns})


def cumulative_distinct(base: DataFrame, spec: MetricSpec, key: str) -> DataFrame:
    """A5: running distinct count at each bucket that has a new key.

    Equal to ``count(distinct key)`` over all rows up to the bucket, without keeping the
    keys of earlier buckets at hand.
    """
    cell, out = [PERIOD, *spec.dims], spec.distincts[key]
    return running_sum(new_keys(first_seen(base, spec, key), cell, out), cell, [out])


def carry_forward(df: DataFrame, cell: Sequence[str], columns: Sequence[str], order: str = BUCKET) -> DataFrame:
    """Hold the last known value over quiet buckets; 0 before the first one."""
    window = Window.partitionBy(*cell).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(window), F.lit(0)) for c in columns})


def running_spine(
    df: DataFrame,
    cell: Sequence[str],
    columns: Sequence[str],
    opens: Column,
    closes: Column,
    step_minutes: int = 10,
    order: str = BUCKET,
    shown: Mapping[str, str] | None = None,
) -> DataFrame:
    """W1 + J1 + J2 + W2 in one pass: running totals at every point of the spine.

    ``shown`` names the results and gives them as SQL over the totals, before quiet points are made; without it
    the totals themselves are the results.

    ``df`` has one row per cell and *active* bucket. Each row knows how long its total
    holds (until the next active bucket), so the quiet points are exploded from it after
    the window. The full grid is therefore never joined, sorted or shuffled; a window
    partition holds the active buckets of one cell, at most one day's worth of steps.
    """
    ordered = Window.partitionBy(*cell).orderBy(order)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one_step = step(step_minutes)
    totals = df.withColumns(
        {
            **{c: F.sum(c).over(upto) for c in columns},
            "_next": F.lead(order).over(ordered),
            "_first": F.row_number().over(ordered) == 1,
        }
    )
    if shown is not None:
        totals = totals.selectExpr(*map(quote, cell), quote(order), "_next", "_first", *[f"{e} AS {quote(n)}" for n, e in shown.items()])
        columns = list(shown)
    filled = totals.withColumn(
        "_point",
        F.explode(
            F.sequence(
                F.when(F.col("_first"), opens).otherwise(F.col(order)),
                F.coalesce(F.col("_next") - one_step, closes),
                one_step,
            )
        ),
    )
    quiet = f"_point < {quote(order)}"
    return filled.select(
        *cell,
        F.col("_point").alias(order),
        *[F.expr(f"if({quiet}, 0, {quote(c)})").alias(c) for c in columns],
    )


def period_change(
    df: DataFrame,
    day: str,
    measures: Sequence[str],
    by: Sequence[str] = (),
    rate_digits: int = 6,
) -> DataFrame:
    """This week, last week and change rate of each measure, per Monday-based week.

    Each weekly total is placed once on its own week and once on the week after, so the
    comparison is one grouping: no self-join, and a missing week is a missing base rather
    than the week before it. The rate is null without a base or with a base of zero.
    """
    monday = F.date_sub(F.col(day).cast("date"), F.weekday(F.col(day).cast("date")))
    weekly = df.groupBy(*by, monday.alias("week")).agg(*[F.sum(m).alias(m) for m in measures])
    placed = weekly.withColumn("_ahead", F.explode(F.array(F.lit(0), F.lit(7)))).withColumn(
        "week", F.date_add("week", F.col("_ahead"))
    )
    own = F.col("_ahead") == 0
    both = placed.groupBy(*by, "week").agg(
        F.max(own).alias("_own"),
        *[F.max(F.when(own, F.col(m))).alias(f"{m}_this_week") for m in measures],
        *[F.max(F.when(~own, F.col(m))).alias(f"{m}_last_week") for m in measures],
    )
    rates = {}
    for m in measures:
        this, last = F.col(f"{m}_this_week").cast("double"), F.col(f"{m}_last_week").cast("double")
        rates[f"{m}_change"] = F.when(last != 0, F.round((this - last) / last, rate_digits))
    return both.filter("_own").withColumns(rates).drop("_own")


def recent_per_session(
    df: DataFrame,
    n: int,
    session: str = "conv_id",
    order: str = "turn",
    text: str = "text",
) -> DataFrame:
    """The last ``n`` messages of each session; blank ones do not count.

    The rank filter becomes a group limit before the shuffle: of a session that fills
    a third of the table, every task sends on at most ``n`` rows.
    """
    said = df.filter(F.col(text).isNotNull() & (strip_space(text) != ""))
    latest = Window.partitionBy(session).orderBy(F.col(order).desc())
    return said.withColumn("_rank", F.row_number().over(latest)).filter(F.col("_rank") <= n).drop("_rank")
