"""Aggregation over detail rows.

Input of the functions below A1 is the output of :func:`prepare`: columns
``period, <dims>, bucket, <keys>, <sums>``, one row per detail row.
Every grouping here is one that Spark combines before the shuffle (sum, min, count),
so a value that fills a third of the table reaches each task as a few rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.amounts import amount_parts, part_names, sum_alias, tidied, totals
from tidemark.functions.cleaning import amount, dim_value, key_or_null, require_columns
from tidemark.functions.minutes import at_time, day_of_digits, digits, floor_bucket, minute_of_day, minute_of_digits, parse_day, parse_minute, period_start
from tidemark.spec import ALL_LABEL, Levels, MetricSpec, kept_sets, quote

PERIOD, BUCKET, LEVEL = "period", "bucket", "level"


def stamp_column(df: DataFrame, name: str) -> Column:
    """The time column as ``timestamp_ntz``; text and numbers go through P4."""
    kind = df.schema[name].dataType.typeName()
    if kind == "timestamp_ntz":
        return F.col(name)
    if kind in ("timestamp", "date"):
        return F.col(name).cast("timestamp_ntz")
    return parse_minute(name)


def day_column(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.typeName()
    return F.col(name).cast("date") if kind in ("date", "timestamp", "timestamp_ntz") else parse_day(name)


def with_times(df: DataFrame, stamp: tuple[str, str] | None = None, day: tuple[str, str] | None = None) -> DataFrame:
    """``stamp_column`` and ``day_column`` as columns; each is given as (new name, column).

    Text and numbers are read once per row: a generator is a step that no filter behind it goes through, which would
    else read the text again for each use of the stamp, and again for each part of it.
    """
    plain, texts, read = [], [], []
    for given, kinds, own, of_digits in (
        (stamp, ("timestamp_ntz", "timestamp", "date"), stamp_column, minute_of_digits),
        (day, ("date", "timestamp", "timestamp_ntz"), day_column, day_of_digits),
    ):
        if given is None:
            continue
        out, name = given
        if df.schema[name].dataType.typeName() in kinds:
            plain.append(own(df, name).alias(out))
        else:
            texts.append(digits(name).alias(f"{out}_text"))
            read.append(of_digits(F.col(f"{out}_text")).alias(out))
    df = df.select("*", *plain)
    for once in (texts, read):
        df = df.select("*", F.inline(F.array(F.struct(*once)))) if once else df
    return df


def as_text(df: DataFrame, name: str) -> Column:
    column = F.col(name)
    return column if df.schema[name].dataType.typeName() == "string" else column.cast("string")


def filter_day(df: DataFrame, column: str, days: Sequence[dt.date]) -> DataFrame:
    """Only the given days, written so that partitions or row groups are skipped."""
    kind = df.schema[column].dataType.typeName()
    if kind == "date":
        return df.filter(F.col(column).isin(*days))
    if kind in ("timestamp", "timestamp_ntz"):
        hit = F.lit(False)
        for day in days:
            after = F.lit(day + dt.timedelta(days=1)).cast(kind)
            hit = hit | ((F.col(column) >= F.lit(day).cast(kind)) & (F.col(column) < after))
        return df.filter(hit)
    if kind == "string":
        # the same parser as for the report's days; on a partition column it still prunes
        return df.filter(parse_day(column).isin(*days))
    return df.filter(F.col(column).isin(*[int(f"{day:%Y%m%d}") for day in days]))


def prepare(
    df: DataFrame,
    spec: MetricSpec,
    *,
    start: str | int | None = None,
    end: str | int | None = None,
    history: str = "day",
    days: Sequence[dt.date] | None = None,
) -> DataFrame:
    """Clean detail rows and give each its period and bucket.

    ``start`` and ``end`` are times of day of the first and last reported bucket.
    ``history="day"`` keeps earlier rows of the period and books them on the first
    bucket (the opening balance); ``"range"`` drops them, minute-exact at the start (P8).
    Rows after the bucket that holds ``end`` are dropped (P7).
    """
    if history not in ("day", "range"):
        raise ValueError("history must be 'day' or 'range'")
    require_columns(df, spec)
    first = minute_of_day(start, 0)
    last = minute_of_day(end, 1440 - spec.step_minutes)
    first_bucket = first - first % spec.step_minutes
    last_bucket = last - last % spec.step_minutes
    if first > last:
        raise ValueError("start lies after end")

    if days:
        df = filter_day(df, spec.day_col or spec.time_col, days) if _can_filter(df, spec) else df
    stamped = with_times(df, ("_stamp", spec.time_col), ("_day", spec.day_col) if spec.day_col else None).select(
        "_stamp",
        *(["_day"] if spec.day_col else []),
        *[dim_value(as_text(df, d), spec.label_of(d)).alias(f"_d{i}") for i, d in enumerate(spec.dims)],
        *[key_or_null(df, k, spec).alias(f"_k{i}") for i, k in enumerate(spec.distincts)],
        *[amount(s, spec.sum_type).alias(f"_s{i}") for i, s in enumerate(spec.sums)],
    ).filter(F.col("_stamp").isNotNull())
    if spec.day_col:
        # a stored day must agree with the stamp, as one day's report reads one day's rows
        stamped = stamped.filter(F.col("_day").isNotNull())
        day = F.col("_day")
    else:
        day = F.col("_stamp").cast("date")
    if days and not _can_filter(df, spec):
        stamped = stamped.filter(day.isin(*list(days)))

    rows = stamped.withColumns({BUCKET: floor_bucket("_stamp", spec.step_minutes), PERIOD: period_start(day, spec.period)})
    if spec.period == "day":
        opens, closes = at_time(PERIOD, first_bucket), at_time(PERIOD, last_bucket)
        if end is not None or spec.day_col:
            rows = rows.filter(F.col(BUCKET) <= closes)
        if history == "range":
            rows = rows.filter(F.col("_stamp") >= at_time(PERIOD, first))
        elif first_bucket or spec.day_col:
            rows = rows.withColumn(BUCKET, F.greatest(BUCKET, opens))
    elif start is not None or end is not None:
        raise ValueError("start and end are times of day; they need period='day'")
    return rows.select(
        PERIOD,
        *[F.col(f"_d{i}").alias(d) for i, d in enumerate(spec.dims)],
        BUCKET,
        *[F.col(f"_k{i}").alias(key_alias(i)) for i in range(len(spec.distincts))],
        *[F.col(f"_s{i}").alias(sum_alias(i)) for i in range(len(spec.sums))],
    )


def _can_filter(df: DataFrame, spec: MetricSpec) -> bool:
    column = spec.day_col or spec.time_col
    kind = df.schema[column].dataType.typeName()
    return spec.day_col is not None or kind in ("date", "timestamp", "timestamp_ntz")


def key_alias(i: int) -> str:
    return f"_key{i}"


def preaggregate(df: DataFrame, spec: MetricSpec, carry_max: Sequence[str] = ()) -> DataFrame:
    """A1: one row per dims, keys and bucket (and stored day), amounts added up.

    Dimension and key values stay as they are; ``carry_max`` columns keep their maximum.
    """
    require_columns(df, spec)
    keep = [*spec.dims, *spec.distincts]
    base = df.select(
        floor_bucket(stamp_column(df, spec.time_col), spec.step_minutes).alias(BUCKET),
        *([spec.day_col] if spec.day_col else []),
        *keep,
        *[F.col(s).try_cast(spec.sum_type).alias(s) for s in spec.sums],
        *[c for c in carry_max if c not in keep],
    )
    groups = [*keep, BUCKET, *([spec.day_col] if spec.day_col else [])]
    reduced = [*[F.sum(s).alias(s) for s in spec.sums], *[F.max(c).alias(c) for c in carry_max]]
    return base.groupBy(*groups).agg(*reduced) if reduced else base.select(*groups).distinct()


def _part_sums(base: DataFrame, spec: MetricSpec) -> DataFrame:
    """Added parts of the amounts per period, dims and bucket."""
    parts = amount_parts(spec)
    rows = base.selectExpr(PERIOD, *map(quote, spec.dims), BUCKET, *[f"{e} AS {n}" for n, e in parts.items()])
    return tidied(rows.groupBy(PERIOD, *spec.dims, BUCKET).agg(*[F.sum(p).alias(p) for p in parts]), spec)


def bucket_sums(base: DataFrame, spec: MetricSpec) -> DataFrame:
    """A2: sums per period, dims and bucket; exact in any order."""
    added = _part_sums(base, spec)
    return added.selectExpr(PERIOD, *map(quote, spec.dims), BUCKET, *[f"{e} AS {quote(n)}" for n, e in totals(spec).items()])


def first_seen(base: DataFrame, spec: MetricSpec, key: str) -> DataFrame:
    """A3: the earliest bucket of each key per period and dims; null keys left out."""
    name = key_alias(list(spec.distincts).index(key))
    return (
        base.filter(F.col(name).isNotNull())
        .groupBy(PERIOD, *spec.dims, F.col(name).alias(key))
        .agg(F.min(BUCKET).alias(BUCKET))
    )


def new_keys(seen: DataFrame, cell: Sequence[str], out: str) -> DataFrame:
    """A4: how many keys are first seen in each bucket of a cell."""
    return seen.groupBy(*cell, BUCKET).agg(F.count(F.lit(1)).alias(out))


def mask_levels(df: DataFrame, dims: Sequence[str], level: str = LEVEL) -> DataFrame:
    """Null the dimensions that a row's ``level`` rolls up.

    ``level`` says which ones: identity never rests on a label, so a raw value equal to
    the "all" label stays apart.
    """
    return df.withColumns({d: F.expr(f"if({rolled_up(dims, d, level)}, null, {quote(d)})") for d in dims})


def rolled_up(dims: Sequence[str], dim: str, level: str = LEVEL) -> str:
    """SQL test whether a row's level rolls up the dimension."""
    bit = 1 << (len(dims) - 1 - list(dims).index(dim))
    return f"({level} & {bit}) != 0"


def level_flag(dims: Sequence[str]) -> Column:
    """The level code out of ``grouping()`` flags, for grouping sets."""
    code = F.lit(0)
    for i, d in enumerate(dims):
        code = code + F.grouping(d).cast("int") * F.lit(1 << (len(dims) - 1 - i))
    return code.cast("int")


def cube_sums(base: DataFrame, spec: MetricSpec, levels: Levels = "cube") -> DataFrame:
    """Sums for all cells of all levels, exact in any order; the bucket is in every grouping set."""
    leaf = _part_sums(base, spec)
    always = [PERIOD, BUCKET]
    sets = [[*always, *kept] for kept in kept_sets(spec.dims, levels)]
    added = leaf.groupingSets(sets, *always, *spec.dims).agg(
        level_flag(spec.dims).alias(LEVEL), *[F.sum(p).alias(p) for p in part_names(spec)]
    )
    shown = [f"{e} AS {quote(n)}" for n, e in totals(spec).items()]
    return added.selectExpr(*always, *map(quote, spec.dims), LEVEL, *shown)


def cube_first_seen(base: DataFrame, spec: MetricSpec, key: str, levels: Levels = "cube") -> DataFrame:
    """First bucket of each key per cell; the key is in every grouping set."""
    leaf = first_seen(base, spec, key)
    always = [PERIOD, key]
    sets = [[*always, *kept] for kept in kept_sets(spec.dims, levels)]
    return leaf.groupingSets(sets, *always, *spec.dims).agg(
        level_flag(spec.dims).alias(LEVEL), F.min(BUCKET).alias(BUCKET)
    )


def cube_distinct(base: DataFrame, spec: MetricSpec, key: str, levels: Levels = "cube") -> DataFrame:
    """Keys first seen per bucket and cell. Counts of finer cells are never added."""
    seen = cube_first_seen(base, spec, key, levels)
    return new_keys(seen, [PERIOD, LEVEL, *spec.dims], spec.distincts[key])


def cell_keys(base: DataFrame, spec: MetricSpec, levels: Levels = "cube") -> DataFrame:
    """A10: the cells that occur, per period."""
    leaf = base.select(PERIOD, *spec.dims).distinct()
    sets = [[PERIOD, *kept] for kept in kept_sets(spec.dims, levels)]
    return leaf.groupingSets(sets, PERIOD, *spec.dims).agg(level_flag(spec.dims).alias(LEVEL))


def label_totals(df: DataFrame, dims: Sequence[str], label: str = ALL_LABEL, level: str = LEVEL) -> DataFrame:
    """Show the "all" label where a dimension is rolled up."""
    shown = {d: F.when(F.expr(rolled_up(dims, d, level)), label).otherwise(F.col(d)) for d in dims}
    return df.withColumns(shown) if shown else df


def dedupe_lookup(df: DataFrame, key: str) -> DataFrame:
    """One row per non-null id."""
    return df.select(key).filter(F.col(key).isNotNull()).distinct()


def fact_rollup(df: DataFrame, attributes: Sequence[str], measure: str = "cnt") -> DataFrame:
    """Group by all attributes and add up the measure."""
    return df.groupBy(*attributes).agg(F.sum(measure).alias(measure))


def union_cells(frames: Sequence[DataFrame], cell: Sequence[str]) -> DataFrame:
    """The distinct cells of several metric frames."""
    out = frames[0].select(*cell)
    for frame in frames[1:]:
        out = out.unionByName(frame.select(*cell))
    return out.distinct()
