"""Running sums and running distinct counts for every cell and bucket.

The plan, for any number of sums and keys, reads the detail rows once:

1. ``leaf_facts``: each detail row is laid out once for the sums and once per key, then
   reduced to amounts per (dims, bucket) and to the first bucket per (dims, key).
2. ``marked_facts``: amounts, and keys that occur in a single leaf cell, add up over the
   levels of a cube; only keys seen in several leaf cells do not. Keys are told apart in two
   steps, so that the cells of one key never meet in a task.
3. ``level_changes``: every level comes from a coarser-by-a-dimension chain of levels
   (``lattice``), each reduced before the next is made from it: additive rows to counts per cell and bucket, shared
   keys to the first bucket per cell and key. No row is repeated for all levels of a wide cube.
   A whole cube of more than ``WIDE`` levels is made of rows that add up only: ``wide_changes``.
4. ``running_spine``: running totals, then the quiet points are filled in.

Every reduction groups by the cell and combines before its shuffle, so neither a key in all cells nor a cell
that holds all rows is gathered anywhere.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import prod

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.amounts import amount_parts, part_names, sum_alias, tidied, totals
from tidemark.functions.cleaning import export_names
from tidemark.functions.minutes import as_date, at_time, minute_of_day, period_end
from tidemark.operators.aggregates import (
    BUCKET,
    LEVEL,
    PERIOD,
    key_alias,
    label_totals,
    mask_levels,
    prepare,
)
from tidemark.operators.windows import running_spine
from tidemark.plans import wide_cube
from tidemark.sources.shared import ensure_checkpoint_dir
from tidemark.spec import ALL_LABEL, Levels, MetricSpec, kept_sets, level_code, quote

SLOT = "_slot"
OWN_BUCKET = "_own_bucket"
LANE = "_lane"

#: Lanes that the cells of one key are spread over while they are counted.
LANES = 256
#: Cells of one key that may meet in a task.
FEW_CELLS = 100_000
#: Levels that a row is repeated for in one step of the lattice.
FAN_OUT = 8
#: Levels beyond which a whole cube is made of rows that add up only.
WIDE = 32


def cumulative(
    df: DataFrame,
    spec: MetricSpec,
    *,
    levels: Levels = "cube",
    start: str | int | None = None,
    end: str | int | None = None,
    history: str = "day",
    days: Sequence | None = None,
    all_label: str = ALL_LABEL,
    fan_out: int = FAN_OUT,
    checkpoint: bool = False,
) -> DataFrame:
    """Cumulative report: ``<dims>, level, date_minute, <metrics>, date_p``.

    ``start`` and ``end`` are times of day (``"10:00"``), ``days`` limits the days read,
    ``history`` says what happens to rows before ``start``. With more than ``fan_out`` levels they are made step by step;
    the spec's ``dim_sizes`` then say which finer level is the smallest to make one from.
    ``checkpoint=True`` writes the reduced rows to the checkpoint folder, so that a lost executor never causes the detail
    rows to be read again; it runs that first step at once, and estimates unknown sizes from those rows.
    """
    chosen_days = [as_date(d) for d in days] if days else None
    base = prepare(df, spec, start=start, end=end, history=history, days=chosen_days)
    first, last = minute_of_day(start, 0), minute_of_day(end, 1440 - spec.step_minutes)
    first, last = first - first % spec.step_minutes, last - last % spec.step_minutes

    return report_of_facts(
        leaf_facts(base, spec), spec, levels=levels, first=first, last=last, days=chosen_days, all_label=all_label, fan_out=fan_out, checkpoint=checkpoint
    )


def report_of_facts(
    leaf: DataFrame,
    spec: MetricSpec,
    *,
    levels: Levels = "cube",
    first: int = 0,
    last: int | None = None,
    days: Sequence | None = None,
    all_label: str = ALL_LABEL,
    fan_out: int = FAN_OUT,
    checkpoint: bool = False,
) -> DataFrame:
    """The report of reduced facts (``leaf_facts``) from minute ``first`` to minute ``last`` of the day."""
    last = 1440 - spec.step_minutes if last is None else last
    if checkpoint:
        ensure_checkpoint_dir(leaf.sparkSession)
        leaf = leaf.checkpoint()
    wanted = kept_sets(spec.dims, levels)
    if wanted == [tuple(spec.dims)]:
        changes = leaf_changes(leaf, spec)
    else:
        sizes = spec.dim_sizes
        if checkpoint and len(wanted) > fan_out:
            sizes = {**leaf.agg(*[F.approx_count_distinct(d).alias(d) for d in spec.dims]).first().asDict(), **sizes}
        steps = lattice(spec.dims, wanted, fan_out, sizes)
        if spec.distincts and len(wanted) > WIDE and len(wanted) == 1 << len(spec.dims) and len(spec.dims) <= wide_cube.MOST_DIMS:
            changes = wide_changes(leaf, spec, steps, checkpoint)
        else:
            changes = level_changes(marked_facts(leaf, spec), spec, steps)
    if days and not spec.dims:
        changes = with_empty_days(changes, spec, days, first)
    report = running_spine(
        changes,
        [PERIOD, LEVEL, *spec.dims],
        [*spec.distincts.values(), *part_names(spec)],
        at_time(PERIOD, first),
        at_time(period_end(PERIOD, spec.period), last),
        spec.step_minutes,
        shown={**{k: quote(k) for k in spec.distincts.values()}, **totals(spec)},
    )
    return export_names(label_totals(report, spec.dims, all_label)).select(
        *spec.dims, LEVEL, "date_minute", *spec.metric_names, "date_p"
    )


def leaf_facts(base: DataFrame, spec: MetricSpec) -> DataFrame:
    """One reduction for all metrics.

    Slot 0 rows hold the amounts of (dims, bucket); slot i rows hold the first bucket of
    (dims, key i). The layout is an UNPIVOT, which Spark runs as one Expand in the scan
    stage. Unused columns of a slot are null, so they cost next to nothing on the wire.
    """
    keys = [key_alias(i) for i in range(len(spec.distincts))]
    sums = [sum_alias(i) for i in range(len(spec.sums))]
    dims = [quote(d) for d in spec.dims]
    # each value column twice, as itself and as a null of its type; a slot uses one of them
    given = {OWN_BUCKET: BUCKET, **{k: k for k in keys}, **{s: s for s in sums}}
    rows = base.selectExpr(PERIOD, *dims, BUCKET, *[f"{e} AS {n}_some" for n, e in given.items()])
    sources = rows.selectExpr("*", *[f"if(false, {n}_some, null) AS {n}_none" for n in given])
    values = [OWN_BUCKET, *keys, *sums]
    slots = []
    for slot in range(len(keys) + 1):
        own = [OWN_BUCKET, *sums] if slot == 0 else [keys[slot - 1]]
        inputs = [f"{v}_some" if v in own else f"{v}_none" for v in values]
        slots.append(f"({', '.join(inputs)}) AS `{slot}`")
    laid_out = base.sparkSession.sql(
        f"SELECT * FROM {{rows}} UNPIVOT INCLUDE NULLS (({', '.join(values)}) FOR {SLOT} IN ({', '.join(slots)}))",
        rows=sources,
    )
    counted = " OR ".join(f"{v} IS NOT NULL" for v in (OWN_BUCKET, *keys))
    parts = amount_parts(spec)
    reduced = (
        laid_out.filter(counted)
        .selectExpr(PERIOD, *dims, f"cast({SLOT} AS int) AS {SLOT}", OWN_BUCKET, *keys, BUCKET, *[f"{e} AS {n}" for n, e in parts.items()])
        .groupBy(PERIOD, *spec.dims, SLOT, OWN_BUCKET, *keys)
        .agg(F.min(BUCKET).alias(BUCKET), *[F.sum(p).alias(p) for p in parts])
    )
    return tidied(reduced, spec)


def leaf_changes(leaf: DataFrame, spec: MetricSpec) -> DataFrame:
    """New keys and amounts per leaf cell and active bucket."""
    return leaf.groupBy(PERIOD, F.lit(0).alias(LEVEL), *spec.dims, BUCKET).agg(
        *[F.expr(f"count_if({SLOT} = {i + 1})").alias(out) for i, out in enumerate(spec.distincts.values())],
        *[F.sum(p).alias(p) for p in part_names(spec)],
    )


def key_identity(spec: MetricSpec) -> list[str]:
    return [PERIOD, SLOT, OWN_BUCKET, *[key_alias(i) for i in range(len(spec.distincts))]]


def new_names(spec: MetricSpec) -> list[str]:
    return [f"_new{i}" for i in range(len(spec.distincts))]


def shared_key(spec: MetricSpec) -> list[str]:
    return ["_shared_slot", *[f"_shared{key_alias(i)}" for i in range(len(spec.distincts))]]


def marked_facts(leaf: DataFrame, spec: MetricSpec, lanes: int = LANES) -> DataFrame:
    """Leaf facts as rows of level 0: new keys and amounts, and the key where it is shared.

    A key is shared if it is in several leaf cells. Its rows first meet in ``lanes`` lanes, by
    a hash of the cell: two in one lane prove it. One row of each lane then meets those of the key's other lanes; the rest
    go on, spread by cell. So no task gathers the cells of a key. The lanes are left out where ``dim_sizes`` bound the cells of
    a key by ``FEW_CELLS``. Rows meet by a hash of the key: a collision can only make a key look shared,
    which gives the same result.
    """
    keys = [key_alias(i) for i in range(len(spec.distincts))]
    if not keys:
        return leaf.withColumns({LEVEL: F.lit(0), **{n: F.lit(None).cast("int") for n in shared_key(spec)}, OWN_BUCKET: F.col(BUCKET)})
    cell = F.xxhash64(*spec.dims)
    # amounts never meet a key; they are spread by cell and bucket
    rows = leaf.withColumn("_key", F.when(F.col(SLOT) > 0, F.xxhash64(*key_identity(spec))).otherwise(F.xxhash64(BUCKET, *spec.dims)))
    lane, near = "_key", "false"
    if prod(spec.dim_sizes.get(d, FEW_CELLS + 1) for d in spec.dims) > FEW_CELLS:
        lane, near = LANE, "_near"
        laned = Window.partitionBy("_key", F.pmod(cell, F.lit(lanes))).orderBy("_cell")
        ranked = rows.withColumn("_cell", cell).withColumns({"_rank": F.row_number().over(laned), "_more": F.lead(F.lit(True)).over(laned)})
        rows = ranked.selectExpr("*", "_rank > 1 OR _more IS NOT NULL AS _near", f"if(_rank > 1, xxhash64(_key, _cell), _key) AS {LANE}")
    counted = rows.withColumn("_several", F.count(F.lit(1)).over(Window.partitionBy(lane)) > 1)
    shared = f"{SLOT} > 0 AND ({near} OR _several)"
    return counted.selectExpr(
        PERIOD,
        f"0 AS {LEVEL}",
        *[quote(d) for d in spec.dims],
        f"if({shared}, null, {BUCKET}) AS {OWN_BUCKET}",
        *[f"if({shared}, {c}, null) AS {n}" for c, n in zip([SLOT, *keys], shared_key(spec))],
        BUCKET,
        *[f"cast(NOT ({shared}) AND {SLOT} = {i + 1} AS bigint) AS {n}" for i, n in enumerate(new_names(spec))],
        *part_names(spec),
    )


def lattice(
    dims: Sequence[str], wanted: Sequence[Sequence[str]], fan_out: int = FAN_OUT, sizes: Mapping[str, int] | None = None
) -> list[dict[int, list[int]]]:
    """Steps of {finer level: levels made from it}; the first makes them from the facts, level 0 among them.

    With at most ``fan_out`` levels one step makes all. Otherwise a level is made, in the step after, from the smallest
    finer one there is.
    """
    codes = [level_code(dims, kept) for kept in wanted]
    if len(codes) <= fan_out:
        return [{0: codes}]
    size = {d: max(1, (sizes or {}).get(d, 2)) for d in dims}

    def cells(code: int) -> tuple[float, int]:
        n, left = 1.0, 0
        for i, d in enumerate(dims):
            if not code >> (len(dims) - 1 - i) & 1:
                n, left = n * size[d], left + 1
        return n, left

    made: dict[int, int] = {0: 0}
    steps: list[dict[int, list[int]]] = []
    for code in sorted(set(codes) - {0}, key=lambda c: (c.bit_count(), c)):
        finer = min((p for p in made if p & code == p), key=lambda p: (*cells(p), p))
        made[code] = made[finer] + 1
        while len(steps) < made[code]:
            steps.append({})
        steps[made[code] - 1].setdefault(finer, []).append(code)
    if 0 in codes:
        steps[0][0].insert(0, 0)
    return steps


def level_changes(facts: DataFrame, spec: MetricSpec, steps: Sequence[Mapping[int, Sequence[int]]]) -> DataFrame:
    """New keys and amounts per cell and active bucket, for the levels of a ``lattice``."""
    sums, news = part_names(spec), new_names(spec)
    own = [PERIOD, LEVEL, *spec.dims, OWN_BUCKET, *shared_key(spec)]
    levels, now = [], facts
    for children in steps:
        choice = " ".join(f"WHEN {finer} THEN array({', '.join(map(str, made))})" for finer, made in children.items())
        # Not explode and no ELSE: Spark would push a filter on the level below the reduction before, which two
        # branches then no longer share.
        again = F.expr(f"explode_outer(CASE {LEVEL} {choice} END)")
        placed = now.withColumn("_to", again).drop(LEVEL).withColumnRenamed("_to", LEVEL).filter(f"{LEVEL} IS NOT NULL")
        now = mask_levels(placed, spec.dims).groupBy(*own).agg(F.min(BUCKET).alias(BUCKET), *[F.sum(v).alias(v) for v in (*news, *sums)])
        levels.append(now)
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every.groupBy(PERIOD, LEVEL, *spec.dims, BUCKET).agg(
        *[
            F.expr(f"sum(if(_shared_slot IS NULL, {n}, cast(_shared_slot = {i + 1} AS bigint)))").alias(out)
            for i, (n, out) in enumerate(zip(news, spec.distincts.values()))
        ],
        *[F.sum(p).alias(p) for p in sums],
    )


def wide_changes(leaf: DataFrame, spec: MetricSpec, steps: Sequence[Mapping[int, Sequence[int]]], checkpoint: bool = False) -> DataFrame:
    """``level_changes`` for all levels of a wide cube: keys as rows that add up (:mod:`tidemark.plans.wide_cube`).

    Only keys in very many leaf cells go through the ``lattice``.
    """
    news, parts = new_names(spec), part_names(spec)
    keys = [key_alias(i) for i in range(len(spec.distincts))]
    fixes = wide_cube.corrections(leaf, spec, SLOT)
    fixes = fixes.groupBy(PERIOD, LEVEL, *spec.dims, SLOT, *keys, BUCKET, wide_cube.WHOLE).agg(F.sum(wide_cube.TAKEN).alias(wide_cube.TAKEN))
    if checkpoint:
        fixes = fixes.checkpoint()
    rows = wide_cube.leaf_counts(leaf, spec, SLOT, news).unionByName(wide_cube.taken_off(fixes, leaf, spec, SLOT, news))
    added = wide_cube.cube_changes(rows, spec, [*news, *parts]).withColumnsRenamed(dict(zip(news, spec.distincts.values())))
    whole = fixes.filter(wide_cube.WHOLE)
    if checkpoint and whole.isEmpty():
        return added
    shared = whole.select(
        PERIOD,
        LEVEL,
        *spec.dims,
        F.lit(None).cast(leaf.schema[BUCKET].dataType).alias(OWN_BUCKET),
        *[F.col(c).alias(n) for c, n in zip([SLOT, *keys], shared_key(spec))],
        BUCKET,
        *[F.lit(0).cast("bigint").alias(n) for n in news],
        *[F.lit(None).cast(leaf.schema[p].dataType).alias(p) for p in parts],
    )
    every = added.unionByName(level_changes(shared, spec, steps))
    return every.groupBy(PERIOD, LEVEL, *spec.dims, BUCKET).agg(*[F.sum(c).alias(c) for c in (*spec.distincts.values(), *parts)])


def with_empty_days(changes: DataFrame, spec: MetricSpec, days: Sequence, first_minute: int) -> DataFrame:
    """Without dimensions, a requested day without rows is a row of zeros."""
    spark = changes.sparkSession
    values = [*spec.distincts.values(), *part_names(spec)]
    zeros = spark.createDataFrame([(d,) for d in days], "period date").select(
        PERIOD,
        F.lit(0).alias(LEVEL),
        at_time(PERIOD, first_minute).alias(BUCKET),
        *[F.lit(0).cast(changes.schema[m].dataType).alias(m) for m in values],
    )
    return (
        changes.unionByName(zeros)
        .groupBy(PERIOD, LEVEL, BUCKET)
        .agg(*[F.sum(m).cast(changes.schema[m].dataType).alias(m) for m in values])
    )
