"""The report against brute force, and each point on which implementations may disagree."""

from __future__ import annotations

import datetime as dt
import math
import random
from decimal import Decimal
from itertools import product

import pytest
from conftest import records
from pyspark.sql import functions as F

from tidemark import MetricSpec, cumulative, kept_sets
from tidemark.operators import aggregates
from tidemark.plans import cumulative as cumulative_plan
from tidemark.plans import wide_cube
from tidemark.plans.cumulative import lattice, leaf_facts, level_changes, marked_facts
from tidemark.spec import level_code

ROWS = "a string, b string, c string, uid string, oid bigint, cost double, ts timestamp_ntz"


def make_rows(seed: int, n: int = 400, days: int = 2):
    """Skewed rows: one user holds a third of them, some keys and dimensions are missing."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append(
            (
                rng.choice(["x", "y", "z", None]),
                rng.choice(["p", "q", ""]),
                rng.choice(["整体", "m", "n"]),
                "hot" if rng.random() < 0.34 else rng.choice([f"u{rng.randrange(30)}", None, " ", "null"]),
                i if rng.random() < 0.9 else None,
                round(rng.uniform(0, 10), 2),
                dt.datetime(2024, 3, 9 + rng.randrange(days)) + dt.timedelta(minutes=rng.randrange(1440)),
            )
        )
    return rows


def brute_force(rows, dims, first, last, history="day"):
    """Counted point by point in plain Python."""
    index = {"a": 0, "b": 1, "c": 2}
    shown = [
        (*[("未知" if r[index[d]] in (None, "") else r[index[d]]) for d in dims], r[3], r[4], Decimal(str(r[5])), r[6])
        for r in rows
    ]
    out = {}
    for day in sorted({r[-1].date() for r in shown}):
        opens = dt.datetime.combine(day, dt.time()) + dt.timedelta(minutes=first)
        closes = dt.datetime.combine(day, dt.time()) + dt.timedelta(minutes=last - last % 10 + 9, seconds=59)
        today = [r for r in shown if r[-1].date() == day and r[-1] <= closes and (history == "day" or r[-1] >= opens)]
        for mask in product([False, True], repeat=len(dims)):
            cells = {tuple(None if m else v for m, v in zip(mask, r)) for r in today}
            code = sum(1 << (len(dims) - 1 - i) for i, m in enumerate(mask) if m)
            for cell in cells:
                mine = [r for r in today if all(v is None or v == w for v, w in zip(cell, r))]
                for minute in range(first - first % 10, last + 1, 10):
                    point = dt.datetime.combine(day, dt.time()) + dt.timedelta(minutes=minute)
                    seen = [r for r in mine if r[-1] < point + dt.timedelta(minutes=10)]
                    users = {r[-4] for r in seen} - {None, " ", "null"}
                    orders = {r[-3] for r in seen} - {None}
                    name = tuple("整体" if v is None else v for v in cell)
                    out[(*name, code, f"{point:%Y%m%d%H%M}")] = (len(users), len(orders), sum(r[-2] for r in seen))
    return out


def as_dict(report, dims):
    return {
        (*[r[d] for d in dims], r["level"], r["date_minute"]): (r["users"], r["orders"], r["cost"])
        for r in report.collect()
    }


def spec_of(dims, sum_type="decimal(32,6)", **options):
    sums, keys = {"cost": "cost"}, {"uid": "users", "oid": "orders"}
    return MetricSpec(dims=dims, sums=sums, distincts=keys, time_col="ts", sum_type=sum_type, **options)


@pytest.mark.parametrize("dims", [["a"], ["a", "b", "c"]])
@pytest.mark.parametrize("fan_out", [8, 1])
def test_cube_equals_brute_force(spark, dims, fan_out, zone):
    """Also where a raw value equals the "all" label, on a clock-change day, and with
    levels made one from another."""
    rows = make_rows(len(dims))
    report = cumulative(
        spark.createDataFrame(rows, ROWS), spec_of(dims), start="01:00", end="06:00", fan_out=fan_out
    )
    assert as_dict(report, dims) == brute_force(rows, dims, 60, 360)


def test_range_history_drops_earlier_rows(spark):
    rows = make_rows(7)
    report = cumulative(spark.createDataFrame(rows, ROWS), spec_of(["a"]), start="01:05", end="06:07", history="range")
    want = brute_force(rows, ["a"], 65, 367, history="range")
    assert as_dict(report, ["a"]) == want


def test_opening_balance_is_carried(spark):
    rows = spark.createDataFrame(
        [("x", None, None, "u1", 1, 5.0, dt.datetime(2024, 1, 1, 3, 0)), ("x", None, None, "u2", 2, 1.0, dt.datetime(2024, 1, 1, 12, 11))],
        ROWS,
    )
    got = records(cumulative(rows, spec_of(["a"]), levels="leaf", start="12:00", end="12:20"), "date_minute")
    assert [(r["users"], r["cost"]) for r in got] == [(1, 5), (2, 6), (2, 6)]


def test_last_bucket_is_whole(spark):
    rows = spark.createDataFrame([("x", None, None, "u1", 1, 5.0, dt.datetime(2024, 1, 1, 1, 8))], ROWS)
    got = records(cumulative(rows, spec_of(["a"]), levels="leaf", start="01:00", end="01:03"), "date_minute")
    assert [r["users"] for r in got] == [1]


def test_full_day_has_144_points_even_when_the_clock_changes(spark, zone):
    rows = spark.createDataFrame([("x", None, None, "u1", 1, 5.0, dt.datetime(2024, 3, 10, 2, 30))], ROWS)
    got = records(cumulative(rows, spec_of(["a"]), levels="leaf"), "date_minute")
    assert len(got) == len({r["date_minute"] for r in got}) == 144
    assert [r["users"] for r in got] == [0] * 15 + [1] * 129


def test_days_start_again(spark):
    rows = spark.createDataFrame(
        [("x", None, None, "u1", 1, 5.0, dt.datetime(2024, 1, d, 1, 0)) for d in (1, 2)], ROWS
    )
    got = cumulative(rows, spec_of(["a"]), levels="leaf", start="01:00", end="01:00").collect()
    assert [(r["users"], r["cost"]) for r in got] == [(1, 5), (1, 5)]


def test_no_rows(spark):
    empty = spark.createDataFrame([], ROWS)
    assert cumulative(empty, spec_of(["a"])).count() == 0
    zeros = records(cumulative(empty, spec_of([]), days=[20240101], start="00:00", end="00:20"), "date_minute")
    assert [(r["date_minute"], r["users"], r["cost"]) for r in zeros] == [
        ("202401010000", 0, 0),
        ("202401010010", 0, 0),
        ("202401010020", 0, 0),
    ]


def test_no_dims_without_null_keys(spark):
    rows = make_rows(3)
    report = cumulative(spark.createDataFrame(rows, ROWS), spec_of([]), start="00:00", end="03:00")
    assert as_dict(report, []) == brute_force(rows, [], 0, 180)


def test_only_keys_or_only_sums(spark):
    rows = spark.createDataFrame(make_rows(11), ROWS)
    both = cumulative(rows, spec_of(["a", "b"]), start="05:00", end="05:30")
    keys = MetricSpec(dims=["a", "b"], distincts={"uid": "users"}, time_col="ts")
    sums = MetricSpec(dims=["a", "b"], sums={"cost": "cost"}, time_col="ts", sum_type="decimal(32,6)")
    for spec in (keys, sums):
        alone = cumulative(rows, spec, start="05:00", end="05:30")
        columns = ["a", "b", "level", "date_minute", *spec.metric_names]
        assert sorted(map(tuple, alone.select(*columns).collect())) == sorted(map(tuple, both.select(*columns).collect()))


def test_rollup_and_chosen_levels_are_parts_of_the_cube(spark):
    rows = spark.createDataFrame(make_rows(5), ROWS)
    spec = spec_of(["a", "b"])
    cube = set(map(tuple, cumulative(rows, spec, start="05:00", end="05:30").collect()))
    for levels in ("leaf", "rollup", [["b"]], [[], ["a", "b"]]):
        part = set(map(tuple, cumulative(rows, spec, levels=levels, start="05:00", end="05:30").collect()))
        codes = {level_code(spec.dims, kept) for kept in kept_sets(spec.dims, levels)}
        assert part == {r for r in cube if r[2] in codes}


def test_checkpoint_changes_nothing(spark):
    rows = spark.createDataFrame(make_rows(6), ROWS)
    spec = spec_of(["a", "b"])
    plain = sorted(map(str, cumulative(rows, spec, start="05:00", end="05:30").collect()))
    assert plain == sorted(map(str, cumulative(rows, spec, start="05:00", end="05:30", checkpoint=True).collect()))


@pytest.mark.parametrize("fan_out", [1, 4])
def test_checkpoint_with_steps(spark, fan_out):
    rows = make_rows(8)
    report = cumulative(
        spark.createDataFrame(rows, ROWS),
        spec_of(["a", "b"]),
        start="02:00",
        end="04:00",
        checkpoint=True,
        fan_out=fan_out,
    )
    assert as_dict(report, ["a", "b"]) == brute_force(rows, ["a", "b"], 120, 240)


def test_large_sums_do_not_overflow(spark):
    rows = spark.createDataFrame(
        [("x", None, None, "u1", i, 999_999_999_999.0, dt.datetime(2024, 1, 1)) for i in range(50)], ROWS
    )
    got = cumulative(rows, spec_of(["a"]), start="00:00", end="00:00").collect()
    assert {r["cost"] for r in got} == {Decimal(50 * 999_999_999_999)}


def test_bad_amounts_count_as_zero(spark):
    rows = spark.createDataFrame(
        [("x", "1.5", "202401010000"), ("x", "n/a", "202401010000"), ("x", None, "202401010000")],
        "a string, cost string, time_minute string",
    )
    spec = MetricSpec(dims=["a"], sums={"cost": "cost"})
    assert cumulative(rows, spec, levels="leaf", start="00:00", end="00:00").first()["cost"] == Decimal("1.5")


@pytest.mark.parametrize("lanes", [1, 2, 5, 256])
def test_only_shared_keys_keep_their_identity(spark, lanes):
    """A key in one leaf cell becomes a count there; one in two cells stays a key, whatever the lanes."""
    rows = [("x", "p", "m", "single", None, 1.0, dt.datetime(2024, 1, 1))]
    rows += [(a, "p", "m", "both", None, 1.0, dt.datetime(2024, 1, 1, 0, m)) for a, m in (("x", 0), ("y", 10))]
    rows += [(f"c{i}", f"d{n}", "m", f"{n} cells", None, 1.0, dt.datetime(2024, 1, 1)) for n in range(2, 9) for i in range(n)]
    rows += [(f"a{i}", f"b{i % 7}", "m", "everywhere", None, 1.0, dt.datetime(2024, 1, 1, 0, i % 60)) for i in range(200)]
    spec = MetricSpec(dims=["a", "b"], distincts={"uid": "users"}, time_col="ts")
    facts = marked_facts(leaf_facts(aggregates.prepare(spark.createDataFrame(rows, ROWS), spec), spec), spec, lanes)
    assert facts.agg(F.sum("_new0")).first()[0] == 1
    kept = {r["_shared_key0"]: r["count"] for r in facts.filter("_shared_slot = 1").groupBy("_shared_key0").count().collect()}
    assert kept == {"both": 2, "everywhere": 200, **{f"{n} cells": n for n in range(2, 9)}}
    total = level_changes(facts, spec, lattice(spec.dims, kept_sets(spec.dims))).filter("level = 3").agg(F.sum("users")).first()[0]
    assert total == 10


def test_no_task_gathers_a_key_in_all_cells(spark, monkeypatch):
    cells = spark.range(60_000).select(
        (F.col("id") % 300).cast("string").alias("a"), F.floor(F.col("id") / 300).cast("string").alias("b"), F.lit("everywhere").alias("uid"), F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("ts")
    )
    spec = MetricSpec(dims=["a", "b"], distincts={"uid": "users"}, time_col="ts")
    options = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "32"}
    before = {k: spark.conf.get(k) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    facts = marked_facts(leaf_facts(aggregates.prepare(cells, spec), spec), spec)
    rows = sorted(r["count"] for r in facts.groupBy(F.spark_partition_id()).count().collect())
    top = cumulative(cells, spec, start="00:00", end="00:00").filter("level = 3").collect()
    for k, v in before.items():
        spark.conf.set(k, v)
    assert sum(rows) == 120_000 and len(rows) == 32 and rows[-1] < 4 * rows[16]
    assert [r["users"] for r in top] == [1]


def test_lattice_makes_every_level_once_from_the_smallest_finer_one():
    dims = list("abcdefg")
    for sizes in (None, {d: 2 + i for i, d in enumerate(dims)}):
        steps = lattice(dims, kept_sets(dims), 8, sizes)
        made, there = [], {0}
        assert steps[0][0].pop(0) == 0
        for step in steps:
            assert set(step) <= there
            for finer, codes in step.items():
                assert len(codes) <= len(dims) and all(c & finer == finer != c and (c ^ finer).bit_count() == 1 for c in codes)
                made += codes
            there |= {c for codes in step.values() for c in codes}
        assert sorted(made) == list(range(1, 128)) and len(steps) == 7
    # without g, the most values are gone: levels are made from those that lack it where they can
    assert all(finer & 1 for step in steps for finer, codes in step.items() for c in codes if c & 1 and (c ^ 1) and c != 1)
    assert lattice(dims, kept_sets(dims, [["a"], []]), 1) == [{0: [63]}, {63: [127]}]
    assert lattice(["a", "b"], kept_sets(["a", "b"])) == [{0: [0, 1, 2, 3]}]


def test_wide_cube_equals_brute_force(spark):
    rows = make_rows(21, n=150, days=1)
    spec = spec_of(["a", "b", "c"])
    wide = MetricSpec(dims=[*"abc", *"defg"], sums=spec.sums, distincts=spec.distincts, time_col="ts", sum_type=spec.sum_type)
    df = spark.createDataFrame(rows, ROWS).withColumns({d: F.col("abc"[i % 3]) for i, d in enumerate("defg")})
    levels = [(*k, *"d") for k in kept_sets("abc")] + kept_sets("abc") + [tuple("abcdefg")]
    report = cumulative(df, wide, levels=levels, start="06:00", end="07:00", fan_out=2)
    got = {k: v for k, v in as_dict(report.filter("level & 15 = 15").withColumn("level", F.expr("level >> 4")), ["a", "b", "c"]).items()}
    assert got == brute_force(rows, ["a", "b", "c"], 360, 420)


@pytest.mark.parametrize("most, chunk, checkpoint", [(2048, 1 << 16, False), (2048, 40, True), (3, 7, True), (1, 40, False)])
def test_wide_cube_of_rows_that_add_up(spark, monkeypatch, most, chunk, checkpoint):
    """Keys in several cells, compared in pairs or, in more cells than that, through the lattice."""
    monkeypatch.setattr(cumulative_plan, "WIDE", 4)
    monkeypatch.setattr(wide_cube, "MOST", most)
    monkeypatch.setattr(wide_cube, "CHUNK", chunk)
    rows = [(*r[:4], r[4] and r[4] % 90, *r[5:]) for r in make_rows(31)]
    report = cumulative(spark.createDataFrame(rows, ROWS), spec_of(["a", "b", "c"]), start="01:00", end="06:00", fan_out=2, checkpoint=checkpoint)
    assert as_dict(report, ["a", "b", "c"]) == brute_force(rows, ["a", "b", "c"], 60, 360)


def test_no_key_of_a_wide_cube_is_repeated_for_the_levels(spark):
    """Ten rows of one key and seven dimensions: what is taken off is far fewer rows than 128 levels each."""
    dims = [*"abcdefg"]
    rng = random.Random(3)
    rows = [(*[rng.choice("xy") for _ in dims], "k", dt.datetime(2024, 1, 1, 0, i)) for i in range(10)]
    spec = MetricSpec(dims=dims, distincts={"uid": "users"}, time_col="ts")
    df = spark.createDataFrame(rows, ", ".join([*[f"{d} string" for d in dims], "uid string", "ts timestamp_ntz"]))
    report = cumulative(df, spec, start="00:00", end="00:00")
    assert [r["users"] for r in report.filter("level = 127").collect()] == [1]
    cells = sum(len({tuple(v for i, v in enumerate(r[:7]) if not level >> (6 - i) & 1) for r in rows}) for level in range(128))
    assert report.agg(F.sum("users")).first()[0] == report.count() == cells
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
    fixes = wide_cube.corrections(leaf_facts(aggregates.prepare(df, spec), spec), spec, "_slot")
    assert fixes.count() < cells / 4


@pytest.mark.parametrize("parts", [1, 7])
def test_double_amounts_add_up_exactly(spark, parts):
    """Equal to the correctly rounded sum, however rows are dealt; nothing becomes 0."""
    pick = random.Random(5)
    values = [pick.choice([-1, 1]) * pick.uniform(1, 10) * 10.0 ** pick.randint(-9, 30) for _ in range(600)]
    values += [0.1] * 50 + [1e30, -1e30, 4e-7, 1e26, 1e300, -1e300, 1e-300, math.nan, None]
    pick.shuffle(values)
    made = [(pick.choice("xyz"), "p", "m", "u", i, v, dt.datetime(2024, 1, 1, 0, pick.randrange(30))) for i, v in enumerate(values)]
    df = spark.createDataFrame(made, ROWS).repartition(parts)
    spec = spec_of(["a"], sum_type="double")
    for fan_out in (1, 8):
        got = {(r["a"], r["date_minute"][-2:]): r["cost"] for r in cumulative(df, spec, start="00:00", end="00:20", fan_out=fan_out).collect()}
        for cell in ("x", "y", "z", "整体"):
            for minute in (0, 10, 20):
                own = [r[5] for r in made if (cell in (r[0], "整体")) and r[6].minute < minute + 10 and r[5] is not None and r[5] == r[5]]
                assert got[cell, f"{minute:02d}"] == math.fsum(own)
    base = aggregates.prepare(df, spec)
    per_cell = {(r.a, r.bucket.minute): r.cost for r in aggregates.bucket_sums(base, spec).collect()}
    cubed = {(r.a, r.bucket.minute): r.cost for r in aggregates.cube_sums(base, spec).collect()}
    assert all(cubed[k] == v for k, v in per_cell.items()) and len(cubed) == 12
    assert cubed[None, 0] == math.fsum(r[5] for r in made if r[6].minute < 10 and r[5] is not None and r[5] == r[5])


def test_infinite_amounts(spark):
    df = spark.createDataFrame([("x", None, None, "u", 1, v, dt.datetime(2024, 1, 1)) for v in (math.inf, 1.0, 5e-324)], ROWS)
    got = cumulative(df, spec_of(["a"], sum_type="double"), start="00:00", end="00:00")
    assert {r.cost for r in got.collect()} == {math.inf}
    assert {r.cost for r in cumulative(df.where("cost < 1"), spec_of(["a"], sum_type="double"), start="00:00", end="00:00").collect()} == {5e-324}


def test_all_missing_columns_in_one_error(spark):
    rows = spark.createDataFrame([("x",)], "a string")
    with pytest.raises(ValueError, match=r"metric columns missing: \['uid', 'oid', 'cost'\].*dimension columns missing: \['b'\]"):
        cumulative(rows, spec_of(["a", "b"]))


@pytest.mark.parametrize(
    "options",
    [
        {},
        {"sums": {"a": "x"}, "period": "week"},
        {"sums": {"a": "x"}, "step_minutes": 7},
        {"sums": {"a": "x"}, "distincts": {"b": "x"}},
    ],
)
def test_bad_specs(options):
    with pytest.raises(ValueError):
        MetricSpec(**options)


def test_bad_ranges(spark):
    rows = spark.createDataFrame([], ROWS)
    for options in ({"start": "25:00"}, {"start": "10:00", "end": "09:00"}, {"history": "all"}, {"levels": "most"}):
        with pytest.raises(ValueError):
            cumulative(rows, spec_of(["a"]), **options)


def test_colliding_hashes_change_nothing(spark, monkeypatch):
    """Keys are brought together by a hash; here all of them collide."""
    rows = make_rows(9, n=200)
    monkeypatch.setattr(F, "xxhash64", lambda *columns: F.lit(0).cast("bigint"))
    report = cumulative(spark.createDataFrame(rows, ROWS), spec_of(["a", "b"]), start="05:00", end="06:00")
    assert as_dict(report, ["a", "b"]) == brute_force(rows, ["a", "b"], 300, 360)


@pytest.mark.parametrize("sum_type", ["decimal(18,2)", "decimal(12,0)", "decimal(30,8)", "double"])
def test_negative_and_fractional_amounts(spark, sum_type):
    values = [-1.25, 0.5, -0.01, 3.0]
    rows = spark.createDataFrame(
        [("x", None, None, "u", i, v, dt.datetime(2024, 1, 1, 0, i)) for i, v in enumerate(values)], ROWS
    )
    got = cumulative(rows, spec_of(["a"], sum_type=sum_type), start="00:00", end="00:00").collect()
    exact = [Decimal(str(v)).quantize(Decimal(1), "ROUND_HALF_UP") if sum_type.endswith(",0)") else Decimal(str(v)) for v in values]
    assert {float(r["cost"]) for r in got} == {float(sum(exact))}
