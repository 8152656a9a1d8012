"""Windows, joins, snapshots, reports, checks and text."""

from __future__ import annotations

import datetime as dt

import pytest
from conftest import records
from pyspark.sql import functions as F

from tidemark import MetricSpec, cumulative
from tidemark.functions import cleaning, text
from tidemark.operators import aggregates, joins, messages, quality, reports, snapshots, windows

SPEC = MetricSpec(dims=["d"], sums={"v": "total"}, distincts={"k": "keys"}, time_col="ts")
ROWS = "d string, v double, k string, ts timestamp_ntz"


def detail(spark, *rows):
    return spark.createDataFrame([(d, v, k, dt.datetime(2024, 1, 1, 0, m)) for d, v, k, m in rows], ROWS)


def test_carry_forward_holds_and_starts_at_zero(spark):
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate([None, 3, None, 5, None])], "c string, bucket int, n bigint")
    assert [r["n"] for r in records(windows.carry_forward(rows, ["c"], ["n"]), "bucket")] == [0, 3, 3, 5, 5]


def test_grid_join_form_equals_the_report(spark):
    rows = detail(spark, ("a", 1.0, "x", 3), ("a", 2.0, "y", 25), (None, 4.0, None, 11))
    report = cumulative(rows, SPEC, levels="leaf", start="00:00", end="00:30")
    base = aggregates.prepare(rows, SPEC, end="00:30")
    cell = ["period", "d"]
    merged = joins.merge_metrics(
        [
            (aggregates.bucket_sums(base, SPEC), ["total"]),
            (aggregates.new_keys(aggregates.first_seen(base, SPEC, "k"), cell, "keys"), ["keys"]),
        ],
        [*cell, "bucket"],
    )
    cells = aggregates.cell_keys(base, SPEC, "leaf").drop("level")
    opens = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")
    points = joins.grid(cells, opens, opens + F.expr("interval 30 minutes"))
    filled = joins.attach_buckets(points, merged, cell, ["total", "keys"])
    totals = cleaning.export_names(windows.running_sum(filled, cell, ["total", "keys"]))
    found = quality.reconcile(report, totals, ["d", "date_minute", "date_p"], ["total", "keys"])
    assert report.count() == 8 and found.count() == 0


def test_last_point_equals_snapshot(spark):
    rows = detail(spark, ("a", 1.0, "x", 3), ("a", 2.0, "x", 25), ("b", 4.0, "x", 31), ("b", 8.0, None, 59))
    until = F.lit(dt.datetime(2024, 1, 1, 0, 30)).cast("timestamp_ntz")
    base = aggregates.prepare(rows, SPEC)
    whole = snapshots.snapshot_at(base, SPEC, until).first()
    parts = {r.d: (r.keys, r.total) for r in snapshots.snapshot_by(base, SPEC, ["d"], until).collect()}
    last = {r.d: (r["keys"], r.total) for r in cumulative(rows, SPEC, end="00:30").filter("date_minute like '%0030'").collect()}
    assert last == {**parts, "整体": (whole["keys"], whole["total"])}
    layered = {r.d: (r["keys"], r.total) for r in snapshots.two_layer_totals(base, SPEC, "k").collect()}
    assert layered == {"a": (1, 3), "b": (1, 12)}


def test_snapshot_keeps_a_null_group(spark):
    rows = detail(spark, (None, 1.0, "x", 3))
    spec = MetricSpec(dims=["d"], sums={"v": "total"}, time_col="ts", dim_labels={"d": cleaning.DimLabel(None)})
    base = aggregates.prepare(rows, spec)
    until = F.lit(dt.datetime(2024, 1, 1, 0, 0)).cast("timestamp_ntz")
    assert [r.d for r in snapshots.snapshot_by(base, spec, ["d"], until).collect()] == [None]


def test_preaggregation_changes_no_result(spark):
    rows = detail(spark, ("a", 1.0, "x", 3), ("a", 2.0, "x", 4), ("a", 5.0, "y", 4), ("b", 1.0, None, 14))
    reduced = aggregates.preaggregate(rows, SPEC).withColumnRenamed("bucket", "ts")
    assert reduced.count() == 3
    a, b = (sorted(map(str, cumulative(r, SPEC, end="00:30").collect())) for r in (rows, reduced))
    assert a == b
    assert aggregates.preaggregate(rows, MetricSpec(dims=["d"], distincts={"k": "n"}, time_col="ts")).count() == 3


def test_change_without_base_or_with_a_gap(spark):
    days = [(dt.date(2024, 1, 1), 10.0), (dt.date(2024, 1, 7), 10.0), (dt.date(2024, 1, 8), 30.0), (dt.date(2024, 1, 22), 5.0), (dt.date(2024, 1, 29), 0.0), (dt.date(2024, 2, 5), 1.0)]
    weeks = records(windows.period_change(spark.createDataFrame(days, "day date, m double"), "day", ["m"]), "week")
    assert [(r["week"].day, r["m_this_week"], r["m_last_week"], r["m_change"]) for r in weeks] == [
        (1, 20, None, None),
        (8, 30, 20, 0.5),
        (22, 5, None, None),
        (29, 0, 5, -1.0),
        (5, 1, 0, None),
    ]


def test_recent_messages(spark):
    said = [(1, i, "user" if i % 2 else "bot", t) for i, t in enumerate(["a", " ", "b  ", None, "c", "\n", "d" * 9])]
    rows = spark.createDataFrame(said, "conv_id int, turn int, role string, text string")
    assert [r["turn"] for r in records(windows.recent_per_session(rows, 3), "turn")] == [2, 4, 6]
    context = messages.recent_context(rows.withColumn("role", F.when(F.col("turn") == 4, "user").otherwise("bot")), 3, clip=5)
    assert context.first()["context"] == "助手：b\n用户：c\n助手：" + "d" * 5 + "\n\n[已截断]"


def test_page_text_and_mentions(spark):
    page = "<p>one\n<b\nclass='x'>two</b> < three" + "z" * 4000
    rows = spark.createDataFrame([(page, "hi @Ann, @小明 and @ann @a-b_c! x@y @")], "html string, t string")
    got = rows.select(text.page_text("html", 3000).alias("cut"), text.page_text("html").alias("all"), text.mentions("t").alias("m")).first()
    assert got["all"] == "one\ntwo < three" + "z" * 4000 and got["cut"] == got["all"][:3000]
    assert got["m"] == ["ann", "小明", "a-b_c", "y"]


def test_latest_matching(spark):
    rows = spark.createDataFrame([("周报 1", 1), ("日报 2", 2), ("other", 9), ("周报 3", 3), (None, 8)], "title string, modified int")
    assert [r.title for r in reports.latest_matching(rows, 2, ["周报", "日报"]).collect()] == ["周报 3", "日报 2"]


def test_partition_span(spark):
    rows = spark.createDataFrame([("20260101", "0000", 1.0), ("20260102", "0001", 2.0), ("20260103", "", 4.0)], "date_p string, type_p string, cost double")
    got = reports.range_summary(rows, "20260102", "20260103", type_column="type_p").first()
    assert (float(got.total_cost), got.row_count) == (2.0, 1)
    daily = reports.daily_summary(rows, "20260101", "20260103").collect()
    assert [(r.date_p, float(r.total_cost)) for r in daily] == [("20260101", 1), ("20260102", 2), ("20260103", 4)]
    costs = reports.cost_analysis(rows, ["type_p"]).filter("type_p = '0001'").first()
    assert (float(costs.total_cost), costs.calls, costs.avg_cost) == (2.0, 1, 2.0)


def test_checks_find_what_is_wrong(spark):
    rows = spark.createDataFrame([(1, "a", 5), (1, "a", None), (2, None, 50), (3, "c", 7)], "k int, s string, n int")
    assert {(r.column_name, r.null_count) for r in quality.null_check(rows).collect()} == {("k", 0), ("s", 1), ("n", 1)}
    assert [(r.k, r.copies) for r in quality.duplicate_check(rows, ["k"]).collect()] == [(1, 2)]
    assert list(quality.range_check(rows, "n", 6, 20).first()) == [4, 1, 1, 1, 1]
    assert [r.k for r in quality.consistency_check(rows, F.col("n") < 20).collect()] == [1, 2]
    parent = spark.createDataFrame([(1,), (3,)], "id int")
    orphans = quality.reference_check(rows, "k", parent, "id")
    assert [(r.k, r.row_count) for r in orphans.collect()] == [(2, 1)]
    profile = reports.table_profile(rows, ["k"]).collect()
    assert [(r.column_name, r.column_type, r.is_partition, r.sample_value) for r in profile] == [
        ("k", "int", True, "1"),
        ("s", "string", False, "a"),
        ("n", "int", False, "5"),
    ]


def test_reconcile_and_falls(spark):
    left = spark.createDataFrame([("a", 1, 5), (None, 1, 2), ("c", 1, 1)], "d string, t int, n int")
    right = spark.createDataFrame([("a", 1, 5), (None, 1, 3), ("e", 1, 1)], "d string, t int, n int")
    found = quality.reconcile(left, right, ["d", "t"], ["n"])
    assert {r.d for r in found.collect()} == {None, "c", "e"}
    series = spark.createDataFrame([("a", 1, 5), ("a", 2, 4), ("b", 1, 1), ("b", 2, 1)], "d string, t int, n int")
    assert [(r.d, r.t) for r in quality.falling_metrics(series, ["d"], "t", ["n"]).collect()] == [("a", 2)]


def test_first_present_column(spark):
    rows = spark.createDataFrame([(None, "b"), ("a", "c")], "x string, y string")
    assert [r.z for r in cleaning.coalesce_columns(rows, "z", ["x", "y"]).collect()] == ["b", "a"]
    assert cleaning.coalesce_columns(rows, "x", ["nothing"]) is rows
    with pytest.raises(ValueError, match="nothing"):
        cleaning.coalesce_columns(rows, "z", ["x", "nothing"])
