"""Small exact results that any implementation must give."""

from __future__ import annotations

from conftest import records
from pyspark.sql import functions as F

from tidemark import DimLabel, MetricSpec, cumulative
from tidemark.functions import cleaning, minutes
from tidemark.functions.cleaning import normalize_dims, valid_key
from tidemark.functions.minutes import floor_bucket, minute_text, parse_minute

# The inputs and results in this file are fixed values.
SPEC = MetricSpec(
    dims=["dim"],
    distincts={"order_id": "req_num", "uid": "user_num"},
    sums={"req_time": "req_time", "cost": "cost"},
)


def test_totals_hold_over_quiet_buckets(spark):
    rows = spark.createDataFrame(
        [("a", "o1", "u1", 50.413, 1.245816, 202512300120)],
        "dim string, order_id string, uid string, req_time double, cost double, time_minute bigint",
    )
    report = cumulative(rows, SPEC, levels="leaf", start="01:10", end="01:30")
    got = [
        (r["date_minute"], r["req_num"], r["user_num"], r["req_time"], r["cost"], r["date_p"])
        for r in records(report, "date_minute")
    ]
    full = (1, 1, 50.413, 1.245816, 20251230)
    assert got == [
        ("202512300110", 0, 0, 0, 0, 20251230),
        ("202512300120", *full),
        ("202512300130", *full),
    ]


def test_distinct_keys_are_not_added_up(spark):
    rows = spark.createDataFrame(
        [("x", "u1", "202512300120"), ("y", "u1", "202512300130")], "d1 string, uid string, time_minute string"
    )
    spec = MetricSpec(dims=["d1"], distincts={"uid": "user_num"})
    report = cumulative(rows, spec, start="01:20", end="01:30")
    total = [r["user_num"] for r in records(report.filter("d1 = '整体'"), "date_minute")]
    assert total == [1, 1]
    leaf = [(r["d1"], r["user_num"]) for r in records(report.filter("level = 0"), "d1", "date_minute")]
    assert leaf == [("x", 1), ("x", 1), ("y", 0), ("y", 1)]


def test_null_like_keys_do_not_count(spark):
    keys = [None, "", " ", "\\N", "null", "NULL", "u1", "\\n", "\t"]
    rows = spark.createDataFrame([(k,) for k in keys], "k string")
    assert [r.k for r in rows.filter(valid_key("k")).collect()] == ["u1", "\\n"]


def test_empty_key_beside_a_real_one(spark):
    rows = spark.createDataFrame(
        [("a", "", "202512300120"), ("a", "u1", "202512300120")], "dim string, uid string, time_minute string"
    )
    spec = MetricSpec(dims=["dim"], distincts={"uid": "n"})
    report = cumulative(rows, spec, start="01:20", end="01:20")
    assert {(r.dim, r.n) for r in report.collect()} == {("a", 1), ("整体", 1)}


def test_dimension_labels(spark):
    rows = spark.createDataFrame(
        [(None, None), ("", "未知"), ("未知", "x"), ("图生视频", "")], "func_name string, other_dim string"
    )
    shown = normalize_dims(rows, ["func_name", "other_dim"]).collect()
    assert [r.func_name for r in shown] == ["未定义功能", "", "未知", "图生视频"]
    assert [r.other_dim for r in shown] == ["未知", "未知", "x", "未知"]


def test_bucket_floor(spark, zone):
    rows = spark.createDataFrame([("202512260047",), ("202512260055",), ("202512260000",)], "t string")
    got = rows.select(minute_text(floor_bucket(parse_minute("t"))).alias("b")).collect()
    assert [r.b for r in got] == ["202512260040", "202512260050", "202512260000"]


def test_stamps_of_any_spelling(spark, zone):
    # 02:30 does not exist on this day in the second zone
    texts = ["202403100230", "202403100230.0", "202403100230.", " 202403100230 ", "20240310023", "x", "202413010000", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.m for r in rows.select(minute_text(parse_minute("t")).alias("m")).collect()]
    assert got == ["202403100230"] * 4 + [None] * 4
    number = spark.createDataFrame([(202403100230, 202403100230.0)], "a bigint, b double")
    assert number.select(minute_text(parse_minute("a"))).first()[0] == "202403100230"
    exact = number.select(F.col("b").cast("decimal(14,1)").alias("b"))
    assert exact.select(minute_text(parse_minute("b"))).first()[0] == "202403100230"


def test_seven_points_in_an_hour_without_dims(spark):
    rows = spark.createDataFrame(
        [("o1", "u1", 1.0, "202512260003"), ("o2", "u1", 2.0, "202512260031"), ("o2", "u2", 4.0, "202512260059")],
        "order_id string, uid string, cost double, time_minute string",
    )
    spec = MetricSpec(distincts={"order_id": "req_num", "uid": "user_num"}, sums={"cost": "cost"})
    got = records(cumulative(rows, spec, start="00:00", end="01:00"), "date_minute")
    assert len(got) == 7
    for name in spec.metric_names:
        values = [r[name] for r in got]
        assert values == sorted(values)
    assert {len(r["date_minute"]) for r in got} == {12}
    assert {r["date_p"] for r in got} == {20251226}
    assert (got[-1]["req_num"], got[-1]["user_num"], got[-1]["cost"]) == (2, 2, 7)


def test_own_labels_and_kept_nulls(spark):
    rows = spark.createDataFrame([(None, "202512260003"), ("x", "202512260003")], "d string, time_minute string")
    spec = MetricSpec(dims=["d"], distincts={"time_minute": "n"}, dim_labels={"d": DimLabel(None)})
    report = cumulative(rows, spec, start="00:00", end="00:00", all_label="all")
    assert {(r.d, r.level, r.n) for r in report.collect()} == {(None, 0, 1), ("x", 0, 1), ("all", 1, 1)}


def test_numbers_as_stamps_and_days(spark):
    df = spark.createDataFrame([(202403100230.0, 20240115.0, "202403100230", " 20240115.0")], "d double, e double, t string, u string")
    row = df.select(
        minutes.parse_minute("d").cast("string").alias("d"),
        minutes.parse_minute(F.col("d").cast("bigint")).cast("string").alias("b"),
        minutes.parse_minute("t").cast("string").alias("t"),
        minutes.parse_day("e").cast("string").alias("e"),
        minutes.parse_day("u").cast("string").alias("u"),
        minutes.parse_minute(F.lit("2.5E400")).alias("n"),
    ).first()
    assert tuple(row) == ("2024-03-10 02:30:00",) * 3 + ("2024-01-15",) * 2 + (None,)


def test_large_amounts_count(spark):
    df = spark.createDataFrame([("2000000000000",), ("1e20",), ("x",), (None,)], "v string")
    got = [r.a for r in df.select(cleaning.amount("v").alias("a")).collect()]
    assert [int(a) for a in got] == [2 * 10**12, 10**20, 0, 0]
