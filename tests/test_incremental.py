"""Facts merged slice by slice, against the report of all rows at once."""

from __future__ import annotations

import datetime as dt
import random
from dataclasses import replace

import pytest
from conftest import records
from pyspark.sql import functions as F

from tidemark.plans import incremental
from tidemark.plans.cumulative import cumulative
from tidemark.spec import MetricSpec

SPEC = MetricSpec(dims=["kind", "place"], sums={"v": "amount"}, distincts={"user": "users", "req": "requests"}, time_col="ts")
SCHEMA = "kind string, place string, user string, req bigint, v double, ts timestamp_ntz"
DAY = dt.datetime(2025, 3, 9)


def detail(seed, n=400):
    rng = random.Random(seed)
    return [
        (rng.choice(["a", "b", None]), rng.choice(["x", " ", "z"]), rng.choice(["u1", "u2", "u3", "", None]), rng.randrange(40),
         rng.choice([None, 0.1, 1e-9, 3e20, -7.25, rng.random()]), DAY + dt.timedelta(minutes=rng.randrange(2 * 1440)) if rng.random() > 0.02 else None)
        for _ in range(n)
    ]


def rows_of(df):
    return records(df, *[c for c in df.columns if c in ("kind", "place", "level", "date_minute", "date_p")])


@pytest.mark.parametrize("options", [{}, {"levels": "leaf"}, {"levels": "rollup", "start": "09:35", "end": "20:15"}, {"days": [20250310]}])
@pytest.mark.parametrize("kind", ["double", "decimal(18,2)"])
def test_slices_in_any_order_equal_the_whole(spark, tmp_path, options, kind):
    spec, rows = replace(SPEC, sum_type=kind), detail(3)
    random.Random(5).shuffle(rows)
    path = str(tmp_path / "facts")
    for i in (2, 0, 3, 1, 0):
        incremental.write_slice(spark.createDataFrame(rows[i * 100 : i * 100 + 100], SCHEMA), spec, path, f"2025030{i}")
    whole = cumulative(spark.createDataFrame(rows, SCHEMA), spec, **options)
    assert rows_of(incremental.report_of(incremental.read_state(spark, path, spec), spec, **options)) == rows_of(whole)


def test_slices_are_replaced_compacted_and_chosen(spark, tmp_path):
    path, rows = str(tmp_path / "facts"), detail(4, 200)
    incremental.write_slice(spark.createDataFrame(rows, SCHEMA), SPEC, path, "0010")
    incremental.write_slice(spark.createDataFrame(rows[:100], SCHEMA), SPEC, path, "0020")
    incremental.write_slice(spark.createDataFrame(rows[:100], SCHEMA), SPEC, path, "0010")
    incremental.write_slice(spark.createDataFrame(rows[100:], SCHEMA), SPEC, path, "0020")
    wanted = rows_of(cumulative(spark.createDataFrame(rows, SCHEMA), SPEC))
    assert rows_of(incremental.report_of(incremental.read_state(spark, path, SPEC), SPEC)) == wanted
    incremental.compact(spark, path, SPEC, f"{path}-all", "all")
    one = spark.read.parquet(f"{path}-all")
    assert one.select("slice").distinct().count() == 1 and one.count() <= spark.read.parquet(path).count()
    assert rows_of(incremental.report_of(incremental.read_state(spark, f"{path}-all", SPEC), SPEC)) == wanted
    first = incremental.read_state(spark, path, SPEC, ["0010"])
    assert rows_of(incremental.report_of(first, SPEC)) == rows_of(cumulative(spark.createDataFrame(rows[:100], SCHEMA), SPEC))
    incremental.write_slice(spark.createDataFrame([], SCHEMA), SPEC, path, "0010")
    incremental.write_slice(spark.createDataFrame([], SCHEMA), SPEC, path, "0020")
    assert incremental.report_of(incremental.read_state(spark, path, SPEC), SPEC).count() == 0


def test_a_slice_reads_its_own_rows_only(spark, tmp_path):
    """The state is not read while a slice is added: the plan has the slice's scan alone, with the filter pushed."""
    source = str(tmp_path / "detail")
    spark.createDataFrame(detail(5), SCHEMA).withColumn("arrival", F.pmod("req", F.lit(4)).cast("int")).write.partitionBy("arrival").parquet(source)
    facts = incremental.slice_facts(spark.read.parquet(source).filter("arrival = 2"), SPEC)
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "PartitionFilters: [isnotnull(arrival" in plan


def stream_of(spark, source, path, spec=SPEC, late="1 hour"):
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    incremental.stream_slices(stream, spec, path, f"{path}-state", late).awaitTermination()


def test_stream_counts_late_rows_and_keeps_them(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "facts")
    at = lambda hour, minute, v: ("a", "x", "u1", hour, v, DAY + dt.timedelta(hours=hour, minutes=minute))
    parts = [[at(9, 0, 1.0), at(12, 0, 2.0)], [at(10, 59, 4.0), at(11, 0, 8.0), at(13, 0, 16.0)], [at(0, 5, 32.0)]]
    for part in parts:
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(source)
        stream_of(spark, source, path)
    assert [(r["rows"], r["late"]) for r in records(incremental.late_rows(spark, path), "batch")] == [(2, 0), (3, 1), (1, 1)]
    whole = cumulative(spark.createDataFrame(sum(parts, []), SCHEMA), SPEC)
    assert rows_of(incremental.report_of(incremental.read_state(spark, path, SPEC), SPEC)) == rows_of(whole)


def test_repeated_batches_count_once(spark, tmp_path):
    """A stream whose checkpoint is lost reads its source again, under the same batch numbers."""
    source, path, rows = str(tmp_path / "in"), str(tmp_path / "facts"), detail(6, 120)
    spark.createDataFrame(rows, SCHEMA).write.parquet(source)
    for state in ("one", "two"):
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        incremental.stream_slices(stream, SPEC, path, str(tmp_path / state)).awaitTermination()
    assert incremental.late_rows(spark, path).count() == 1
    whole = cumulative(spark.createDataFrame(rows, SCHEMA), SPEC)
    assert rows_of(incremental.report_of(incremental.read_state(spark, path, SPEC), SPEC)) == rows_of(whole)
