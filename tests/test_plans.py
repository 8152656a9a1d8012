"""What the plans must look like to hold at scale."""

from __future__ import annotations

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidemark import cumulative
from tidemark.operators import windows
from tidemark.workload import QUERIES, SPEC, TWO_KEYS, events, table

FOLDER = "/root/testdata/sf0.001"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def count(pattern: str, plan: str) -> int:
    return len(re.findall(pattern, plan))


@pytest.mark.parametrize("name", ["cum_leaf", "cum_cube", "cum_two_keys", "cum_multi_key"])
def test_report_reads_its_input_once_and_joins_nothing(spark, name):
    plan = physical(QUERIES[name](spark, FOLDER))
    assert count("FileScan", plan) == 1
    assert "Join" not in plan and "CartesianProduct" not in plan
    assert "SinglePartition" not in plan and "BatchEvalPython" not in plan and "ArrowEval" not in plan


def test_number_of_shuffles_does_not_grow_with_keys(spark):
    one = physical(cumulative(events(spark, FOLDER), SPEC))
    two = physical(cumulative(events(spark, FOLDER), TWO_KEYS))
    assert count("Exchange", one) == count("Exchange", two) == 5
    unbound = physical(cumulative(events(spark, FOLDER), replace(SPEC, dim_sizes={})))
    assert count("Exchange", unbound) == 6
    assert count("Exchange", physical(cumulative(events(spark, FOLDER), SPEC, levels="leaf"))) == 3


def test_levels_are_combined_before_their_shuffle(spark):
    plan = physical(cumulative(events(spark, FOLDER), SPEC)).splitlines()
    step = next(i for i, line in enumerate(plan) if "Generate explode([0,1,2,3])" in line)
    above = [line for line in plan[:step] if "Exchange" in line or "partial_min" in line]
    # nearest above the repetition is the partial reduction, only then the shuffle
    assert "partial_min" in above[-1] and "Exchange" in above[-2]


def test_only_needed_columns_are_read(spark):
    plan = physical(cumulative(table(spark, FOLDER, "events"), TWO_KEYS))
    schema = re.search(r"ReadSchema: struct<([^\n]*)>", plan).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"event_id", "ts", "user_id", "event_type", "value"}


def test_day_filter_reaches_the_scan(spark, tmp_path):
    one_day = physical(cumulative(events(spark, FOLDER), SPEC, days=[20240115]))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts,2024-01-15", one_day)
    stored = table(spark, FOLDER, "events").withColumn("date_p", F.date_format("ts", "yyyyMMdd").cast("int"))
    stored.write.partitionBy("date_p").parquet(str(tmp_path / "p"))
    spec = replace(TWO_KEYS, day_col="date_p")
    plan = physical(cumulative(spark.read.parquet(str(tmp_path / "p")), spec, days=[20240115]))
    assert re.search(r"PartitionFilters: \[[^\]]*date_p#\d+ = 20240115", plan)


def test_rank_limit_comes_before_the_shuffle(spark):
    plan = physical(windows.recent_per_session(table(spark, FOLDER, "conversations"), 3))
    below = plan[plan.index("Exchange") :]
    assert "WindowGroupLimit" in below and "Partial" in below


def test_top_k_needs_no_full_sort(spark):
    assert "TakeOrderedAndProject" in physical(QUERIES["latest_pages"](spark, FOLDER))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"stream_bucket_sums", "stream_first_seen"}))
def test_no_python_rows_and_no_pairs(spark, name):
    plan = physical(QUERIES[name](spark, FOLDER))
    for bad in ("BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan


def test_text_stamps_are_read_once_per_row(spark):
    """No filter behind them reads the text of a stamp or a day again."""
    rows = events(spark, FOLDER).withColumns({"minute": F.date_format("ts", "yyyyMMddHHmm"), "day": F.date_format("ts", "yyyyMMdd").cast("int")})
    plan = physical(cumulative(rows, replace(TWO_KEYS, time_col="minute", day_col="day"), levels="leaf"))
    assert count(r"make_timestamp_ntz\(", plan) == 2
