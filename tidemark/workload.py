"""Named queries over the given tables, one or more per operator.

Each takes the session and the folder of the tables and returns a frame.
Inputs are whole tables; filters appear only where they are what the query is about.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import cleaning, minutes, params, text
from tidemark.operators import aggregates, joins, messages, quality, reports, rule_index, rules, snapshots, windows
from tidemark.operators.aggregates import BUCKET, LEVEL, PERIOD
from tidemark.plans import incremental
from tidemark.plans.attribution import attributed_events, behaviour_detail, material_detail
from tidemark.plans.cumulative import cumulative
from tidemark.sources import readers, writers
from tidemark.sources.shared import scratch_path
from tidemark.spec import MetricSpec
from tidemark.streaming import intraday

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with a second dimension read out of ``props``."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, folder, "events").withColumns({"k": k, "band": F.when(k < 50, "low").otherwise("high")})


SPEC = MetricSpec(
    dims=["event_type", "band"],
    sums={"value": "amount"},
    distincts={"user_id": "users"},
    time_col="ts",
    sum_type="decimal(18,2)",
    dim_sizes={"event_type": 100, "band": 2},
)
TWO_KEYS = MetricSpec(
    dims=["event_type"],
    sums={"value": "amount"},
    distincts={"event_id": "requests", "user_id": "users"},
    time_col="ts",
    sum_type="decimal(18,2)",
    dim_sizes={"event_type": 100},
)
NO_DIMS = MetricSpec(
    sums={"value": "amount"}, distincts={"user_id": "users"}, time_col="ts", sum_type="decimal(18,2)"
)
ITEMS = MetricSpec(
    dims=["l_returnflag", "l_linestatus"],
    sums={"l_quantity": "quantity", "l_extendedprice": "amount"},
    distincts={"l_orderkey": "orders", "l_suppkey": "suppliers"},
    time_col="l_shipdate",
    step_minutes=1440,
    period="month",
    sum_type="decimal(18,2)",
    dim_sizes={"l_returnflag": 10, "l_linestatus": 10},
)


SEVEN = MetricSpec(
    dims=["flag", "status", "order_status", "priority", "amount_band", "discount_band", "tax_band"],
    sums={"l_quantity": "quantity"},
    distincts={"l_orderkey": "orders", "l_suppkey": "suppliers"},
    time_col="stamp",
    step_minutes=360,
    sum_type="decimal(18,2)",
)


def wide_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items with dimensions of their orders; a year stands for a day, its months for two hours each."""
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("order_status"), F.col("o_orderpriority").alias("priority"))
    band = lambda c, at: F.when(F.col(c) < at, "low").otherwise("high")
    items = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_quantity",
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
        band("l_quantity", 26).alias("amount_band"),
        band("l_discount", 0.05).alias("discount_band"),
        band("l_tax", 0.04).alias("tax_band"),
        F.expr("make_timestamp_ntz(year(l_shipdate), 1, 1, (month(l_shipdate) - 1) * 2, 0, 0)").alias("stamp"),
    )
    return items.join(orders, "l_orderkey")


def plain(df: DataFrame, *decimals: str) -> DataFrame:
    """Amounts as doubles and stamps as text, so that engines compare alike."""
    shown = {c: F.col(c).cast("double") for c in decimals}
    for name, kind in df.dtypes:
        if name == BUCKET:
            shown[name] = minutes.minute_text(name)
        elif name == PERIOD:
            shown[name] = minutes.day_number(name)
    return df.withColumns(shown)


# --- cumulative reports -------------------------------------------------------------


@query
def cum_leaf(spark: SparkSession, folder: str) -> DataFrame:
    return plain(cumulative(events(spark, folder), SPEC, levels="leaf"), "amount")


@query
def cum_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """Three slices of detail rows read one by one, the second of them twice, their facts merged and compacted.

    Rows of odd users arrive a slice late.
    """
    source = events(spark, folder)
    path = scratch_path(spark, "facts")
    arrives = F.least(F.floor((F.dayofmonth("ts") - 1) / 12) + F.pmod("user_id", F.lit(2)), F.lit(2))
    for i in (0, 1, 1, 2):
        incremental.write_slice(source.filter(arrives == i), SPEC, path, str(i))
    compacted = scratch_path(spark, "facts-compact")
    incremental.compact(spark, path, SPEC, compacted, "0-2")
    return plain(incremental.report_of(incremental.read_state(spark, compacted, SPEC), SPEC, levels="leaf"), "amount")


@query
def cum_cube(spark: SparkSession, folder: str) -> DataFrame:
    return plain(cumulative(events(spark, folder), SPEC), "amount")


@query
def cum_cube_hot_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The cube without a bound on the cells of a key, its levels made one from another as in a wide cube."""
    return plain(cumulative(events(spark, folder), replace(SPEC, dim_sizes={}), fan_out=1), "amount")


@query
def cum_cube_checkpoint(spark: SparkSession, folder: str) -> DataFrame:
    return plain(cumulative(events(spark, folder), SPEC, checkpoint=True, fan_out=2), "amount")


@query
def cum_cube_seven(spark: SparkSession, folder: str) -> DataFrame:
    """All 128 levels of seven dimensions, for the quarters of each year of shipping."""
    return plain(cumulative(wide_items(spark, folder), SEVEN, checkpoint=True), "quantity")


@query
def cum_double_amounts(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts from 10^-9 to 10^30 as doubles; a type of event has one magnitude, so its sums are exact in any engine."""
    scale = F.when(F.col("event_type") == "click", 2.0**100).when(F.col("event_type") == "view", 2.0**-30).when(F.col("event_type") == "error", 2.0**60)
    rows = events(spark, folder).withColumn("value", (F.col("k") + 1) * F.coalesce(scale, F.lit(1.0)))
    return plain(cumulative(rows, replace(SPEC, sum_type="double"), levels=[["event_type", "band"], ["event_type"]]))


@query
def cum_nodims(spark: SparkSession, folder: str) -> DataFrame:
    return plain(cumulative(events(spark, folder), NO_DIMS), "amount")


@query
def cum_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return plain(cumulative(events(spark, folder), SPEC, levels="rollup"), "amount")


@query
def cum_chosen_levels(spark: SparkSession, folder: str) -> DataFrame:
    return plain(cumulative(events(spark, folder), SPEC, levels=[["band"], []]), "amount")


@query
def cum_opening_balance(spark: SparkSession, folder: str) -> DataFrame:
    return plain(cumulative(events(spark, folder), SPEC, start="10:00", end="14:00"), "amount")


@query
def cum_range(spark: SparkSession, folder: str) -> DataFrame:
    report = cumulative(events(spark, folder), SPEC, start="10:05", end="13:57", history="range")
    return plain(report, "amount")


@query
def cum_one_day(spark: SparkSession, folder: str) -> DataFrame:
    return plain(cumulative(events(spark, folder), SPEC, days=["20240115"]), "amount")


@query
def cum_double_stamp(spark: SparkSession, folder: str) -> DataFrame:
    """Stamps as doubles, the way most detail files have them."""
    stamped = events(spark, folder).withColumn("minute", F.date_format("ts", "yyyyMMddHHmm").cast("double"))
    return plain(cumulative(stamped, replace(SPEC, time_col="minute"), levels="leaf"), "amount")


@query
def cum_text_days(spark: SparkSession, folder: str) -> DataFrame:
    """A stored day as text with a float's tail, filtered by ``days``."""
    stored = events(spark, folder).withColumn("date_p", F.concat(F.date_format("ts", "yyyyMMdd"), F.lit(".0")))
    return plain(cumulative(stored, replace(SPEC, day_col="date_p"), days=["20240115"]), "amount")


@query
def cum_large_amounts(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts of 10^12 and more under the default type; shown in units of 10^12."""
    large = events(spark, folder).withColumn("value", F.col("value").cast("decimal(18,2)") * F.lit(10**12).cast("decimal(13,0)"))
    spec = MetricSpec(dims=SPEC.dims, sums=SPEC.sums, distincts=SPEC.distincts, time_col="ts")
    report = cumulative(large, spec, levels="leaf")
    return plain(report.withColumn("amount", (F.col("amount") / 10**12).cast("decimal(18,2)")), "amount")


@query
def rejected_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as rules, some with a blank level or a bad event; what is turned away and why."""
    parts = table(spark, folder, "part")
    blank = {c: F.lit("") for c in rules.RULE_COLUMNS}
    rows = parts.select(
        F.col("p_partkey").cast("bigint").alias("rule_no"),
        *[c.alias(n) for n, c in {**blank, "level1": F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.col("p_name")), "event_id": F.when(F.col("p_size") % 2 == 0, "2nd").otherwise("click")}.items()],
    )
    return rules.clean_rules(rows)[1].select("rule_no", "reason")


@query
def cum_two_keys(spark: SparkSession, folder: str) -> DataFrame:
    return plain(cumulative(events(spark, folder), TWO_KEYS), "amount")


@query
def cum_multi_key(spark: SparkSession, folder: str) -> DataFrame:
    return plain(cumulative(table(spark, folder, "lineitem"), ITEMS), "quantity", "amount")


@query
def cum_stored_day(spark: SparkSession, folder: str) -> DataFrame:
    """Text stamps with a float tail and a stored day partition, as landing files have."""
    stored = events(spark, folder).select(
        "event_type",
        "band",
        "user_id",
        "value",
        F.concat(minutes.minute_text("ts"), F.lit(".0")).alias("time_minute"),
        minutes.day_number("ts").alias("date_p"),
    )
    spec = MetricSpec(
        dims=SPEC.dims, sums=SPEC.sums, distincts=SPEC.distincts, day_col="date_p", sum_type=SPEC.sum_type
    )
    return plain(cumulative(stored, spec, levels="leaf"), "amount")


# --- clean-up -------------------------------------------------------------------------


@query
def parse_minute(spark: SparkSession, folder: str) -> DataFrame:
    stamp = minutes.minute_text("ts")
    written = F.when(F.col("k") % 10 == 3, F.concat(stamp, F.lit(".0"))).when(
        F.col("k") % 10 == 4, F.concat(F.lit("x"), stamp)
    )
    parsed = events(spark, folder).select("event_id", minutes.parse_minute(written.otherwise(stamp)).alias("t"))
    return parsed.filter(F.col("t").isNotNull()).select("event_id", minutes.minute_text("t").alias("minute"))


@query
def floor_bucket(spark: SparkSession, folder: str) -> DataFrame:
    return plain(table(spark, folder, "events").select("event_id", minutes.floor_bucket("ts").alias(BUCKET)))


@query
def filter_until(spark: SparkSession, folder: str) -> DataFrame:
    base = aggregates.prepare(events(spark, folder), SPEC, end="12:34")
    return plain(base.groupBy(PERIOD).agg(F.count(F.lit(1)).alias("row_count"), F.max(BUCKET).alias(BUCKET)))


@query
def select_spec(spark: SparkSession, folder: str) -> DataFrame:
    chosen = cleaning.select_spec(events(spark, folder), SPEC)
    return chosen.withColumn("ts", minutes.minute_text("ts"))


@query
def coalesce_columns(spark: SparkSession, folder: str) -> DataFrame:
    holed = events(spark, folder).select(
        "event_id", F.nullif("event_type", F.lit("error")).alias("func_name"), F.col("band").alias("func_id")
    )
    return cleaning.coalesce_columns(holed, "func", ["func_name", "func_id"]).select("event_id", "func")


@query
def normalize_dims(spark: SparkSession, folder: str) -> DataFrame:
    holed = events(spark, folder).select(
        "event_id",
        F.nullif("event_type", F.lit("error")).alias("func_name"),
        F.when(F.col("k") < 10, F.lit("")).when(F.col("k") >= 20, F.col("band")).alias("os_type"),
    )
    return cleaning.normalize_dims(holed, ["func_name", "os_type"])


@query
def valid_key(spark: SparkSession, folder: str) -> DataFrame:
    written = (
        F.when(F.col("k") < 5, F.lit(" "))
        .when(F.col("k") < 10, F.lit("\\N"))
        .when(F.col("k") < 15, F.lit("Null"))
        .when(F.col("k") < 20, F.lit("\\n"))
        .when(F.col("k") >= 25, F.col("user_id").cast("string"))
    )
    keyed = events(spark, folder).select("event_id", written.alias("key"))
    return keyed.filter(cleaning.valid_key("key"))


@query
def numeric_metrics(spark: SparkSession, folder: str) -> DataFrame:
    written = F.when(F.col("k") < 10, F.lit("n/a")).when(F.col("k") >= 20, F.col("value").cast("string"))
    raw = events(spark, folder).select("event_id", written.alias("cost"))
    return plain(cleaning.numeric_metrics(raw, ["cost"], "decimal(18,2)"), "cost")


@query
def spine(spark: SparkSession, folder: str) -> DataFrame:
    days = table(spark, folder, "events").select(F.col("ts").cast("date").alias(PERIOD)).distinct()
    return plain(joins.grid(days, minutes.at_time(PERIOD, 0), minutes.at_time(PERIOD, 1430)))


# --- aggregation ----------------------------------------------------------------------


def prepared(spark: SparkSession, folder: str, spec: MetricSpec = SPEC) -> DataFrame:
    return aggregates.prepare(events(spark, folder), spec)


@query
def preagg(spark: SparkSession, folder: str) -> DataFrame:
    return plain(aggregates.preaggregate(events(spark, folder), SPEC, carry_max=["k"]), "value")


@query
def bucket_sums(spark: SparkSession, folder: str) -> DataFrame:
    return plain(aggregates.bucket_sums(prepared(spark, folder), SPEC), "amount")


@query
def first_seen(spark: SparkSession, folder: str) -> DataFrame:
    return plain(aggregates.first_seen(prepared(spark, folder), SPEC, "user_id"))


@query
def new_keys(spark: SparkSession, folder: str) -> DataFrame:
    seen = aggregates.first_seen(prepared(spark, folder), SPEC, "user_id")
    return plain(aggregates.new_keys(seen, [PERIOD, *SPEC.dims], "users"))


@query
def cumulative_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return plain(windows.cumulative_distinct(prepared(spark, folder), SPEC, "user_id"))


@query
def cube_sums(spark: SparkSession, folder: str) -> DataFrame:
    cubed = aggregates.cube_sums(prepared(spark, folder), SPEC)
    return plain(aggregates.label_totals(cubed, SPEC.dims), "amount")


@query
def cube_distinct(spark: SparkSession, folder: str) -> DataFrame:
    cubed = aggregates.cube_distinct(prepared(spark, folder), SPEC, "user_id")
    return plain(aggregates.label_totals(cubed, SPEC.dims))


@query
def cell_keys(spark: SparkSession, folder: str) -> DataFrame:
    return plain(aggregates.label_totals(aggregates.cell_keys(prepared(spark, folder), SPEC), SPEC.dims))


@query
def union_cells(spark: SparkSession, folder: str) -> DataFrame:
    base = prepared(spark, folder)
    sums = aggregates.bucket_sums(base, SPEC)
    keys = aggregates.first_seen(base, SPEC, "user_id")
    return plain(aggregates.union_cells([sums, keys], [PERIOD, *SPEC.dims]))


@query
def per_bucket(spark: SparkSession, folder: str) -> DataFrame:
    return plain(snapshots.per_bucket(prepared(spark, folder, TWO_KEYS), TWO_KEYS), "amount")


def noon() -> Column:
    return F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")


@query
def snapshot_at(spark: SparkSession, folder: str) -> DataFrame:
    return plain(snapshots.snapshot_at(prepared(spark, folder, TWO_KEYS), TWO_KEYS, noon()), "amount")


@query
def snapshot_by(spark: SparkSession, folder: str) -> DataFrame:
    return plain(snapshots.snapshot_by(prepared(spark, folder, TWO_KEYS), TWO_KEYS, ["event_type"], noon()), "amount")


@query
def two_layer_totals(spark: SparkSession, folder: str) -> DataFrame:
    return plain(snapshots.two_layer_totals(prepared(spark, folder), SPEC, "user_id"), "amount")


@query
def fact_rollup(spark: SparkSession, folder: str) -> DataFrame:
    facts = events(spark, folder).select("event_type", "band", "user_id", F.lit(1).cast("bigint").alias("cnt"))
    return aggregates.fact_rollup(facts, ["event_type", "band", "user_id"])


@query
def dedupe_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return aggregates.dedupe_lookup(table(spark, folder, "events"), "user_id")


# --- windows and grids ----------------------------------------------------------------


@query
def running_sum(spark: SparkSession, folder: str) -> DataFrame:
    sums = aggregates.bucket_sums(prepared(spark, folder), SPEC)
    return plain(windows.running_sum(sums, [PERIOD, *SPEC.dims], ["amount"]), "amount")


def _points(cells: DataFrame) -> DataFrame:
    return joins.grid(cells, minutes.at_time(PERIOD, 0), minutes.at_time(PERIOD, 1430))


@query
def attach_buckets(spark: SparkSession, folder: str) -> DataFrame:
    base = prepared(spark, folder)
    cells = aggregates.cell_keys(base, SPEC, "leaf").drop(LEVEL)
    sums = aggregates.bucket_sums(base, SPEC)
    return plain(joins.attach_buckets(_points(cells), sums, [PERIOD, *SPEC.dims], ["amount"]), "amount")


@query
def carry_forward(spark: SparkSession, folder: str) -> DataFrame:
    base = prepared(spark, folder)
    cell = [PERIOD, *SPEC.dims]
    points = _points(aggregates.cell_keys(base, SPEC, "leaf").drop(LEVEL))
    known = windows.cumulative_distinct(base, SPEC, "user_id")
    return plain(windows.carry_forward(points.join(known, [*cell, BUCKET], "left"), cell, ["users"]))


@query
def merge_metrics(spark: SparkSession, folder: str) -> DataFrame:
    base = prepared(spark, folder)
    cell = [PERIOD, *SPEC.dims]
    sums = aggregates.bucket_sums(base, SPEC)
    fresh = aggregates.new_keys(aggregates.first_seen(base, SPEC, "user_id"), cell, "users")
    return plain(joins.merge_metrics([(sums, ["amount"]), (fresh, ["users"])], [*cell, BUCKET]), "amount")


# --- reports and quality --------------------------------------------------------------


def order_costs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        minutes.day_number("o_orderdate").alias("date_p"),
        F.col("o_orderpriority").alias("type_p"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("cost"),
    )


@query
def range_summary(spark: SparkSession, folder: str) -> DataFrame:
    costs = order_costs(spark, folder)
    return plain(reports.range_summary(costs, 19960101, 19971231, type_column="type_p"), "total_cost")


@query
def daily_summary(spark: SparkSession, folder: str) -> DataFrame:
    return plain(reports.daily_summary(order_costs(spark, folder), 19960101, 19971231), "total_cost")


@query
def cost_analysis(spark: SparkSession, folder: str) -> DataFrame:
    return plain(reports.cost_analysis(order_costs(spark, folder), ["status", "type_p"]), "total_cost")


@query
def weekly_change(spark: SparkSession, folder: str) -> DataFrame:
    priced = table(spark, folder, "orders").withColumn("price", F.col("o_totalprice").cast("decimal(18,2)"))
    report = reports.weekly_report(priced, "o_orderdate", ["price"], ["o_orderstatus"])
    return plain(report, "price_this_week", "price_last_week").withColumn("week", minutes.day_number("week"))


@query
def table_profile(spark: SparkSession, folder: str) -> DataFrame:
    return reports.table_profile(table(spark, folder, "customer"), partition_columns=["c_nationkey"])


@query
def null_check(spark: SparkSession, folder: str) -> DataFrame:
    holed = events(spark, folder).withColumn("event_type", F.nullif("event_type", F.lit("error")))
    return quality.null_check(holed, ["event_id", "event_type", "value"])


@query
def duplicate_check(spark: SparkSession, folder: str) -> DataFrame:
    return quality.duplicate_check(table(spark, folder, "lineitem"), ["l_orderkey", "l_partkey"])


@query
def range_check(spark: SparkSession, folder: str) -> DataFrame:
    return quality.range_check(table(spark, folder, "lineitem"), "l_quantity", 5, 45)


@query
def consistency_check(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return quality.consistency_check(items, ~((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F")))


@query
def reference_check(spark: SparkSession, folder: str) -> DataFrame:
    """Customers without orders: the given tables have orphans this way round."""
    return quality.reference_check(table(spark, folder, "customer"), "c_custkey", table(spark, folder, "orders"), "o_custkey")


def reported_and_direct(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The last point of every cell, damaged on purpose, and the whole day counted directly."""
    source = events(spark, folder)
    last = cumulative(source, SPEC, levels="leaf").filter(F.substring("date_minute", 9, 4) == "2350")
    lost = (F.col("date_p") % 5 == 0) & (F.col("event_type") == "view")
    shifted = (F.col("date_p") % 7 == 0) & (F.col("event_type") == "click")
    damaged = last.filter(~lost).withColumn("users", F.col("users") + shifted.cast("bigint"))
    direct = source.groupBy("event_type", "band", minutes.day_number("ts").alias("date_p")).agg(
        F.count_distinct("user_id").alias("users"), F.sum(F.col("value").cast("decimal(18,2)")).alias("amount")
    )
    return damaged, direct


def found_users(found: DataFrame) -> DataFrame:
    return found.select(*SPEC.dims, "date_p", "result_rows", "oracle_rows", "users_result", "users_oracle").withColumns(
        {c: F.col(c).cast("bigint") for c in ("users_result", "users_oracle")}
    )


@query
def reconcile(spark: SparkSession, folder: str) -> DataFrame:
    """The last point of every cell against the whole day counted directly.

    The report is damaged on purpose: days divisible by 5 lack a kind, those divisible by
    7 have one user too many in another. The findings are those cells and no others.
    """
    damaged, direct = reported_and_direct(spark, folder)
    return found_users(quality.reconcile(damaged, direct, [*SPEC.dims, "date_p"], ["users", "amount"]))


@query
def reconcile_digest(spark: SparkSession, folder: str) -> DataFrame:
    """The findings of ``reconcile`` by digests of days, then of cells; with the rows that each step left to compare."""
    stored = []
    for name, frame in zip(("reported", "direct"), reported_and_direct(spark, folder)):
        path = scratch_path(spark, name)
        frame.select(*SPEC.dims, "date_p", "users", "amount").write.partitionBy("date_p").parquet(path)
        stored.append(spark.read.parquet(path))
    steps = [["date_p"], ["date_p", "event_type"]]
    found, compared = quality.reconcile_digest(*stored, steps, [*SPEC.dims, "date_p"], ["users", "amount"])
    by_step = {f"rows_{name}": compared.filter(F.col("step") == i).select("rows_compared").scalar() for i, name in enumerate(("all", "days", "cells"))}
    return found_users(found).withColumns(by_step)


@query
def falling_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Every noon point of the report loses half of its users; the points that fall."""
    report = cumulative(events(spark, folder), SPEC)
    noon_point = F.substring("date_minute", 9, 4) == "1200"
    damaged = report.withColumn("users", F.when(noon_point, F.floor(F.col("users") / 2)).otherwise(F.col("users")).cast("bigint"))
    falls = quality.falling_metrics(damaged, ["date_p", LEVEL, *SPEC.dims], "date_minute", SPEC.metric_names)
    return plain(falls, "amount")


# --- event attribution ----------------------------------------------------------------

ALIASES = (
    params.Alias("error", "error_low", "band", ("low",)),
    params.Alias("signup", "signup_early", before=dt.date(2024, 1, 10)),
)
BLANK_RULE = {c: "" for c in rules.RULE_COLUMNS}
RULES = [
    # two rules of one identity back each other up
    {
        "event_id": "click",
        "level1": "相机",
        "level2": "shot",
        "record_type": "功能",
        "filter_condition": "cast(params['k'] as int) < 50",
        "scm": "params['scm']",
        "tab_id": "params['tab']",
        "camera_mode": "经典",
        "second_icon": "是",
        "deal_mode": "one",
    },
    {
        "event_id": "click",
        "level1": "相机",
        "level2": "shot",
        "record_type": "功能",
        "filter_condition": "cast(params['k'] as int) >= 80",
        "scm": "nvl(params['none'],params['tab'])",
        "deal_mode": "two",
    },
    {
        "event_id": "view",
        "level1": "美化",
        "record_type": "功能",
        "posi_id": "params['k']",
        "second_icon": "params['k'] = '7'",
        "sharephone": "params['k'] = '3'",
        "camera_mode": "params['tab']",
        "vip_func_id": "v1",
    },
    {
        "event_id": "view",
        "level1": "美容",
        "level2": "skin",
        "level3": "smooth",
        "record_type": "功能",
        "filter_condition": "1 = 1",
    },
    {
        "event_id": "purchase",
        "level1": "拼图",
        "record_type": "功能",
        "filter_condition": "params['k'] in （'1','2','3'）",
        "material_id": "params['ids']",
    },
    {"event_id": "error_low", "level1": "首页垂类", "record_type": "功能", "tab_id": "k"},
    {"event_id": "signup_early", "level1": "其他", "record_type": "功能"},
    {"event_id": "purchase", "level1": "拼图", "record_type": "素材", "material_id": "params['ids']"},
    {
        "event_id": "view",
        "level1": "美化",
        "record_type": "素材",
        "material_id": "params['ids']",
        "filter_condition": "params['band'] = ‘low’",
    },
    {"event_id": "click", "level1": "", "record_type": "功能"},
    {"event_id": "9click", "level1": "相机", "record_type": "功能"},
]


def rule_table(spark: SparkSession) -> DataFrame:
    rows = [(i, *[{**BLANK_RULE, **r}[c] for c in rules.RULE_COLUMNS]) for i, r in enumerate(RULES)]
    return spark.createDataFrame(rows, "rule_no bigint, " + ", ".join(f"{c} string" for c in rules.RULE_COLUMNS))


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a log: kinds in ``event_id``, details in a ``params`` map."""
    k = F.col("k").cast("string")
    user = F.col("user_id").cast("string")
    more = F.create_map(
        F.lit("scm"), F.concat(F.lit("s"), k, F.lit("$$$"), user),
        F.lit("tab"), F.concat(F.lit("t"), F.pmod("k", F.lit(3)).cast("string")),
        F.lit("band"), F.col("band"),
        F.lit("ids"), F.concat(F.lit("["), k, F.lit(".5;"), user, F.lit("&1,0]")),
    )
    return events(spark, folder).select(
        F.col("event_id").alias("record"),
        F.col("event_type").alias("event_id"),
        F.col("user_id").alias("gid"),
        F.col("ts").cast("date").alias("day"),
        minutes.day_number("ts").alias("date_p"),
        F.map_concat(F.from_json("props", "map<string,string>"), more).alias("params"),
    )


def ready_rules(spark: SparkSession, material: bool = False) -> rules.RuleSet:
    accepted, _ = rules.clean_rules(rule_table(spark))
    return rules.compile_rules(rules.rules_for(accepted, material))


def new_users(spark: SparkSession, folder: str) -> DataFrame:
    """Users with a large value stand for the day's new ids."""
    return table(spark, folder, "events").filter(F.col("value") > 250).select(F.col("user_id").alias("gid"))


def _attributed(spark: SparkSession, folder: str) -> DataFrame:
    log = event_log(spark, folder).select("record", "event_id", "day", "params")
    return attributed_events(log, ready_rules(spark), aliases=ALIASES, day="day")


@query
def rule_match(spark: SparkSession, folder: str) -> DataFrame:
    accepted, _ = rules.clean_rules(rule_table(spark))
    log = event_log(spark, folder).select("record", "event_id")
    return joins.match_rules(log, accepted.select("event_id", "rule_no", "level1")).select("record", "rule_no", "level1")


@query
def alias_events(spark: SparkSession, folder: str) -> DataFrame:
    log = event_log(spark, folder)
    return log.select("record", params.alias_event("event_id", "params", ALIASES, "day").alias("event_id"))


@query
def gate_events(spark: SparkSession, folder: str) -> DataFrame:
    passes = params.gate_passes("event_id", "params", ids=("click", "view"), key="tab", values=("t1", "t2"))
    return event_log(spark, folder).filter(passes).select("record", "event_id")


@query
def fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    fields = ["event_id", "user_id", F.nullif("event_type", F.lit("error")), "props"]
    return table(spark, folder, "events").select(
        "event_id", params.fingerprint(fields).alias("mark"), params.fingerprint(fields, compat=True).alias("old_mark")
    )


@query
def fingerprint_json(spark: SparkSession, folder: str) -> DataFrame:
    """The mark of a record whose details are a map: equal maps in any order give equal marks."""
    details = F.create_map(F.lit("type"), "event_type", F.lit("band"), "band")
    turned = F.create_map(F.lit("band"), "band", F.lit("type"), "event_type")
    marks = {n: params.fingerprint(["event_id", params.params_json(m)]) for n, m in (("mark", details), ("turned_mark", turned))}
    return events(spark, folder).select("event_id", *[m.alias(n) for n, m in marks.items()])


@query
def local_day(spark: SparkSession, folder: str) -> DataFrame:
    """The calendar day of epoch milliseconds in a named zone."""
    millis = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")) * 1000
    return table(spark, folder, "events").select(
        "event_id", minutes.day_number(params.local_day(millis, "Asia/Shanghai")).alias("day_number")
    )


@query
def attribute(spark: SparkSession, folder: str) -> DataFrame:
    return _attributed(spark, folder).select("record", "event_id", "rule_no", "cnt")


@query
def extract_attrs(spark: SparkSession, folder: str) -> DataFrame:
    return _attributed(spark, folder).select("record", "rule_no", "scm", "tab_id", "posi_id", "material_id")


@query
def mode_flags(spark: SparkSession, folder: str) -> DataFrame:
    return _attributed(spark, folder).select("record", "rule_no", "camera_mode", "sharephone", "second_icon")


@query
def structured_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rules whose conditions are data: several rules per event, no text to trust."""
    conditions = [[("k", ">=", ["20"]), ("tab", "in", ["t0", "t2"])], [("k", "not in", ["1", "2"])], None]
    given = [("click", 0), ("view", 0), ("click", 1), ("view", 2), ("error", 1)]
    rows = [
        (i, *[{**BLANK_RULE, "event_id": e, "level1": f"rule{i}"}[c] for c in rules.RULE_COLUMNS], conditions[c])
        for i, (e, c) in enumerate(given)
    ]
    schema = ", ".join(["rule_no bigint", *[f"{c} string" for c in rules.RULE_COLUMNS], f"predicates {rules.PREDICATES}"])
    accepted, _ = rules.clean_rules(spark.createDataFrame(rows, schema))
    log = event_log(spark, folder).select("record", "event_id", "params")
    return rules.attribute(log, rules.compile_rules(accepted)).select("record", "rule_no")


def order_rules(spark: SparkSession, folder: str) -> DataFrame:
    """One structured rule per order and nation: those of customers below 100 share one identity per kind of event."""
    kinds = F.array(*[F.lit(k) for k in ("click", "view", "purchase", "signup", "error")])

    def condition(key: str, op: str, *values: Column) -> Column:
        return F.struct(F.lit(key).alias("key"), F.lit(op).alias("op"), F.array(*[v.cast("string") for v in values]).cast("array<string>").alias("values"))

    def chosen(number: Column, choices: list[Column]) -> Column:
        """The choice at ``number`` modulo their count; null beyond those given."""
        return F.get(F.array(*choices), F.pmod(number, F.lit(len(choices))).cast("int"))

    key, customer, nation = F.col("o_orderkey"), F.col("o_custkey"), F.col("n_nationkey")
    k = F.pmod(key, F.lit(100))
    other = chosen(key, [condition("k", ">=", k), condition("tab", "in", F.lit("t0"), F.lit("t2")), condition("k", "not in", F.lit("1"), k), condition("none", "is null")])
    user = F.when(F.pmod(key, F.lit(3)) == 0, condition("user", "in", customer, customer + 1, customer)).otherwise(condition("user", "=", customer))
    tab = chosen(key, [F.lit("params['tab']"), F.lit("nvl(params['none'],params['band'])"), F.lit("")])
    orders = table(spark, folder, "orders").select(
        key.alias("rule_no"),
        chosen(key, [F.get(kinds, F.lit(i)) for i in range(5)]).alias("event_id"),
        F.concat(F.lit("group"), F.greatest(customer, F.lit(99)).cast("string")).alias("level1"),
        tab.alias("tab_id"),
        F.when(F.pmod(key, F.lit(7)) == 0, F.array(other, user)).otherwise(F.array(user, other)).alias("predicates"),
    )
    wide = chosen(nation, [F.array(condition("k", "<", nation)), F.lit(None), F.array(condition("none", "is null"), condition("band", "=", F.lit("low")))])
    nations = table(spark, folder, "nation").select(
        (-1 - nation).alias("rule_no"),
        chosen(nation, [F.get(kinds, F.lit(i)) for i in range(5)]).alias("event_id"),
        F.concat(F.lit("nation"), nation.cast("string")).alias("level1"),
        F.lit("params['k']").alias("tab_id"),
        wide.alias("predicates"),
    )
    given = ("level1", "event_id", "tab_id")
    blank = {c: F.lit("") for c in rules.RULE_COLUMNS if c not in given}
    return orders.unionByName(nations).withColumns(blank)


@query
def many_rules(spark: SparkSession, folder: str) -> DataFrame:
    """As many structured rules as orders, matched through an index: events per rule and value read."""
    accepted, _ = rules.clean_rules(order_rules(spark, folder))
    log = event_log(spark, folder)
    log = log.withColumn("params", F.map_concat("params", F.create_map(F.lit("user"), F.col("gid").cast("string"))))
    found = rule_index.attribute_indexed(log, accepted, ["record"])
    return found.groupBy("rule_no", "tab_id").agg(F.count(F.lit(1)).alias("events"), F.sum("record").alias("records"))


@query
def rule_levels(spark: SparkSession, folder: str) -> DataFrame:
    return _attributed(spark, folder).select(
        "record", "rule_no", "main_func_name", "sub_func_level2_name", "sub_func_level3_name", "tool_level", "model_p"
    )


@query
def area_of(spark: SparkSession, folder: str) -> DataFrame:
    country = F.nullif(F.col("c_nationkey"), F.lit(7))
    return table(spark, folder, "customer").select("c_custkey", params.area_of(country, home=3).alias("area"))


@query
def first_number(spark: SparkSession, folder: str) -> DataFrame:
    written = F.when(F.col("k") % 3 == 0, F.concat_ws(".", "k", "user_id")).when(
        F.col("k") % 3 == 1, F.concat_ws("&", "k", "user_id")
    )
    numbers = events(spark, folder).select(
        "event_id", params.first_number(written.otherwise(F.col("event_type"))).alias("number")
    )
    return numbers.filter(F.col("number") > 0)


@query
def explode_ids(spark: SparkSession, folder: str) -> DataFrame:
    log = event_log(spark, folder).select("record", params.param("params", "ids").alias("ids"))
    return params.explode_ids(log, "ids", "id").select("record", "id")


@query
def exists_flag(spark: SparkSession, folder: str) -> DataFrame:
    log = event_log(spark, folder).select("record", "gid")
    return joins.exists_flag(log, new_users(spark, folder), "gid", "is_new_user")


@query
def behaviour_facts(spark: SparkSession, folder: str) -> DataFrame:
    detail = behaviour_detail(
        event_log(spark, folder),
        ready_rules(spark),
        new_users(spark, folder),
        carry=["gid", "date_p"],
        aliases=ALIASES,
        day="day",
    )
    return detail.select(
        "gid", "date_p", "event_id", "main_func_name", "deal_mode", "scm", "tab_id", "second_icon", "model_p",
        "tool_level", "is_new_user", "cnt",
    )


@query
def material_facts(spark: SparkSession, folder: str) -> DataFrame:
    paid = table(spark, folder, "events").filter(F.col("value") > 200).select(F.col("user_id").alias("material_id"))
    detail = material_detail(
        event_log(spark, folder),
        ready_rules(spark, material=True),
        new_users(spark, folder),
        paid,
        carry=["gid", "date_p"],
        day="day",
    )
    return detail.select(
        "gid", "date_p", "event_id", "main_func_name", "material_id_new", "is_vip_material", "is_new_user", "cnt"
    )


# --- text -----------------------------------------------------------------------------


@query
def page_text(spark: SparkSession, folder: str) -> DataFrame:
    whole = text.page_text("html")
    return table(spark, folder, "pages").select("page_id", whole.alias("text"), F.length(whole).cast("bigint").alias("whole_length"))


@query
def mentions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.explode(text.mentions("text")).alias("handle"))


@query
def recent_turns(spark: SparkSession, folder: str) -> DataFrame:
    return windows.recent_per_session(table(spark, folder, "conversations"), 3)


@query
def recent_context(spark: SparkSession, folder: str) -> DataFrame:
    return messages.recent_context(table(spark, folder, "conversations"))


@query
def latest_pages(spark: SparkSession, folder: str) -> DataFrame:
    titled = table(spark, folder, "pages").select(
        "page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title")
    )
    return reports.latest_matching(titled, 10, ["tion", "que"], modified=["page_id"])


# --- sources and sinks ----------------------------------------------------------------


@query
def read_query(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "orders").createOrReplaceTempView("tidemark_orders")
    values = readers.report_params(19970101, 199701010000, 199701012350, user=["status=F"])
    sql = (
        "SELECT o_orderpriority, count(*) AS n FROM tidemark_orders"
        " WHERE o_orderstatus = :status AND year(o_orderdate) = :date_p div 10000 GROUP BY o_orderpriority"
    )
    used = {name: values[name] for name in ("status", "date_p")}
    return readers.read_query(spark, sql, used)


@query
def align_to_table(spark: SparkSession, folder: str) -> DataFrame:
    report = cumulative(events(spark, folder), TWO_KEYS, levels="leaf")
    target = writers.column_types("event_type string, requests double, amount decimal(10,1), date_minute bigint, date_p bigint")
    return plain(writers.align_to_table(report, target, ["date_p"]), "amount")


@query
def write_day_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """All days written, one of them replaced, everything read back."""
    report = cumulative(events(spark, folder), TWO_KEYS, levels="leaf")
    path = scratch_path(spark, "report")
    writers.write_days(report, path)
    marked = report.withColumn("requests", F.col("requests") + 1000)
    writers.write_day(marked, path, 20240102, files=2, slice_minutes=60)
    back = spark.read.orc(path)
    return plain(back.select("event_type", "date_minute", "requests", "users", "amount", "date_p"), "amount")


@query
def write_dynamic_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """A catalog table with two partition columns; the partitions written last win."""
    name = f"tidemark_facts_{uuid.uuid4().hex}"
    rows = events(spark, folder).groupBy(minutes.day_number("ts").alias("date_p"), F.col("band").alias("model_p")).agg(
        F.count(F.lit(1)).alias("cnt"), F.sum(F.col("value").cast("decimal(18,2)")).alias("amount")
    )
    columns = writers.column_types("cnt bigint, amount decimal(28,2), date_p int, model_p string")
    writers.create_day_table(spark, name, columns, ("date_p", "model_p"), path=scratch_path(spark, name))
    writers.write_dynamic(rows, name)
    low = rows.filter(F.col("model_p") == "low").withColumn("cnt", -F.col("cnt"))
    writers.write_dynamic(low, name)
    return plain(spark.table(name), "amount")


@query
def delimited_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a headerless text file of fields closed by a separator, read back as text."""
    path = scratch_path(spark, "landing")
    source = table(spark, folder, "events").select("event_id", "user_id", "event_type", "props")
    line = F.concat(F.concat_ws("\x01", *source.columns), F.lit("\x01"))
    source.select(line.alias("value")).write.text(path)
    return readers.read_delimited(spark, path, [*source.columns, "absent"])


@query
def read_detail(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as a text file with loose headers, read with the headers trimmed."""
    path = scratch_path(spark, "detail")
    loose = table(spark, folder, "orders").select(F.col("o_orderkey").alias(" o_orderkey "), F.col("o_orderstatus").alias("o_orderstatus\t"))
    loose.write.option("header", "true").option("ignoreLeadingWhiteSpace", "false").csv(path)
    back = readers.read_detail(spark, path, "csv", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")
    return back.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "o_orderstatus")


@query
def read_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as rules, written as a rule file in the fixed column order and read back."""
    path = scratch_path(spark, "rules")
    given = {**{c: F.lit("") for c in rules.RULE_COLUMNS}, "level1": F.col("p_name"), "event_id": F.lit("click"), "record_type": F.col("p_type")}
    fields = F.concat_ws("\x01", *[given[c] for c in rules.RULE_COLUMNS], F.lit(""))
    table(spark, folder, "part").select(fields.alias("value")).write.text(path)
    accepted, _ = rules.clean_rules(readers.read_rules(spark, path))
    return accepted.select("level1", "event_id", "record_type", "scm")


@query
def read_rules_files(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as rules in several files: ``rule_no`` follows the lines over all of them."""
    path = scratch_path(spark, "rule-files")
    fields = F.concat_ws("\x01", *[F.col("p_name") if c == "level1" else F.lit("") for c in rules.RULE_COLUMNS], F.lit(""))
    ordered = table(spark, folder, "part").repartitionByRange("p_partkey").sortWithinPartitions("p_partkey")
    ordered.select(fields.alias("value")).write.text(path)
    return readers.read_rules(spark, path).select("rule_no", "level1")


@query
def delimited_mixed(spark: SparkSession, folder: str) -> DataFrame:
    """Events as text files whose separators differ, one for each kind of event."""
    path = scratch_path(spark, "mixed")
    source = table(spark, folder, "events").select("event_id", "user_id", "event_type", "props")
    by_kind = {"click": "\x01", "view": "\x00", "error": "\t"}
    lines = F.coalesce(
        *[F.when(F.col("event_type") == kind, F.concat(F.concat_ws(s, *source.columns), F.lit(s))) for kind, s in by_kind.items()],
        F.concat_ws(",", *source.columns),
    )
    source.select(lines.alias("value"), F.col("event_type").alias("kind")).write.partitionBy("kind").text(path)
    return readers.read_delimited_files(spark, path, [*source.columns, "absent"])


@query
def insert_day_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """A day table: all days loaded, one day replaced by name, one day made known again."""
    name = f"tidemark_days_{uuid.uuid4().hex}"
    path = scratch_path(spark, name)
    rows = events(spark, folder).groupBy("event_type", minutes.day_number("ts").alias("date_p")).agg(F.count(F.lit(1)).alias("cnt"))
    writers.create_day_table(spark, name, writers.column_types("event_type string, cnt bigint, date_p int"), path=path)
    writers.write_dynamic(rows, name)
    writers.insert_overwrite_day(rows.withColumn("cnt", -F.col("cnt")), name, 20240102)
    spark.sql(f"ALTER TABLE {name} DROP PARTITION (date_p = 20240103)")
    writers.register_partition(spark, name, 20240103)
    back = spark.read.schema("event_type string, cnt bigint, date_p int").orc(path)
    known = spark.sql(f"SHOW PARTITIONS {name}").select(F.regexp_extract("partition", r"date_p=(\d+)", 1).cast("int").alias("date_p"))
    spark.sql(f"DROP TABLE {name}")  # its files have a place of their own and stay
    return back.join(known, "date_p").select("event_type", "cnt", "date_p")


# --- streams --------------------------------------------------------------------------


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)


@query
def stream_bucket_sums(spark: SparkSession, folder: str) -> DataFrame:
    updates = intraday.stream_bucket_sums(event_stream(spark, folder), TWO_KEYS, late="31 days")
    path = scratch_path(spark, "stream-sums")
    running = intraday.keep_latest(updates, path, f"{path}-state", [PERIOD, BUCKET, "event_type", "amount"])
    running.awaitTermination()
    latest = intraday.latest_updates(spark.read.parquet(path), [PERIOD, BUCKET, "event_type"], ["amount"])
    return plain(latest, "amount")


@query
def stream_first_seen(spark: SparkSession, folder: str) -> DataFrame:
    updates = intraday.stream_first_seen(event_stream(spark, folder), TWO_KEYS, "user_id", late="31 days")
    path = scratch_path(spark, "stream-keys")
    running = intraday.keep_latest(updates, path, f"{path}-state", [PERIOD, "event_type", "user_id", BUCKET])
    running.awaitTermination()
    latest = intraday.latest_updates(spark.read.parquet(path), [PERIOD, "event_type", "user_id"], [BUCKET])
    return plain(latest)


TEXT_STAMP = replace(TWO_KEYS, time_col="minute", day_col="day")


def arriving(spark: SparkSession, folder: str, parts: int, path: str, late: str) -> None:
    """Events that arrive in ``parts`` deliveries by their number, each read by a stream that then stops."""
    source = f"{path}-source"
    rows = table(spark, folder, "events")
    for i in range(parts):
        rows.filter(F.pmod("event_id", F.lit(parts)) == i).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        incremental.stream_slices(stream, TWO_KEYS, path, f"{path}-state", late).awaitTermination()


@query
def stream_late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Two of three events arrive long after their time: the report has all of them, and how many were late."""
    path = scratch_path(spark, "late-facts")
    arriving(spark, folder, 3, path, "2 days")
    late = incremental.late_rows(spark, path).agg(F.sum("late").alias("late"))
    report = incremental.report_of(incremental.read_state(spark, path, TWO_KEYS), TWO_KEYS, levels="leaf")
    return plain(report, "amount").withColumn("late_rows", late.scalar())


@query
def stream_text_stamp(spark: SparkSession, folder: str) -> DataFrame:
    """A stream whose stamps are text and whose stored day differs from them for some rows."""
    day = F.date_add("ts", F.when(F.pmod("user_id", F.lit(10)) == 0, 1).otherwise(0))
    stream = event_stream(spark, folder).withColumns({"minute": minutes.minute_text("ts"), "day": minutes.day_number(day)})
    path = scratch_path(spark, "text-facts")
    incremental.stream_slices(stream, TEXT_STAMP, path, f"{path}-state").awaitTermination()
    return plain(incremental.report_of(incremental.read_state(spark, path, TEXT_STAMP), TEXT_STAMP, levels="leaf"), "amount")


@query
def stream_compacted(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries of a stream merged into one slice, which the cube is made from."""
    path = scratch_path(spark, "delivered-facts")
    arriving(spark, folder, 4, path, "1 day")
    incremental.compact(spark, path, TWO_KEYS, f"{path}-compact", "all")
    return plain(incremental.report_of(incremental.read_state(spark, f"{path}-compact", TWO_KEYS), TWO_KEYS), "amount")
