"""The report kept up to date slice by slice (A1, A3, A5), from batches or a stream.

The state is a table of reduced facts: amounts per (dims, bucket) and the first bucket per
(dims, key), the same rows that the report makes first. They merge: amounts add up exactly and the
earliest bucket wins, in any order. So a new 10-minute slice reads its own detail rows only, adds its facts
to the table as a partition of its own, and the report is made from the table:

    write_slice(detail_of_the_slice, spec, path, "202512261210")
    report = report_of(read_state(spark, path, spec), spec)

A slice that is written again replaces its own partition, so a repeated run counts nothing twice. Late
rows need nothing special: they are part of the slice in which they arrive, and their facts merge
with those of the time they belong to. ``compact`` merges slices into one.

A row that is read into two slices counts its amounts twice: the names must say what was read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.amounts import part_names, tidied
from tidemark.functions.minutes import as_date, at_time, minute_of_day
from tidemark.operators.aggregates import BUCKET, PERIOD, key_alias, prepare, with_times
from tidemark.plans.cumulative import OWN_BUCKET, SLOT, leaf_facts, report_of_facts
from tidemark.spec import Levels, MetricSpec

SLICE = "slice"


def slice_facts(df: DataFrame, spec: MetricSpec) -> DataFrame:
    """Detail rows reduced to facts."""
    return leaf_facts(prepare(df, spec), spec)


def merged(facts: DataFrame, spec: MetricSpec) -> DataFrame:
    """Facts of any number of slices as one fact each; combined before the shuffle."""
    keys = [key_alias(i) for i in range(len(spec.distincts))]
    parts = part_names(spec)
    groups = [PERIOD, *spec.dims, SLOT, OWN_BUCKET, *keys]
    added = facts.groupBy(*groups).agg(F.min(BUCKET).alias(BUCKET), *[F.sum(p).cast(facts.schema[p].dataType).alias(p) for p in parts])
    return tidied(added, spec)


def write_slice(df: DataFrame, spec: MetricSpec, path: str, name: str) -> None:
    """The facts of one slice's detail rows, as the partition of its name; an earlier try is replaced, also by no rows."""
    _write(slice_facts(df, spec), path, name)


def _folder(name: str) -> str:
    """A name that Spark never takes for a number or a day when it reads the folder."""
    return f"s_{name}"


def _write(facts: DataFrame, path: str, name: str) -> None:
    facts.write.mode("overwrite").parquet(f"{path}/{SLICE}={_folder(name)}")


def read_state(spark: SparkSession, path: str, spec: MetricSpec, slices: Sequence[str] | None = None) -> DataFrame:
    """The merged facts of all slices, or of those named."""
    rows = spark.read.parquet(path)
    if slices is not None:
        rows = rows.filter(F.col(SLICE).isin(*map(_folder, slices)))
    return merged(rows.drop(SLICE), spec)


def compact(spark: SparkSession, path: str, spec: MetricSpec, target: str, name: str) -> None:
    """All slices of ``path`` as the one slice ``name`` of another table, ``target``.

    The old table is left as it is: who reads it goes on reading it, and switches to ``target`` when that is written.
    """
    _write(read_state(spark, path, spec), target, name)


def report_of(
    state: DataFrame,
    spec: MetricSpec,
    *,
    levels: Levels = "cube",
    start: str | int | None = None,
    end: str | int | None = None,
    days: Sequence | None = None,
    **options,
) -> DataFrame:
    """The cumulative report of merged facts, as :func:`tidemark.plans.cumulative.cumulative` makes it of detail rows.

    Facts before ``start`` are the opening balance of the first point; those behind the bucket of ``end`` are left out.
    """
    first, last = minute_of_day(start, 0), minute_of_day(end, 1440 - spec.step_minutes)
    if first > last:
        raise ValueError("start lies after end")
    first, last = first - first % spec.step_minutes, last - last % spec.step_minutes
    chosen = [as_date(d) for d in days] if days else None
    if chosen:
        state = state.filter(F.col(PERIOD).isin(*chosen))
    if spec.period == "day":
        opened = F.greatest(BUCKET, at_time(PERIOD, first))
        state = state.filter(F.col(BUCKET) <= at_time(PERIOD, last)).withColumn(BUCKET, opened)
    elif start is not None or end is not None:
        raise ValueError("start and end are times of day; they need period='day'")
    return report_of_facts(state, spec, levels=levels, first=first, last=last, days=chosen, **options)


def stream_slices(
    stream: DataFrame, spec: MetricSpec, path: str, checkpoint: str, late: str = "1 day", *, once: bool = True
) -> StreamingQuery:
    """ST1, ST2 without loss: each micro-batch is a slice, and none of its rows is dropped for its time.

    Rows more than ``late`` behind the latest stamp of earlier batches are what a watermark would drop. Here they
    merge like all others, and are counted under ``path``-late: :func:`late_rows`. There is no state in memory, so
    nothing has to be dropped to keep it small. A repeated batch replaces what it wrote.
    """
    marks = f"{path}-late"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, name = batch.sparkSession, f"{batch_id:020d}"
        _write(slice_facts(batch, spec), path, name)
        # earlier batches only: a repeated one must count as it did the first time
        before = _marks(spark, marks).filter(F.col("batch") < batch_id).agg((F.max("latest") - F.expr(f"INTERVAL {late}")).alias("mark"))
        stamped = with_times(batch, ("_stamp", spec.time_col)).select(F.col("_stamp").cast("timestamp_ntz").alias("stamp"))
        behind = stamped.withColumn("mark", before.scalar()).filter("stamp IS NOT NULL")
        counts = behind.agg(
            F.lit(batch_id).cast("bigint").alias("batch"),
            F.max("stamp").alias("latest"),
            F.count_if(F.col("stamp") < F.col("mark")).alias("late"),
            F.count(F.lit(1)).alias("rows"),
        )
        counts.write.mode("overwrite").parquet(f"{marks}/part={batch_id}")

    # an empty part, so that the first batch has a table to read
    stream.sparkSession.createDataFrame([], MARKS).write.mode("overwrite").parquet(f"{marks}/part=-1")
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


MARKS = "batch bigint, latest timestamp_ntz, late bigint, rows bigint"


def _marks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MARKS).parquet(path)


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """``batch, latest, late, rows`` per micro-batch: how many of its rows a watermark would have dropped."""
    return _marks(spark, f"{path}-late").select("batch", "latest", "late", "rows")
