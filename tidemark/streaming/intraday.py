"""The two reductions of the report, kept up to date from a stream (ST1, ST2).

The report itself stays a batch step over the sinks: running totals over a whole day's
spine are no streaming aggregation. Streams need a zoned time for their watermark, so the
stamp is cast; with the session zone at UTC it is the same stamp.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.cleaning import amount, dim_value, key_or_null
from tidemark.operators.aggregates import BUCKET, PERIOD, key_alias, stamp_column, sum_alias
from tidemark.spec import MetricSpec


def _zoned(stream: DataFrame, spec: MetricSpec, late: str) -> DataFrame:
    dims = [dim_value(F.col(d).cast("string"), spec.label_of(d)).alias(d) for d in spec.dims]
    return stream.select(
        stamp_column(stream, spec.time_col).cast("timestamp").alias("_time"),
        *dims,
        *[key_or_null(stream, k, spec).alias(key_alias(i)) for i, k in enumerate(spec.distincts)],
        *[amount(s, spec.sum_type).alias(sum_alias(i)) for i, s in enumerate(spec.sums)],
    ).withWatermark("_time", late)


def stream_bucket_sums(stream: DataFrame, spec: MetricSpec, late: str = "1 day") -> DataFrame:
    """ST1: amounts per dims and bucket; state is dropped once the watermark passes."""
    window = F.window("_time", f"{spec.step_minutes} minutes")
    return (
        _zoned(stream, spec, late)
        .groupBy(window, *spec.dims)
        .agg(*[F.sum(sum_alias(i)).alias(out) for i, out in enumerate(spec.sums.values())])
        .select(
            F.col("window.start").cast("timestamp_ntz").alias(BUCKET),
            F.col("window.start").cast("date").alias(PERIOD),
            *spec.dims,
            *spec.sums.values(),
        )
    )


def stream_first_seen(stream: DataFrame, spec: MetricSpec, key: str, late: str = "1 day") -> DataFrame:
    """ST2: earliest bucket of each key per day and dims, in update mode.

    A minimum, not ``dropDuplicates``: that keeps the first arrival, which may not be the
    earliest stamp. The day is a window, so a day's keys leave the state when it is over.
    """
    name = key_alias(list(spec.distincts).index(key))
    stamped = _zoned(stream, spec, late).filter(F.col(name).isNotNull())
    # whole minutes since the epoch, floored to the step
    minute = (F.unix_micros("_time") / 60_000_000).cast("bigint")
    floored = F.timestamp_micros((minute - F.pmod(minute, F.lit(spec.step_minutes))) * 60_000_000)
    return (
        stamped.withColumn("_bucket", floored)
        .groupBy(F.window("_time", "1 day"), *spec.dims, F.col(name).alias(key))
        .agg(F.min("_bucket").alias("_bucket"))
        .select(
            F.col("window.start").cast("date").alias(PERIOD),
            *spec.dims,
            key,
            F.col("_bucket").cast("timestamp_ntz").alias(BUCKET),
        )
    )


def keep_latest(
    updates: DataFrame, path: str, checkpoint: str, columns: list[str], *, format: str = "parquet", once: bool = True
) -> StreamingQuery:
    """Write update-mode rows of each batch to its own partition.

    Rewriting the batch's partition makes a repeated batch harmless. Readers take
    :func:`latest_updates`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        (
            batch.select(*columns)
            .withColumn("batch", F.lit(batch_id).cast("bigint"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch")
            .format(format)
            .save(path)
        )

    writer = updates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_updates(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The newest value of each key; combined before the shuffle."""
    return rows.groupBy(*keys).agg(*[F.max_by(v, "batch").alias(v) for v in values])
