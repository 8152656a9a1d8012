"""Day-partitioned results.

Writes go through Spark's committer, so a lost executor leaves no partial day behind.
"""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.minutes import as_date
from tidemark.spec import quote

LOG = logging.getLogger(__name__)

# Defaults of the sink.
FILES_PER_WRITE = 16
CODEC = "snappy"
MODES = ("overwrite", "append")
DELETE_CHUNK = 10_000


def column_types(ddl: str) -> StructType:
    """Types of a column list; decimals keep their precision and scale."""
    return StructType.fromDDL(ddl)


def align_to_table(df: DataFrame, target: StructType, partitions: Sequence[str] = (), day: str = "date_p") -> DataFrame:
    """K3: target columns, order and types. All of the target's columns must exist, and
    the day must be one of its partition columns."""
    if partitions and day not in partitions:
        raise ValueError(f"{day} is not a partition column of the target: {list(partitions)}")
    missing = [f.name for f in target.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"result lacks target columns: {missing}; it has {df.columns}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target.fields])


def _sized(df: DataFrame, files: int | None, by: Sequence[str]) -> DataFrame:
    """Files per write. A fixed number is a shuffle rather than a coalesce: the last step
    of a report multiplies rows and must keep its parallelism. Without a number, adaptive
    execution sizes the files and splits a day that holds most rows."""
    if files is None:
        return df.hint("rebalance", *by)
    if files <= 0:
        files = FILES_PER_WRITE
    return df.repartition(files)


def slice_of(minute: str, slice_minutes: int):
    """K4: number of the time slice of a ``YYYYMMDDHHmm`` stamp within its day."""
    if slice_minutes <= 0 or slice_minutes % 10:
        raise ValueError("slice minutes must be a positive multiple of 10")
    text = F.col(minute).cast("string")
    minutes = F.substring(text, 9, 2).cast("int") * 60 + F.substring(text, 11, 2).cast("int")
    return F.floor(minutes / slice_minutes).cast("int")


def write_day(
    df: DataFrame,
    path: str,
    day: dt.date | str | int,
    mode: str = "overwrite",
    *,
    files: int | None = None,
    codec: str = CODEC,
    slice_minutes: int | None = None,
    minute: str = "date_minute",
    max_records_per_file: int | None = None,
    format: str = "orc",
) -> int:
    """K1, K4-K6: rows of one day into its partition; other days are left alone. Returns the rows written.

    Overwriting is dynamic, so a result without rows of the day overwrites nothing; it is reported as a warning.
    Slices are one write whose rows lie in slice order, not a loop of writes.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    rows = df.filter(F.col("date_p") == int(f"{as_date(day):%Y%m%d}"))
    rows, seen = _counted(_write_order(rows, files, slice_minutes, minute))
    _writer(rows, mode, codec, max_records_per_file, format).partitionBy("date_p").save(path)
    return _noticed(seen, f"{path}, day {as_date(day)}")


def write_days(
    df: DataFrame,
    path: str,
    partitions: Sequence[str] = ("date_p",),
    mode: str = "overwrite",
    *,
    files: int | None = None,
    codec: str = CODEC,
    max_records_per_file: int | None = None,
    format: str = "orc",
) -> int:
    """K1 for every day of a result at once; only days that occur are replaced. Returns the rows written."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    rows, seen = _counted(_sized(df, files, partitions))
    _writer(rows, mode, codec, max_records_per_file, format).partitionBy(*partitions).save(path)
    return _noticed(seen, path)


def _write_order(rows: DataFrame, files: int | None, slice_minutes: int | None, minute: str) -> DataFrame:
    if not slice_minutes:
        return _sized(rows, files, ["date_p"])
    sliced = rows.withColumn("_slice", slice_of(minute, slice_minutes))
    sized = sliced.hint("rebalance", "_slice") if files is None else sliced.repartitionByRange(files, "_slice", minute)
    return sized.sortWithinPartitions("_slice").drop("_slice")


def _writer(rows: DataFrame, mode: str, codec: str, max_records: int | None, format: str):
    writer = (
        rows.write.mode(mode)
        .format(format)
        .option("compression", codec)
        .option("partitionOverwriteMode", "dynamic")
    )
    return writer if max_records is None else writer.option("maxRecordsPerFile", max_records)


def table_layout(spark: SparkSession, table: str) -> tuple[StructType, list[str]]:
    """Schema and partition columns of a table, from the catalog."""
    columns = spark.catalog.listColumns(table)
    return spark.table(table).schema, [c.name for c in columns if c.isPartition]


def write_dynamic(df: DataFrame, table: str, mode: str = "overwrite", *, files: int | None = None, day: str = "date_p") -> int:
    """K2, K3: into an existing partitioned table; partitions that occur are replaced. Returns the rows written.

    Rows are staged beside the table and swapped in partition by partition when all are written, as an option of this one
    write: no session setting changes, so several writers may run at once, as long as their partitions differ.
    The table keeps its partitions in its own folder.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    spark = df.sparkSession
    schema, partitions = table_layout(spark, table)
    aligned = _sized(align_to_table(df, schema, partitions, day), files, partitions)
    # ``date_p = 20251226, kind = 'a'`` of every partition written, few beside its rows
    one = F.concat_ws(", ", *[F.concat(F.lit(f"{quote(p)} = "), _literal(p)) for p in partitions])
    counted, seen = _counted(aligned, F.array_join(F.collect_set(one), "\n").alias("partitions"))
    if mode == "append":
        counted.write.insertInto(table)
    else:
        told = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
        writer = counted.write.mode("overwrite").format(told["Provider"]).option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*partitions).save(told["Location"])
        for part in filter(None, (seen.get["partitions"] or "").split("\n")):
            spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION ({part})")
        spark.catalog.refreshTable(table)
    return _noticed(seen, table)


def _literal(column: str):
    """A partition's value as SQL text."""
    value = F.col(column).cast("string")
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.coalesce(F.concat(F.lit("'"), escaped, F.lit("'")), F.lit("null"))


def _counted(rows: DataFrame, *more) -> tuple[DataFrame, Observation]:
    """Rows that are counted while they are written."""
    seen = Observation()
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *more), seen


def _noticed(seen: Observation, target: str) -> int:
    """Rows written; a result without any is reported, since it replaces nothing."""
    rows = seen.get["rows"]
    if not rows:
        LOG.warning("no rows for %s: what it holds is left as it was", target)
    return rows


def create_day_table(
    spark: SparkSession,
    table: str,
    columns: StructType,
    partitions: Sequence[str] = ("date_p",),
    path: str | None = None,
    format: str = "orc",
) -> None:
    """A partitioned table for results, when there is none yet."""
    listed = ", ".join(f"{quote(f.name)} {f.dataType.simpleString()}" for f in columns.fields)
    place = f" LOCATION '{path}'" if path else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({listed}) USING {format}"
        f" PARTITIONED BY ({', '.join(quote(p) for p in partitions)}){place}"
    )


def register_partition(spark: SparkSession, table: str, day: dt.date | str | int) -> None:
    """K7: make a day's folder known to the catalog; a known one is fine."""
    spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION (date_p = {int(f'{as_date(day):%Y%m%d}')})")


def insert_overwrite_day(df: DataFrame, table: str, day: dt.date | str | int) -> None:
    """K9: replace one named day partition; the rows' own ``date_p`` is left out."""
    spark = df.sparkSession
    schema, partitions = table_layout(spark, table)
    body = StructType([f for f in schema.fields if f.name != "date_p"])
    number = int(f"{as_date(day):%Y%m%d}")
    rows = align_to_table(df.filter(F.col("date_p") == number), body, partitions)
    spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION (date_p = {number}) SELECT * FROM {{rows}}", rows=rows)


def write_jdbc_day(
    df: DataFrame,
    url: str,
    table: str,
    day: dt.date | str | int,
    mode: str = "overwrite",
    *,
    properties: dict[str, str] | None = None,
    chunk: int = DELETE_CHUNK,
    stage: str | None = None,
    connect: Callable[[], object] | None = None,
) -> None:
    """K8: one day's rows into a database table.

    Executors load a staging table in parallel. Then one transaction deletes the day and
    copies the staged rows over, so readers never see a half-written day and a failed
    load leaves the old day in place. ``table`` must exist.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    number = int(f"{as_date(day):%Y%m%d}")
    rows = df.filter(F.col("date_p") == number)
    staging = stage or f"{table}_stage_{number}"
    rows.write.option("batchsize", chunk).jdbc(url, staging, mode="overwrite", properties=properties or {})
    connection = connect() if connect else _jvm_connection(df.sparkSession, url, properties or {})
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        try:
            for sql in swap_statements(table, staging, df.columns, number, mode):
                statement.executeUpdate(sql)
            connection.commit()
            statement.executeUpdate(f"DROP TABLE {staging}")
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            statement.close()
    finally:
        connection.close()


def swap_statements(table: str, staging: str, columns: Sequence[str], day: int, mode: str) -> list[str]:
    names = ", ".join(columns)
    copy = f"INSERT INTO {table} ({names}) SELECT {names} FROM {staging}"
    return [f"DELETE FROM {table} WHERE date_p = {day}", copy] if mode == "overwrite" else [copy]


def _jvm_connection(spark: SparkSession, url: str, properties: dict[str, str]):
    jvm = spark.sparkContext._jvm
    settings = jvm.java.util.Properties()
    for name, value in properties.items():
        settings.setProperty(name, value)
    return jvm.java.sql.DriverManager.getConnection(url, settings)
