"""Detail rows and rules from files, tables and queries."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.cleaning import strip_headers
from tidemark.operators.rules import RULE_COLUMNS

# Field separators of landing files in the order they are tried.
SEPARATORS = ("\x01", "\x00", "\t", ",")


def read_detail(
    spark: SparkSession, path: str, format: str = "parquet", schema: StructType | str | None = None, **options: str
) -> DataFrame:
    """A detail file, with its headers trimmed."""
    reader = spark.read.format(format).options(**({"header": "true", **options} if format == "csv" else options))
    return strip_headers((reader.schema(schema) if schema is not None else reader).load(path))


def report_params(
    date_p: int | str,
    start_ts: int | str,
    end_ts: int | str,
    date_minute10: int | str | None = None,
    user: Sequence[str] = (),
) -> dict[str, int | str]:
    """The named values of a report run; ``user`` holds ``key=value`` texts."""

    def floored(stamp: int | str) -> int:
        return int(stamp) - int(stamp) % 10

    for stamp in (start_ts, end_ts):
        dt.datetime.strptime(str(stamp), "%Y%m%d%H%M")
    values: dict[str, int | str] = {
        "date_p": int(date_p),
        "start_ts": int(start_ts),
        "end_ts": int(end_ts),
        "start_ts_10": floored(start_ts),
        "end_ts_10": floored(end_ts),
        "date_minute10": int(date_minute10) if date_minute10 is not None else floored(end_ts),
    }
    for pair in user:
        name, found, value = pair.partition("=")
        if not found or not name.strip():
            raise ValueError(f"a parameter is given as key=value: {pair!r}")
        values[name.strip()] = value.strip()
    return values


def read_query(spark: SparkSession, sql: str, params: Mapping[str, int | str] | None = None) -> DataFrame:
    """Rows of a query with ``:name`` markers. Values are bound, never pasted into
    the text; a marker without a value is an error."""
    return spark.sql(sql, args=dict(params or {}))


def _split_fields(line: Column, separator: str | None, fields: Sequence[str]) -> list[Column]:
    if not separator:
        return [(line if i == 0 else F.lit("")).alias(f) for i, f in enumerate(fields)]
    return _fields_of(F.split(line, _regex(separator), -1), fields)


def _fields_of(parts: Column, fields: Sequence[str], closes: Column | None = None) -> list[Column]:
    # one empty field at the end comes from a separator that closes the line
    closed = F.element_at(parts, -1) == ""
    if closes is not None:
        closed = closed & closes
    kept = F.when(closed, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return [F.coalesce(F.get(kept, F.lit(i)), F.lit("")).alias(f) for i, f in enumerate(fields)]


def _regex(separator: str) -> str:
    return f"\\x{ord(separator):02x}"


def find_separator(lines: DataFrame) -> str | None:
    """The first candidate in the first line; ``""`` when it has none, None without a line."""
    first = lines.head(1)
    if not first:
        return None
    return next((s for s in SEPARATORS if s in first[0][0]), "")


def read_delimited(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """S3: a headerless text file, all columns text.

    The separator is found on the first line. Short rows are filled with ``''``, long
    rows cut, bad UTF-8 replaced. A file without separator gives its lines as the first
    column; an empty file gives an empty frame.
    """
    lines = spark.read.text(path).select(F.make_valid_utf8("value").alias("value"))
    separator = find_separator(lines)
    names = (list(fields[:1]) or ["col0"]) if separator == "" else list(fields)
    return lines.select(*_split_fields(F.col("value"), separator, names))


FILE, BLOCK, PLACE = "_file", "_block", "_place"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value`` and where it stands: file, start of the block that a task reads, and a number that ascends within the block."""
    found = spark.read.text(path).select(
        F.make_valid_utf8("value").alias("value"),
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
    )
    return found.withColumn(PLACE, F.monotonically_increasing_id())


def numbered_lines(lines: DataFrame, name: str) -> DataFrame:
    """Lines of :func:`read_lines` numbered from 0: files by path, then the order in the file.

    Blocks are counted, and each block starts where those before it end. Lines are not shuffled; the window is over one
    row per block.
    """
    blocks = lines.groupBy(FILE, BLOCK).agg(F.min(PLACE).alias("_from"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy(FILE, BLOCK).rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    number = F.col(PLACE) - F.col("_from") + F.col("_before")
    return lines.join(starts, [FILE, BLOCK]).withColumn(name, number).drop("_from", "_before")


def read_delimited_files(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """S3 for a folder whose files have separators of their own, each found on its file's first line.

    A file without a separator gives its lines as the first field; the other rules are those of :func:`read_delimited`.
    """
    lines = read_lines(spark, path)
    found = F.coalesce(*[F.when(F.contains("value", F.lit(s)), F.lit(_regex(s))) for s in SEPARATORS])
    first = lines.groupBy(FILE).agg(F.min_by(F.struct(found.alias("s")), F.struct(BLOCK, PLACE)).alias("f")).select(FILE, F.col("f.s").alias("_by"))
    joined = lines.join(first, FILE)
    parts = F.split("value", F.coalesce("_by", F.lit("(?!)")), -1)
    columns = _fields_of(parts, fields, closes=F.col("_by").isNotNull())
    return joined.select(*columns)


def read_rules(spark: SparkSession, path: str, columns: Sequence[str] = RULE_COLUMNS) -> DataFrame:
    """Rule files in fixed column order, with ``rule_no`` in line order over all files and their blocks."""
    lines = numbered_lines(read_lines(spark, path), "rule_no")
    return lines.select("rule_no", *_split_fields(F.col("value"), SEPARATORS[0], columns))
