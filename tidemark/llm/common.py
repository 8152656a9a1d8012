"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import scratch_path

#: What separates words, in the notation of a Java pattern: ASCII white space only.
SPACES = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body reads it.

    A lambda that reads a column reads its expression, once per element; one that reads
    another lambda's variable reads a value.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text, an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def total(values: Column, kind: str = "bigint") -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, b: a + b)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written under the folder that all executors share, and read again.

    This cuts the lineage: what reads the result never repeats the work before it, whichever
    executors are lost. The planner also knows the written size, so that a small result is
    broadcast and a large one is not.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Let the executors' Python import this library, whatever folder they start in.

    The driver's own copy is zipped once per application and sent by Spark.
    """
    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    name = Path(tempfile.mkdtemp(prefix="tidemark-ship-")) / root.name
    context.addPyFile(shutil.make_archive(str(name), "zip", root.parent, root.name))
    context._tidemark_shipped = True


#: Rows of a few numbers that a broadcast may have: about ten megabytes.
BROADCAST = 200_000


def measured(table: DataFrame, limit: int = BROADCAST) -> DataFrame:
    """A stored ``table`` of narrow rows, marked for broadcast if it was counted to be small.

    Beyond the limit the join shuffles both sides; the results are the same.
    """
    return F.broadcast(table) if table.limit(limit + 1).count() <= limit else table


def document_key() -> tuple[Column, Column]:
    """(k, x): what names a document. Null ids come last; x, 64 bits, tells texts of one id apart.

    Rows that repeat both are one document.
    """
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1)).alias("k"), F.xxhash64("text").alias("x")
