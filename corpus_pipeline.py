"""The corpus pipeline: stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. ``run``
writes every stage's result to the shared folder and reads it again for the next, as a lost
executor must not bring back the work of earlier stages.

All stages but the last return the columns of ``documents``. A stage that changes texts sets
``n_chars`` anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import coordinate_join, line_join, piece_paths, poisson_mix, quality_machine
from tidemark.llm.common import measured, stored
from tidemark.llm.queries import PIECES


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier holds likelier good than bad; the labels teach it."""
    return quality_machine.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that are like an earlier line of any document.

    A document whose lines are all gone stays, with the text that is left of it.
    """
    cleaned = line_join.cleaned(docs).select(*docs.columns)
    return cleaned.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at five-word shingles and a likeness of 0.8 or more.

    Rows are judged, not doc_ids: each gets a number of its own, in the order of (doc_id, text) with null ids
    last, and the first row of a group stays. So a doc_id that stands for two texts keeps the one that is unlike others.
    Rows without a word stay.
    """
    own = "row_number"
    while own in docs.columns:
        own += "_"
    order = [F.asc_nulls_last("doc_id"), F.asc("text")]
    sorted_rows = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    # Numbers ascend with the order, as partitions do; stored, so that they never change.
    rows = stored(sorted_rows.withColumn(own, F.monotonically_increasing_id()), "pipeline-rows")
    judged = coordinate_join.near_duplicates(rows.select(F.col(own).alias("doc_id"), "text"), k=5, percent=80)
    gone = stored(judged.where("NOT kept").select(F.col("doc_id").alias(f"{own}_gone")), "pipeline-near")
    return rows.join(measured(gone), F.col(own) == F.col(f"{own}_gone"), "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their tempered shares: documents repeated, in a global random order."""
    return poisson_mix.mixed(docs).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, the ids of the text and their number."""
    encoded = piece_paths.encoded(docs, PIECES)
    return encoded.withColumn("n_pieces", F.size("piece_ids").cast("bigint"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("pieces", pieces),
]

#: The classifier, the signatures and the best paths are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
