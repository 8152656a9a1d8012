"""The operators of this subpackage over the given tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import coordinate_join, line_join, mcd, piece_paths, pivot_codes, plane_files, poisson_mix, quality_machine, sentence_spans, syncmers, toxic_segments, turn_search, url_trees

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
END = 2


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_syncmers(spark: SparkSession, folder: str) -> DataFrame:
    return syncmers.edited(table(spark, folder, "documents"))


@query
def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    machine = quality_machine.train(docs, table(spark, folder, "labels"))
    scores = quality_machine.scored(docs, machine)
    return scores.select("doc_id", quality_machine.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op3_planes(spark: SparkSession, folder: str) -> DataFrame:
    return plane_files.round_trip(table(spark, folder, "documents"), BPE, END)


@query
def op4_urls(spark: SparkSession, folder: str) -> DataFrame:
    return url_trees.judge(table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")


@query
def op5_lines(spark: SparkSession, folder: str) -> DataFrame:
    return line_join.cleaned(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


@query
def op6_spans(spark: SparkSession, folder: str) -> DataFrame:
    return sentence_spans.deduplicated(table(spark, folder, "documents"))


@query
def op7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return poisson_mix.mixed(docs).select("doc_id", "source", "text", F.col("mix_copy").alias("copy_no"), "mix_order")


@query
def op8_outliers(spark: SparkSession, folder: str) -> DataFrame:
    return mcd.judge(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("d2").alias("distance2")
    )


@query
def op9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text back."""
    return piece_paths.checked(table(spark, folder, "documents"), PIECES)


@query
def op10_near(spark: SparkSession, folder: str) -> DataFrame:
    return coordinate_join.near_duplicates(table(spark, folder, "documents"), k=3, percent=85)


@query
def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scores = toxic_segments.scored(docs, toxic_segments.train(docs, table(spark, folder, "labels")))
    return scores.select(
        "doc_id",
        toxic_segments.held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("passages").cast("bigint").alias("n_passages"),
    )


@query
def op12_repair(spark: SparkSession, folder: str) -> DataFrame:
    return turn_search.mended(table(spark, folder, "conversations"))


@query
def op13_codes(spark: SparkSession, folder: str) -> DataFrame:
    return pivot_codes.judged(table(spark, folder, "embeddings"))


#: The mixture is the only operator here that SQL can express: hashes are of md5 text, and a
#: Poisson count is found by adding terms.
SQL: dict[str, str] = {
    "op7_mixture": """
WITH RECURSIVE sizes AS (
  SELECT source, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS chars FROM documents GROUP BY source
), sums AS (
  SELECT sum(chars) AS total, round(sum(pow(chars, 0.5)), 3) AS tempered FROM sizes
), rates AS (
  SELECT source, CASE WHEN chars > 0 THEN round(pow(chars, 0.5) / tempered * total / chars, 9) ELSE 1.0 END AS rate
  FROM sizes, sums
), terms AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM terms
  WHERE k + 1 <= CAST(floor(rate + 12 * sqrt(rate) + 30) AS INT)
), drawn AS (
  SELECT d.doc_id, d.source, d.text,
    CAST(CAST('0x' || substr(md5('17:count:' || coalesce(source, '') || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM documents d
), counted AS (
  SELECT d.doc_id, d.source, d.text, (SELECT count(*) FROM terms t WHERE t.source IS NOT DISTINCT FROM d.source AND round(t.c, 12) <= d.u) AS times
  FROM drawn d
)
SELECT doc_id, source, text, CAST(copy_no AS INT) AS copy_no,
  CAST('0x' || substr(md5('17:order:' || coalesce(source, '') || ':' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(copy_no AS VARCHAR)), 1, 13) AS BIGINT) AS mix_order
FROM (SELECT *, unnest(range(1, times + 1)) AS copy_no FROM counted)
""",
}
