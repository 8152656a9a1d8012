"""Mixing sources to target weights by Poisson replication.

Each source has a repetition rate: its target share of the mixture over its share of the
corpus. A document is repeated a Poisson number of times with that mean, found by inverting
the distribution at a uniform number that hashes its seed, source and doc_id; the copies are
then put in a global order by another hash. Nothing is drawn at run time, so a lost task
repeats the same copies. A rate above ``PART`` is divided into equal parts of at most that, whose
counts are drawn with a uniform number each and added; a sum of Poisson numbers is one of the
summed rate. One series per rate would start at ``exp(-rate)``, which is 0 above 745.

Targets: ``weights`` names shares by source; the sources it does not name divide the rest by
their tempered size, ``size ** alpha``. Sizes are characters of text over all documents, and
``epochs`` times the corpus is the size of the mixture.

Defined results: null is a source of its own. A null text has no characters but is replicated
like any other. Rows that repeat a doc_id and source get the same number of copies; for rows
without doc_id, those that repeat a text and source. A source without characters has rate 1. An
empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import let, stored, total

ALPHA, EPOCHS, SEED = 0.5, 1.0, 17
#: The largest rate that one series gives; exp(-PART) is still a normal double.
PART = 700.0


def hashed(*parts: Column) -> Column:
    """52 bits of the md5 of the parts' text, as a bigint."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")


def uniform(*parts: Column) -> Column:
    return hashed(*parts).cast("double") / float(1 << 52)


def cumulative(rate: Column) -> Column:
    """P(count <= k) for k = 0, 1, ... until what is left is below any uniform number's step."""
    length = (rate + 12 * F.sqrt(rate) + 30).cast("int")
    terms = F.aggregate(
        F.sequence(F.lit(1), length),
        F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c")),
        lambda s, k: F.struct(
            (s["p"] * rate / k).alias("p"),
            F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * rate / k)).alias("c"),
        ),
        lambda s: s["c"],
    )
    return F.transform(terms, lambda c: F.round(c, 12))


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = ALPHA, epochs: float = EPOCHS) -> DataFrame:
    """(source, rate, parts, cdf), one row per source; cdf is of the rate over parts."""
    named = dict(weights or {})
    if any(w < 0 for w in named.values()) or sum(named.values()) > 1 + 1e-9:
        raise ValueError("weights are shares of one")
    chars = F.coalesce(F.length("text"), F.lit(0)).cast("bigint")
    sizes = stored(docs.groupBy("source").agg(F.sum(chars).alias("chars")), "mix-sizes")
    given = F.coalesce(*(F.when(F.col("source") == k, F.lit(float(w))) for k, w in named.items()), F.lit(None).cast("double"))
    part = sizes.select("source", "chars", given.alias("given"), F.when(given.isNull(), F.pow(F.col("chars").cast("double"), alpha)).alias("tempered"))
    # Two numbers; rounded, so that the order of addition leaves no trace.
    sums = part.agg(F.sum("chars").alias("chars"), F.round(F.sum("tempered"), 3).alias("tempered")).first()
    size, tempered = float(sums["chars"] or 0), float(sums["tempered"] or 0)
    share = F.coalesce("given", F.lit(1 - sum(named.values())) * F.col("tempered") / F.lit(tempered or 1.0))
    rate = F.when(F.col("chars") > 0, F.round(share * F.lit(epochs * size) / F.col("chars"), 9)).otherwise(F.lit(1.0))
    return stored(part.select("source", rate.alias("rate")).withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")).withColumn("cdf", cumulative(F.col("rate") / F.col("parts"))), "mix-rates")


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = ALPHA, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """``docs``, all columns, replicated and in global random order, with ``mix_copy`` (from 1)
    and ``mix_order``; both names get underscores where a column has them already."""
    copy, order = "mix_copy", "mix_order"
    while copy in docs.columns or order in docs.columns:
        copy, order = f"{copy}_", f"{order}_"
    table = rates(docs, weights, alpha, epochs).select(F.col("source").alias("source__"), F.col("parts").alias("parts__"), F.col("cdf").alias("cdf__"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text-"), F.md5(F.col("text").cast("binary"))))

    def drawn(*part: Column) -> Column:
        u = uniform(F.lit(seed), F.lit("count"), F.col("source"), name, *part)
        return let(u, lambda v: F.size(F.filter("cdf__", lambda c: c <= v)))

    more = total(F.transform(F.sequence(F.lit(2), F.col("parts__")), lambda i: drawn(i)), "int")
    joined = docs.join(table, F.col("source").eqNullSafe(F.col("source__")))
    times = drawn() + F.when(F.col("parts__") > 1, more).otherwise(0)
    copies = joined.withColumn("times__", times).where("times__ > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("times__"))))
    placed = copies.withColumn(order, hashed(F.lit(seed), F.lit("order"), F.col("source"), name, F.col(copy)))
    return placed.select(*docs.columns, copy, order).orderBy(order, "doc_id", copy)
