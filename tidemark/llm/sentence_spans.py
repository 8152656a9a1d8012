"""Substring dedup by sliding spans of sentences.

A text is cut behind sentence marks and line ends. Every run of ``SPAN`` consecutive sentences
is hashed, and every shorter run that has ``LEAST_WORDS`` words; all spans of all documents meet
by their hash. Of the equal spans the first, in the order of (doc_id, place), stays; the sentences
under any other are removed. What is left of a text is put together unchanged.

Only whole sentences are compared and removed. Of a repeated passage that starts or ends inside a
sentence, the parts of those two sentences stay, and all of it stays where the whole sentences in
it are fewer than ``SPAN`` and have fewer than ``LEAST_WORDS`` words. The README has a figure.

Spans are compared by 96 bits. Only the count and the smallest doc_id of a hash are
aggregated, combined before the shuffle, so a passage in a third of all documents is one row
per upstream task. The spans of a hash that occurs more than ``HEAVY`` times are spread over lanes of about
that many where they meet the hash's row, which is repeated once per lane.

Defined results: null and empty texts have no sentences and stay as they are. A text of fewer
than ``SPAN`` sentences is one span, whatever its words. White space around sentences does not count; pieces of
white space alone are no sentences and stay. Rows without doc_id come last. Rows that repeat a
doc_id and text are one document and are cut alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import document_key, let, stored, words_of

SPAN = 3
#: Words that a run of fewer than ``SPAN`` sentences must have to be compared.
LEAST_WORDS = 40
#: Spans of one hash that a lane holds at least, and the hashes that can be spread at once.
HEAVY, MOST_HEAVY = 10_000, 100_000
CUT = r"(?<=[.!?\n])(?=[^.!?\n])"
BLANK = " \t\r\n\f"


def pieces(text: Column) -> Column:
    """The text in pieces that end behind sentence marks; joined, they are the text."""
    return F.split(F.coalesce(text, F.lit("")), CUT)


def _spans(text: Column, span: int, least: int) -> Column:
    """array<struct<j, n, a, b>>: first sentence, length and hashes of each run of sentences."""

    def of_sentences(h: Column) -> Column:
        def run(i: Column, n: int) -> Column:
            parts = [F.get(h, i + d) for d in range(n)]
            hashes = [p["h"] for p in parts]
            fit = i + n <= F.size(h)
            if n < span:
                fit = fit & ((F.size(h) == n) | (sum((p["w"] for p in parts[1:]), parts[0]["w"]) >= least))
            return F.when(fit, F.struct(i.alias("j"), F.lit(n).alias("n"), F.xxhash64(*hashes).alias("a"), F.hash(*hashes).alias("b")))

        runs = F.transform(h, lambda _, i: F.array(*(run(i, n) for n in range(1, span + 1))))
        return F.filter(F.flatten(runs), lambda r: r.isNotNull())

    trimmed = F.filter(F.transform(pieces(text), lambda p: F.btrim(p, F.lit(BLANK))), lambda p: p != "")
    return let(F.transform(trimmed, lambda p: F.struct(F.xxhash64(p).alias("h"), F.size(words_of(p)).alias("w"))), of_sentences)


def covered(docs: DataFrame, span: int = SPAN, least: int = LEAST_WORDS) -> DataFrame:
    """(k, x, runs): for each document with repeats, start and length of the spans that are not the first."""
    k, x = document_key()
    spans = docs.select(k, x, F.explode(_spans(F.col("text"), span, least)).alias("s")).select("k", "x", "s.j", "s.n", "s.a", "s.b")
    repeats = spans.groupBy("a", "b").agg(F.count("*").alias("times"), F.min("k").alias("low")).where("times > 1")
    repeats = stored(repeats, "span-counts")
    # fewer than MOST_HEAVY hashes can be as frequent as this, so their table has a bound
    share = F.coalesce((repeats.agg(F.sum("times").alias("n")).scalar() / MOST_HEAVY).cast("bigint"), F.lit(0))
    lanes = F.ceil(F.col("times") / F.greatest(F.lit(HEAVY).cast("bigint"), share)).cast("int")
    wide = repeats.withColumn("lanes", lanes)
    heavy = wide.where("lanes > 1").select("a", "b", "lanes")
    lane = F.pmod(F.xxhash64("k", "x", "j", "n"), F.coalesce("lanes", F.lit(1))).cast("int")
    spread = spans.join(F.broadcast(heavy), ["a", "b"], "left").withColumn("lane", lane).drop("lanes")
    every = F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane")
    held = stored(spread.join(wide.select("a", "b", "low", "lanes", every), ["a", "b", "lane"]), "span-repeats")
    first = held.where("k = low").groupBy("a", "b").agg(F.min(F.struct("x", "j")).alias("first"), F.max("lanes").alias("lanes"))
    later = held.drop("lanes").join(first.select("a", "b", "first", every), ["a", "b", "lane"])
    later = later.where("NOT (k = low AND x = first.x AND j = first.j)")
    return stored(later.groupBy("k", "x").agg(F.collect_set(F.struct("j", "n")).alias("runs")), "span-covered")


def deduplicated(docs: DataFrame, span: int = SPAN, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_sentences, n_removed and the remaining text of every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("bigint"), "text").select("doc_id", "text", *document_key())
    out = rows.join(covered(docs, span, least), ["k", "x"], "left")
    parts = pieces(F.col("text"))

    def cut(p: Column) -> Column:
        real = F.filter(F.transform(p, lambda s, i: F.when(F.btrim(s, F.lit(BLANK)) != "", i)), lambda i: i.isNotNull())
        return let(real, lambda r: without(p, r))

    def without(p: Column, real: Column) -> Column:
        under = F.array_distinct(F.flatten(F.transform("runs", lambda s: F.sequence(s["j"], s["j"] + s["n"] - 1))))
        gone = F.transform(under, lambda s: F.get(real, s))
        keep = F.array_except(F.sequence(F.lit(0), F.size(p) - 1), gone)
        return F.struct(F.size(real).alias("n"), F.size(under).alias("gone"), F.array_join(F.transform(keep, lambda i: F.get(p, i)), "").alias("text"))

    whole = let(parts, lambda p: F.struct(F.size(F.filter(p, lambda s: F.btrim(s, F.lit(BLANK)) != "")).alias("n"), F.lit(0).alias("gone"), F.lit(None).cast("string").alias("text")))
    done = out.withColumn("r", F.when(F.col("runs").isNull(), whole).otherwise(let(parts, cut)))
    return done.select(
        "doc_id", F.col("r.n").cast("bigint").alias("n_sentences"), F.col("r.gone").cast("bigint").alias("n_removed"), F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.col("r.text")).alias("text")
    )
