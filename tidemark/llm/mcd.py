"""Quality rules: robust multivariate outliers among statistics of texts.

``statistics`` counts words, characters, symbols, repeated lines and repeated word windows of
a whole text inside its row. ``judge`` transforms the counts to a vector and estimates, per
language and source, the centre and covariance of the bulk by the minimum covariance
determinant: concentration steps that keep the ``SUPPORT`` share of rows nearest to the last
estimate and estimate anew, until no pool's estimate changes by more than ``SETTLED`` of the
least spread (or ``STEPS`` were taken, which is logged). Rows whose squared Mahalanobis distance exceeds ``CUTOFF`` are
rejected. Built-in functions only; every estimate is an aggregate over all rows of its group,
combined before its shuffle, so a hot source costs a task one row per upstream task.

Pools: a (lang, source) of fewer than ``LEAST`` rows that pass the base rules is estimated
together with the other such groups of its language, or, where these are too few, with the
small groups of all languages; a pool that is still too small rejects nothing. Null is a
language and a source of its own.

A covariance of the bulk can be singular (most texts have no symbols at all). ``SPREAD`` is
the standard deviation that a transformed statistic has at least: it is added to the variance.

Defined results: a null or empty text has no words and fails the base rules. Ties at the edge
of the support are all inside it. Repeated rows each count and each get a verdict.
"""

from __future__ import annotations

import logging
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import let, stored, total, words_of

WINDOW = 5
SYMBOLS = "#*$%&|<>"
SUPPORT = 0.75
STEPS = 50
SETTLED = 1e-3
LEAST = 40
#: Least standard deviation of each transformed statistic (see ``vector``).
#: Around a bulk at zero, 30 symbols per 100 words or half of all lines repeated pass ``CUTOFF`` alone.
#: Repeated words do not: above 20 % the base rule rejects them, and labelled clean texts reach that.
SPREAD = (0.15, 0.5, 0.57, 0.7)
#: The squared distance that a normal vector of four exceeds once in about 10^9.
CUTOFF = 47.0


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside runs of ``window`` words that occur twice or more, the first included."""

    def of_hashes(h: Column) -> Column:
        runs = F.transform(
            F.slice(h, 1, F.greatest(F.size(h) - (window - 1), F.lit(0))),
            lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, window))),
        )
        return let(runs, of_runs)

    def of_runs(runs: Column) -> Column:
        return F.when(F.size(F.array_distinct(runs)) == F.size(runs), F.lit(0).cast("bigint")).otherwise(
            let(F.sort_array(F.transform(runs, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered)
        )

    def covered(pairs: Column) -> Column:
        same = lambda p, j: F.coalesce(p["h"] == F.get(pairs, j)["h"], F.lit(False))
        again = F.filter(pairs, lambda p, i: same(p, i - 1) | same(p, i + 1))
        starts = F.sort_array(F.transform(again, lambda p: p["i"]))
        reach = lambda s: F.transform(s, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(s, i + 1) - x, F.lit(window))))
        return total(let(starts, reach))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every text. One row per row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]")))
    counted = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            total(F.transform(w, lambda x: F.length(x))).alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    return docs.select(
        "doc_id",
        "lang",
        "source",
        counted.alias("c"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))).alias("l"),
    ).select("doc_id", "lang", "source", "c.n_words", "c.word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "c.n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def vector() -> list[Column]:
    """Mean word length, symbols, repeated lines and repeated words per hundred, in logarithms."""
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return [
        F.log(F.greatest("word_chars", F.lit(1)) / words),
        F.log1p(100 * F.col("n_symbols") / words),
        F.log1p(100 * F.col("n_dup_lines") / lines),
        F.log1p(100 * F.col("n_repeat_words") / words),
    ]


def _chi2_even(x: float, dof: int) -> float:
    """P(chi-squared of an even number of degrees <= x)."""
    half, term, sum_ = x / 2, 1.0, 0.0
    for i in range(dof // 2):
        sum_ += term
        term *= half / (i + 1)
    return 1 - math.exp(-half) * sum_


def consistency(support: float, dof: int) -> float:
    """What makes the covariance of the nearest ``support`` of normal rows that of all."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_even(mid, dof) < support else (low, mid)
    return support / _chi2_even(low, dof + 2)


def _distance(x: list[Column], mean: list[Column], cov: list[list[Column]]) -> tuple[dict[str, Column], ...]:
    """Steps of column definitions that end in ``d2``: a Cholesky factor, then substitution."""
    p = len(x)
    steps: list[dict[str, Column]] = []
    for i in range(p):
        for j in range(i + 1):
            rest = cov[i][j]
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            steps.append({f"l{i}{j}": F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}")})
    for i in range(p):
        rest = x[i] - mean[i]
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"y{k}")
        steps.append({f"y{i}": rest / F.col(f"l{i}{i}")})
    steps.append({"d2": sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, p)), F.col("y0") * F.col("y0"))})
    return tuple(steps)


def pools(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, source, pool): the pool that a group is estimated in; null where it is too small."""
    groups = stored(rows.groupBy("lang", "source").agg(F.count("*").alias("n")), "mcd-groups")
    small = groups.where(F.col("n") < least)
    langs = small.groupBy(F.col("lang").alias("lang_")).agg(F.sum("n").alias("n_lang"))
    left = groups.join(langs, F.col("lang").eqNullSafe(F.col("lang_")), "left")
    n_rest = langs.where(F.col("n_lang") < least).agg(F.sum("n_lang")).first()[0] or 0
    named = lambda *parts: F.to_json(F.struct(*parts))
    return left.select(
        "lang",
        "source",
        F.when(F.col("n") >= least, named(F.lit(0).alias("k"), "lang", "source"))
        .when(F.col("n_lang") >= least, named(F.lit(1).alias("k"), "lang"))
        .when(F.lit(n_rest >= least), named(F.lit(2).alias("k")))
        .alias("pool"),
    )


def estimates(rows: DataFrame, support: float = SUPPORT, steps: int = STEPS, spread: tuple = SPREAD) -> DataFrame:
    """Per ``pool``: m0.. and c00.., the minimum-covariance-determinant estimate of z0...

    ``rows`` has pool and z0.. . The start is deterministic: the rows nearest to the median in
    units of the spread around it. Each step aggregates all rows twice: the distance quantile
    of a pool, then means and products within it.
    """
    p = len(spread)
    factor = consistency(support, p)
    z = [F.col(f"z{i}") for i in range(p)]
    start = rows.groupBy("pool").agg(*(F.percentile_approx(z[i], F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{i}") for i in range(p)))
    start = start.select(
        "pool",
        *(F.col(f"q{i}")[1].alias(f"m{i}") for i in range(p)),
        *(
            (F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2) + spread[i] ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}")
            for i in range(p)
            for j in range(i + 1)
        ),
    )
    now = stored(start, "mcd-start")
    scale = {f"m{i}": spread[i] for i in range(p)} | {f"c{i}{j}": spread[i] * spread[j] for i in range(p) for j in range(i + 1)}
    for _ in range(steps):
        far = distances(rows, now, p)
        edge = far.groupBy("pool").agg(F.percentile_approx("d2", support).alias("edge"))
        near = far.join(edge, "pool").where("d2 <= edge")
        sums = near.groupBy("pool").agg(
            *(F.avg(z[i]).alias(f"m{i}") for i in range(p)),
            *((F.covar_pop(z[i], z[j])).alias(f"v{i}{j}") for i in range(p) for j in range(i + 1)),
        )
        last, now = now, stored(
            sums.select(
                "pool",
                *(f"m{i}" for i in range(p)),
                *((factor * F.col(f"v{i}{j}") + (spread[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i in range(p) for j in range(i + 1)),
            ),
            "mcd-step",
        )
        before = last.select(F.col("pool").alias("pool_"), *(F.col(k).alias(f"{k}_") for k in scale))
        moved = F.greatest(*(F.abs(F.col(k) - F.col(f"{k}_")) / s for k, s in scale.items()))
        if now.join(before, F.col("pool") == F.col("pool_")).where(moved > SETTLED).isEmpty():
            return now
    logging.getLogger(__name__).warning("estimates still move after %d steps", steps)
    return now


def distances(rows: DataFrame, estimate: DataFrame, p: int) -> DataFrame:
    """``rows`` with ``d2``, the squared Mahalanobis distance; null without an estimate."""
    out = rows.join(estimate, "pool", "left")
    mean = [F.col(f"m{i}") for i in range(p)]
    cov = [[F.col(f"c{i}{j}") for j in range(i + 1)] for i in range(p)]
    for step in _distance([F.col(f"z{i}") for i in range(p)], mean, cov):
        out = out.withColumns(step)
    return out.select(*rows.columns, "d2")


def judge(docs: DataFrame, cutoff: float = CUTOFF, support: float = SUPPORT, steps: int = STEPS, least: int = LEAST, spread: tuple = SPREAD) -> DataFrame:
    """Statistics, ``base_failed``, ``d2`` and ``kept`` of every text.

    The estimates rest on the rows that pass the base rules; those are the rows they judge.
    """
    rows = stored(statistics(docs), "mcd-statistics").withColumn("base_failed", base_failed())
    passing = rows.where(~F.col("base_failed"))
    groups = pools(passing, least).withColumnsRenamed({"lang": "lang_", "source": "source_"})
    match = F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_"))
    counts = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    pooled = stored(
        rows.join(groups, match, "left").select(*counts, "pool", *(v.alias(f"z{i}") for i, v in enumerate(vector()))),
        "mcd-rows",
    )
    inside = pooled.where(~F.col("base_failed") & F.col("pool").isNotNull())
    estimate = estimates(inside, support, steps, spread)
    far = distances(pooled, estimate, len(spread))
    return far.select(*counts, "d2", (~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True))).alias("kept"))
