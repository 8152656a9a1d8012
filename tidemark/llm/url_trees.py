"""URL filters: gradient-boosted trees on lexical features, beside host and path rules.

The labelled URLs are those that a rule decides. The trees learn from them what blocked URLs
look like and judge the URLs that no rule fits. Features come from the URL alone (length,
depth, digit share, entropy, parameters, punctuation) and from statistics of its suffix (the
last label of the host): how common it is and which share of its labelled URLs is blocked.
Training takes at most ``SAMPLE`` distinct labelled URLs, the ones with the smallest hashes;
suffix statistics cover all URLs.

Defined results: a null URL and one without "://" have an empty host and path, fit no rule
and are judged by the trees like any other. Where all labelled URLs have one label, that is
the verdict of the rest; where none is labelled, "allow". One row per row of ``pages``.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import let, stored, total

SAMPLE = 20_000
TREES, DEPTH = 20, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: Fixed values.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)


def match(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct<rule, verdict> of the longest rule that fits; null where none does."""
    longest = sorted(rules, key=lambda r: (-len(r.host + r.path), r.host, r.path))
    found = [F.when(fits(r, host, path), F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in longest]
    return F.coalesce(*found, F.lit(None).cast("struct<rule:string,verdict:string>"))


def entropy(text: Column) -> Column:
    """Bits per character, from the runs of the sorted characters."""

    def of_sorted(c: Column) -> Column:
        ends = F.filter(F.transform(c, lambda x, i: F.when(F.coalesce(x != F.get(c, i + 1), F.lit(True)), i + 1)), lambda x: x.isNotNull())
        runs = let(ends, lambda e: F.transform(e, lambda x, i: (x - F.coalesce(F.get(e, i - 1), F.lit(0))).cast("double")))
        part = F.aggregate(runs, F.lit(0.0), lambda a, n: a + n * F.log2(n))
        n = F.size(c)
        return F.when(n > 0, F.log2(n.cast("double")) - part / n).otherwise(0.0)

    return let(F.sort_array(F.filter(F.split(text, ""), lambda x: x != "")), of_sorted)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


FEATURES = ["length", "host_length", "path_length", "depth", "labels", "digits", "hyphens", "parameters", "fragment", "entropy", "secure", "suffix_length", "suffix_common", "suffix_blocked"]


def lexical(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """page_id, url, host, path, rule, rule_verdict, suffix and the URL's own features."""
    url = F.coalesce("url", F.lit(""))
    parts = pages.select("page_id", url.alias("url"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    host, path, url = F.col("host"), F.col("path"), F.col("url")
    tail = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    size = F.greatest(F.length(url), F.lit(1))
    out = parts.withColumns({"m": match(host, path, rules), "suffix": F.substring_index(host, ".", -1)})
    return out.select(
        "page_id",
        "url",
        "host",
        "path",
        "m.rule",
        F.col("m.verdict").alias("rule_verdict"),
        "suffix",
        F.length(url).cast("double").alias("length"),
        F.length(host).cast("double").alias("host_length"),
        F.length(path).cast("double").alias("path_length"),
        _count(path, "/").alias("depth"),
        _count(host, r"\.").alias("labels"),
        (_count(url, "[0-9]") / size).alias("digits"),
        (_count(url, "[-_~]") / size).alias("hyphens"),
        F.when(tail == "", 0.0).otherwise(_count(tail, "&") + 1).alias("parameters"),
        F.contains(url, F.lit("#")).cast("double").alias("fragment"),
        entropy(url).alias("entropy"),
        url.startswith("https").cast("double").alias("secure"),
        F.length("suffix").cast("double").alias("suffix_length"),
    )


def suffixes(rows: DataFrame) -> DataFrame:
    """Per suffix: how common it is, and the smoothed share of blocked ones among the labelled."""
    blocked = (F.col("rule_verdict") == "block").cast("double")
    return rows.groupBy("suffix").agg(
        F.log1p(F.count("*")).alias("suffix_common"),
        ((F.coalesce(F.sum(blocked), F.lit(0.0)) + 1) / (F.count("rule_verdict") + 2)).alias("suffix_blocked"),
    )


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """page_id, url, host, path, rule, verdict, score (of being blocked; null beside a constant)."""
    own = stored(lexical(pages, rules), "url-lexical")
    rows = own.join(stored(suffixes(own), "url-suffixes"), "suffix")
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    labelled = assembled.where("rule_verdict IS NOT NULL").select("url", "features", (F.col("rule_verdict") == "block").cast("double").alias("label"))
    chosen = labelled.groupBy("url").agg(F.first("features").alias("features"), F.max("label").alias("label")).orderBy(F.xxhash64("url"), "url").limit(sample)
    train = stored(chosen.select("features", "label"), "url-train")
    seen = sorted(r.label for r in train.select("label").distinct().collect())
    if len(seen) < 2:
        constant = "block" if seen == [1.0] else "allow"
        scored = rows.withColumns({"score": F.lit(None).cast("double"), "model_verdict": F.lit(constant)})
    else:
        model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, seed=7).fit(train)
        share = F.element_at(vector_to_array("probability"), 2)
        scored = model.transform(assembled).withColumn("score", share).withColumn("model_verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "url", "host", "path", "rule", F.coalesce("rule_verdict", "model_verdict").alias("verdict"), "score")
