"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def _stars(edges: DataFrame, name: str) -> DataFrame:
    """One large-star and one small-star step over edges (a > b), each pair once."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    down = stored(large, f"{name}-large")
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return stored(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), f"{name}-small")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (a, b).

    Nodes without an edge to another are left out. Each step writes its edges to the shared
    folder; a node's edges are combined by minimum, never gathered. Ends when no edge changed.
    """
    now = stored(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges"
    )
    sign = lambda e: e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    seen = sign(now)
    while seen.n:
        after = _stars(now, name)
        got = sign(after)
        now = after
        if got == seen:
            break
        seen = got
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
