"""Document fingerprints from closed syncmers.

A text is cut into tokens: words between white space, and after every ideograph or kana, which
stand without spaces. Every ``k`` consecutive tokens are a k-mer, every ``s`` an s-mer with a
hash. A k-mer is a closed syncmer if the smallest of its s-mers is its first or its last. That
depends on the k-mer alone, not on what stands around it, so a passage has the same anchors in
every text and at every offset.

The fingerprint is the sketch of a text's anchors: the ``size`` smallest distinct 32-bit
anchor hashes. Likeness is the Jaccard estimate of two sketches. Everything is built-in
functions; a text is read once and never leaves its row.

Defined results: null is the empty text; an empty text has no anchors and the fingerprint "".
A text without a closed syncmer (few tokens) has one anchor, the hash of all its tokens.
Two empty fingerprints are alike (1), an empty and another are not (0). Equal texts have
equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import let, stored

K, S, SIZE = 5, 2, 64
ALONE = r"぀-ヿ㐀-鿿豈-﫿"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), rf"\s+|(?<=[{ALONE}])"), lambda w: w != "")


def _per_kmer(text: Column, k: int, s: int, made) -> Column:
    """An array with ``made(hash, position)`` for closed syncmers and null for other k-mers."""
    inner = k - s + 1

    def of_smers(smers: Column) -> Column:
        def of_one(first: Column, i: Column) -> Column:
            got = [first, *(F.get(smers, i + j) for j in range(1, inner))]
            between = got[1:-1]
            closed = F.least(got[0], got[-1]) <= F.least(*between) if len(between) > 1 else F.least(got[0], got[-1]) <= between[0] if between else F.lit(True)
            # Every s-th s-mer and the last cover the k tokens.
            covering = [got[j] for j in dict.fromkeys([*range(0, inner, s), inner - 1])]
            return F.when(got[-1].isNotNull() & closed, made(F.xxhash64(*covering), i))

        return F.transform(smers, of_one)

    def of_hashes(hashes: Column) -> Column:
        smers = F.transform(
            F.slice(hashes, 1, F.greatest(F.size(hashes) - (s - 1), F.lit(0))),
            lambda x, i: F.xxhash64(x, *(F.get(hashes, i + j) for j in range(1, s))),
        )
        found = F.filter(let(smers, of_smers), lambda x: x.isNotNull())
        whole = F.when(F.size(hashes) > 0, F.array(made(F.xxhash64(hashes), F.lit(0)))).otherwise(F.slice(F.array(made(F.lit(0).cast("bigint"), F.lit(0))), 1, 0))
        return let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(whole))

    return let(F.transform(tokens(text), lambda w: F.xxhash64(w)), of_hashes)


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """array<struct<position, hash>>: the closed syncmers with the token at which each begins."""
    if not 0 < s < k:
        raise ValueError("0 < s < k is needed")
    return _per_kmer(text, k, s, lambda h, i: F.struct(i.cast("int").alias("position"), h.alias("hash")))


def sketch(text: Column, k: int = K, s: int = S, size: int = SIZE) -> Column:
    """array<int>: the ``size`` smallest distinct anchor hashes, ascending."""
    if not 0 < s < k:
        raise ValueError("0 < s < k is needed")
    hashes = _per_kmer(text, k, s, lambda h, i: F.shiftright(h, 32).cast("int"))
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, size)


def fingerprint(values: Column) -> Column:
    """A sketch as text: eight hexadecimal digits per hash."""
    return F.array_join(F.transform(values, lambda v: F.lower(F.lpad(F.hex(v.cast("bigint").bitwiseAND(0xFFFFFFFF)), 8, "0"))), "")


def likeness(a: Column, b: Column, size: int = SIZE) -> Column:
    """Jaccard estimate (0 to 1): of the smallest hashes of both together, the share in both."""
    both = let(
        F.slice(F.sort_array(F.array_union(a, b)), 1, size),
        lambda u: F.when(F.size(u) == 0, 1.0).otherwise(
            F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)
        ),
    )
    return both.cast("double")


def matched_offsets(a: Column, b: Column) -> Column:
    """array<struct<a, b>>: token positions in two anchor arrays at which one hash stands.

    The first position of a hash in ``b`` is taken, so the array is no longer than ``a``.
    """
    places = F.map_from_entries(
        F.array_distinct(F.transform(b, lambda x: F.struct(x["hash"], F.array_min(F.transform(F.filter(b, lambda y: y["hash"] == x["hash"]), lambda y: y["position"])))))
    )
    return F.filter(
        F.transform(a, lambda x: F.struct(x["position"].alias("a"), F.try_element_at(places, x["hash"]).alias("b"))),
        lambda m: m["b"].isNotNull(),
    )


def following(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id, n_chars): the next smaller doc_id of each; the largest after the smallest.

    Ids only are sorted: by range over partitions, then within each; the first id of a
    partition follows the last of the one before. One small row per partition meets in one
    task. Rows without doc_id are in no chain. A repeated id is one link; ``n_chars`` is then
    its longest text's, ``n_rows`` the number of rows.
    """
    ids = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.length(F.coalesce("text", F.lit("")))).alias("n_chars"), F.count("*").alias("n_rows"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(ids.repartitionByRange(parts, F.desc("doc_id")).withColumn("part", F.spark_partition_id()), "syncmer-ids")
    inside = dealt.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("part").orderBy(F.desc("doc_id"))))
    heads = dealt.groupBy("part").agg(F.max("doc_id").alias("head"))
    every = Window.orderBy("part")
    edges = heads.select(
        "part",
        F.coalesce(
            F.lead("head").over(every),
            F.first("head").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        ).alias("after"),
    )
    return inside.join(F.broadcast(edges), "part").select("doc_id", F.coalesce("next_id", "after").alias("next_id"), "n_chars", "n_rows")


def edited(docs: DataFrame, k: int = K, s: int = S, size: int = SIZE) -> DataFrame:
    """Fingerprints of every text, of its edited form and of the next document.

    ``docs`` has doc_id and text; other columns are left out. The last third of a text is
    replaced by as much of the next document's beginning. One row per row of ``docs``.

    Of several rows with the next id, the one of the smallest text hash is taken. A row
    without doc_id is followed by itself, as is the only document of a table.
    """
    # A cast that changes nothing would leave a name on one side of a join only, and the two
    # shuffles of the texts would no longer be one.
    number = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("bigint")
    base = docs.select(number, F.coalesce("text", F.lit("")).alias("text"))
    links = stored(following(base), "syncmer-links")
    third = F.floor(F.col("n_chars") / 3).cast("int")
    # Both joins read one shuffle of the texts; sketches are made behind it.
    named = base.where("doc_id IS NOT NULL")
    heads = (
        links.select(F.col("doc_id").alias("before"), F.col("next_id").alias("doc_id"), third.alias("third"))
        .join(links.select("doc_id", "n_rows"), "doc_id")
        .join(named, "doc_id")
        .select(
            F.col("before").alias("doc_id"),
            "n_rows",
            F.struct(F.xxhash64("text").alias("h"), F.expr("substring(text, 1, third)").alias("head"), sketch(F.col("text"), k, s, size).alias("next_sketch")).alias("next"),
        )
    )
    single = heads.where("n_rows = 1").select("doc_id", "next")
    several = heads.where("n_rows > 1").groupBy("doc_id").agg(F.min("next").alias("next"))
    joined = named.join(single.unionByName(several), "doc_id", "left")
    alone = base.where("doc_id IS NULL").withColumn("next", F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("head"), sketch(F.col("text"), k, s, size).alias("next_sketch")))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    rows = joined.unionByName(alone).select(
        "doc_id",
        n.cast("bigint").alias("n_chars"),
        sketch(F.col("text"), k, s, size).alias("own"),
        F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.coalesce("next.head", F.lit("")), F.lit(1), cut)).alias("edited"),
        "next.next_sketch",
    )
    rows = rows.select("doc_id", "n_chars", "own", "next_sketch", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("edited"), k, s, size).alias("changed"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed"), size).alias("near_edited"),
        likeness(F.col("own"), F.coalesce("next_sketch", "own"), size).alias("near_next"),
    )
