"""Line dedup by an exact set-similarity join.

A line is the set of its words. A line is removed if an earlier line, in the
order of (doc_id, line number), has a Jaccard likeness of at least ``percent`` / 100 with it.

1. Rarity: words are counted over all texts in ``BUCKETS`` hashed counters, a fixed size. The
   words of a line are ordered by the count of their bucket, then by hash.
2. Equal sets are one class; its first line stands for it and the others are removed. Classes
   are numbered in the order of their first lines.
3. Prefix filter: two sets that are alike share one of their first
   n - ceil(t n) + 1 words. Only those are posted. Sets too small to be alike without being
   equal are not posted.
4. Length and position filters leave pairs that can still reach the overlap asked for. So does
   a parity map of 128 bits: each word of a set flips one bit, so two maps differ in
   no more bits than there are words in only one of the two sets.
5. First pass, over the posted words that occur ``OFTEN``: each class is compared with one leader
   only, the first class under the word. A large group of near copies is settled by this, in time
   linear in its size. Groups under other words are smaller than ``OFTEN``.
6. Second pass: the classes that are not settled are compared with all earlier ones under all
   their words, both sides read from one shuffle. No posting is cut.
7. Candidates are verified on the whole sets of their lines.

Words are compared by 64-bit hashes when verified, by 32 bits when posted. Built-in functions
only.

Defined results: null and empty texts have no lines to remove and stay as they are. Lines
without a word are never removed. Rows without doc_id come last. Rows that repeat a doc_id
and text are one document and keep the same lines. Of equal lines the earliest stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import document_key, let, stored

PERCENT, BUCKETS = 80, 1 << 20

#: Levels are logarithms in thirds; below this one a word occurs less than 128 times, so no more classes share it.
OFTEN = 7 * 3

#: ASCII white space besides line ends and blanks.
_RARE_SPACES = "\t\x0b\x0c\r"


def _spaced() -> Column:
    """``text`` with blanks for white space other than line ends, so that it is split without a pattern."""
    text = F.col("text")
    found = F.lit(False)
    for c in _RARE_SPACES:
        found = found | F.contains(text, F.lit(c))
    return F.when(found, F.translate(text, _RARE_SPACES, " " * len(_RARE_SPACES))).otherwise(text)


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, " "), "")


def rarity(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row, ``levels`` array<tinyint>: the logarithm of each bucket's count.

    The table has a fixed size, whatever the vocabulary: words share buckets. Any order of
    words gives exact results; the better it tells rare words, the fewer pairs are compared.
    """
    words = docs.where("text IS NOT NULL").select(F.explode(F.split(F.replace(_spaced(), F.lit("\n"), F.lit(" ")), " ")).alias("w")).where("w != ''")
    found = words.select(F.xxhash64("w").bitwiseAND(buckets - 1).cast("int").alias("b"))
    # Each bucket once more, so that none is missing and no logarithm is of zero.
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"))
    dense = found.union(every).groupBy("b").agg(F.floor(F.log2(F.count("*")) * 3).cast("tinyint").alias("v"))
    rows = dense.agg(F.sort_array(F.collect_list(F.struct("b", "v"))).alias("e"))
    return stored(rows.select(F.transform("e", lambda e: e["v"]).alias("levels")), "line-levels")


def described(docs: DataFrame, levels: DataFrame, percent: int = PERCENT, buckets: int = BUCKETS) -> DataFrame:
    """(k, x, line_no, id, id2, n, s1, s2, prefix, often): every line with a word; (id, id2) names its set.

    From place ``often`` on, the words of the prefix are of level ``OFTEN`` or above.
    """
    k, x = document_key()
    rows = docs.where("text IS NOT NULL").select(k, x, F.posexplode(F.split(_spaced(), "\n")).alias("line_no", "line")).where(F.trim("line") != "")
    least = -(-percent // max(1, 100 - percent)) if percent < 100 else 1 << 30

    def ranked(h: Column) -> Column:
        # Never null, which the sort of plain numbers needs to know.
        level = F.coalesce(F.get(F.col("levels"), h.bitwiseAND(buckets - 1).cast("int")).cast("bigint"), F.lit(0).cast("bigint"))
        return F.shiftleft(level, 56).bitwiseOR(F.shiftrightunsigned(h, 8))

    # Repeated words are dropped before the others are ranked, which costs more.
    hashes = F.array_distinct(F.transform(_words(F.col("line")), lambda w: F.xxhash64(w)))
    order = F.sort_array(F.transform(hashes, ranked))
    sets = rows.withColumn("levels", levels.scalar()).select("k", "x", "line_no", order.alias("o"))
    n = F.size("o")
    width = F.when(n >= least, n - _ceil(n * percent, 100) + 1).otherwise(0)
    first = F.slice("o", F.lit(1), width)
    prefix = F.transform(first, lambda v: F.shiftright(F.shiftleft(v, 8), 32).cast("int"))
    often = F.size(F.filter(first, lambda v: v < OFTEN << 56))
    return sets.select("k", "x", "line_no", F.xxhash64("o").alias("id"), F.hash("o").alias("id2"), n.alias("n"), _parity("o", 0).alias("s1"), _parity("o", 64).alias("s2"), prefix.alias("prefix"), often.alias("often"))


def _parity(words: str, half: int) -> Column:
    """64 bits, of which each word that belongs to this half flips one."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    return F.aggregate(F.filter(words, lambda v: v.bitwiseAND(64) == half), none, lambda a, v: a.bitwiseXOR(F.call_function("shiftleft", one, v.bitwiseAND(63).cast("int"))))


def classes(lines: DataFrame) -> DataFrame:
    """(r, k, x, line_no, n, s1, s2, prefix, often): the first line of each distinct set, numbered in their order."""
    order = ["k", "x", "line_no"]
    own = F.struct(*order, "n", "s1", "s2", "prefix", "often")
    heads = lines.select("id", "id2", own.alias("own")).groupBy("id", "id2").agg(F.min("own").alias("own")).select("own.*")
    # Numbers ascend with the order, as partitions do; stored, so that they never change.
    return stored(heads.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("r", F.monotonically_increasing_id()), "line-classes")


def _ceil(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / b).cast("int")


def posted(heads: DataFrame, *more: str) -> DataFrame:
    """(token, place, r, n, s1, s2): the prefix words of classes."""
    return heads.select("r", "n", "s1", "s2", *more, F.posexplode("prefix").alias("place", "token"))


def possible(percent: int) -> Column:
    """Whether a pair that shares a word may be alike: (n, place, s1, s2) and (m, at, t1, t2)."""
    n, m, p, q, s1, s2, t1, t2 = (F.col(c) for c in ("n", "m", "place", "at", "s1", "s2", "t1", "t2"))
    length = (F.least(n, m) * 100) >= (F.greatest(n, m) * percent)

    def enough(common: Column) -> Column:
        # Alike sets of n and m words have t (n + m) / (1 + t) in common.
        return common * (100 + percent) >= (n + m) * percent

    position = enough(F.least(p, q) + F.least(n - p, m - q))
    apart = enough(F.shiftright(n + m - F.bit_count(s1.bitwiseXOR(t1)) - F.bit_count(s2.bitwiseXOR(t2)), 1))
    return length & position & apart


def verified(pairs: DataFrame, heads: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(r, other): the pairs whose whole sets are alike."""
    pairs = stored(pairs.distinct(), "line-candidates")
    both = pairs.select("r").union(pairs.select("other")).distinct()
    wanted = heads.select("r", "k", "x", "line_no").join(both, "r")
    per_doc = wanted.groupBy("k", "x").agg(F.collect_list(F.struct("line_no", "r")).alias("lines"))
    texts = docs.where("text IS NOT NULL").select(*document_key(), _spaced().alias("text")).join(per_doc.hint("merge"), ["k", "x"])
    fetched = texts.select(F.split("text", "\n").alias("all"), F.explode("lines").alias("l")).select("l.r", F.get("all", F.col("l.line_no")).alias("line"))
    words = F.array_distinct(F.transform(_words(F.col("line")), lambda w: F.xxhash64(w)))
    sets = stored(fetched.select("r", words.alias("words")).dropDuplicates(["r"]), "line-sets")
    a, b = sets.withColumnRenamed("words", "words_a"), sets.select(F.col("r").alias("other"), F.col("words").alias("words_b"))
    same = F.size(F.array_intersect("words_a", "words_b"))
    alike = pairs.join(a, "r").join(b, "other").where(same * 100 >= (F.size("words_a") + F.size("words_b") - same) * percent)
    return stored(alike.select("r", "other"), "line-alike")


#: The names of a posting's columns on the other side of a join.
_OTHER = {"r": "other", "n": "m", "place": "at", "s1": "t1", "s2": "t2"}


def repeated(heads: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(r): the classes whose first line is like an earlier line."""
    pair = (F.col("r") > F.col("other")) & possible(percent)
    postings = posted(heads, "often").where("place >= often").drop("often")
    tops = postings.groupBy("token").agg(F.min("r").alias("leader"), F.count("*").alias("c")).where("c > 1").select("token", "leader")
    # Leaders have one row a word, so they are hashed and the postings need no sort.
    led = postings.join(tops.hint("shuffle_hash"), "token").where("r = leader").drop("leader").withColumnsRenamed(_OTHER)
    near = verified(postings.join(led.hint("shuffle_hash"), "token").where(pair).select("r", "other"), heads, docs, percent)
    settled = stored(near.select("r").distinct(), "line-settled")
    return settled.union(verified(open_pairs(heads, settled, percent), heads, docs, percent).select("r").distinct())


def open_pairs(heads: DataFrame, settled: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(r, other): classes that are not ``settled`` and earlier ones, settled or not, that may be alike.

    The mark is part of the number (2 r + 1 where open) and tested together with the other
    side's, so that both sides of the join are the same and read one shuffle.
    """
    marked = heads.join(settled.withColumn("done", F.lit(1)), "r", "left").withColumn("r", F.col("r") * 2 + 1 - F.coalesce("done", F.lit(0)))
    shared = posted(marked).repartition("token")
    later = F.shiftright("r", 1) * F.col("r").bitwiseAND(1) > F.shiftright("other", 1)
    both = shared.join(shared.withColumnsRenamed(_OTHER), "token").where(later & possible(percent))
    return both.select(F.shiftright("r", 1).alias("r"), F.shiftright("other", 1).alias("other"))


def removed(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(k, x, stay): for each document, the lines with words that stay."""
    heads = classes(described(docs, rarity(docs), percent))
    gone = repeated(heads, docs, percent)
    stay = heads.select("r", "k", "x", "line_no").join(gone, "r", "left_anti")
    return stored(stay.groupBy("k", "x").agg(F.collect_list("line_no").alias("stay")), "line-stay")


def cleaned(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs``, all columns, with text reduced to the lines that stay, and the counts
    ``n_lines`` and ``n_removed`` (with underscores where a column has the name)."""
    names = []
    for name in ("n_lines", "n_removed"):
        while name in docs.columns:
            name += "_"
        names.append(name)
    k, x = document_key()
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"), "text", k, x)
    # Every document is on both sides, so the plan is the same whatever the size.
    joined = keyed.join(removed(docs, percent).hint("merge"), ["k", "x"], "left")

    def cut(p: Column) -> Column:
        blank = F.filter(F.transform(p, lambda s, i: F.when(~F.regexp_like(s, F.lit(r"[^\x20\x09-\x0D]")), i)), lambda i: i.isNotNull())
        keep = F.sort_array(F.array_distinct(F.concat(F.coalesce("stay", F.array().cast("array<int>")), blank)))
        return let(keep, lambda i: F.struct(F.size(p).alias("n"), (F.size(p) - F.size(i)).alias("gone"), F.array_join(F.transform(i, lambda j: F.get(p, j)), "\n").alias("text")))

    done = joined.withColumn("r", let(F.split("text", "\n"), cut))
    columns = [F.col(f"row.`{c}`") if c != "text" else F.col("r.text").alias("text") for c in docs.columns]
    return done.select(*columns, F.coalesce("r.n", F.lit(0)).cast("bigint").alias(names[0]), F.coalesce("r.gone", F.lit(0)).cast("bigint").alias(names[1]))
