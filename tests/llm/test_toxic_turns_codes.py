"""Toxic segments, conversation search and pivot codes against brute force, and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import pivot_codes, toxic_segments, turn_search


def best_runs(scores):
    """Maximal scoring segments by their definition: the best run, then the same on either side."""
    def under(a, b):
        runs = [(sum(scores[i:j]), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)]
        best = max(runs, default=(0,))
        if best[0] <= 0:
            return []
        return [*under(a, best[2]), (best[2], best[3], best[0]), *under(best[3], b)]

    return under(0, len(scores))


def test_segments_are_the_maximal_ones():
    pick = random.Random(4)
    for _ in range(300):
        scores = [pick.choice([-7, -5, -3, -2, 2, 3, 5, 11]) + pick.randrange(1, 1000) / 4096 for _ in range(pick.randint(0, 14))]
        got = toxic_segments.segments(np.array(scores))
        want = best_runs(scores)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want])


def test_scale_and_evidence():
    values, counts = np.array([-1.0, 1.0]), np.array([3.0, 1.0])
    assert abs(toxic_segments.solve_scale(values, counts) - math.log(3)) < 1e-9
    assert toxic_segments.solve_scale(values, counts[::-1]) == 1.0
    model = toxic_segments.Model(None, 1.0, 0.0, 0.0, 1.0)
    one = model.evidence(np.array([20.0]), 10)
    assert abs(one - (20 - math.log(10) - math.log(2))) < 1e-9
    assert model.evidence(np.array([20.0, 19.0]), 10) > one > model.evidence(np.array([1.0]), 10) == 0.0


def test_buckets_do_not_depend_on_blocks(spark, monkeypatch):
    import pyarrow as pa

    texts = ["Ünïted, ÉTÉ words;here 12", None, "", "a " * 500 + "longerword " * 300, "x"]
    want = [b.copy() for b in toxic_segments.word_buckets(pa.array(texts))]
    monkeypatch.setattr(toxic_segments, "BLOCK", 64)
    got = list(toxic_segments.word_buckets(pa.array(texts)))
    assert len(got) == len(texts) and all((a == b).all() for a, b in zip(got, want, strict=True))
    assert (next(toxic_segments.word_buckets(pa.array(["été"]))) == next(toxic_segments.word_buckets(pa.array(["ÉTÉ"])))).all()
    assert [b.shape[1] for b in want] == [5, 0, 0, 800, 1]


def test_toxic_model(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxic_segments.train(docs, labels)
    held = toxic_segments.scored(docs, model).join(labels, "doc_id").where(toxic_segments.held_out())
    rates = held.groupBy("toxic").agg(F.avg((F.col("score") >= 0.5).cast("int")).alias("p")).collect()
    rates = {r.toxic: r.p for r in rates}
    assert rates[1] > 0.8 and rates[0] < 0.03


def test_toxic_on_awkward_rows(spark):
    columns = "doc_id long, text string, score double, passages int"
    docs = [(i, ("good day to you " * 20) + ("idiot moron scum " * 3 if i % 4 == 0 else ""), 0.5, 1) for i in range(80)]
    docs += [(100, None, 0.1, 2), (101, "", 0.1, 2), (None, "idiot moron scum", 0.1, 2), (3, "good day", 0.1, 2), (102, "calm words " * 30000 + "idiot moron scum idiot", 0.1, 2)]
    df = spark.createDataFrame(docs, columns).repartition(4)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)] + [(None, 1), (5, None), (4, 0)], "doc_id long, toxic int")
    model = toxic_segments.train(df, labels, F.lit(True))
    got = toxic_segments.scored(df, model)
    assert got.columns == ["doc_id", "text", "score", "passages", "score_", "passages_"]
    rows = got.collect()
    assert len(rows) == len(docs)
    by = {r.doc_id: r for r in rows if r.doc_id not in (3,)}
    assert by[4].score_ > 0.5 > by[5].score_
    least = min(r.score_ for r in rows)
    assert by[100].score_ == by[101].score_ == least and by[100].passages_ == []
    assert by[102].passages_ and by[102].passages_[0].first_word >= 59990
    assert toxic_segments.scored(df.limit(0), model).count() == 0
    for few, want in ((labels.limit(0), 0), (labels.where("toxic = 1"), 1), (labels.where("toxic = 0"), 0)):
        constant = toxic_segments.scored(df, toxic_segments.train(df, few, F.lit(True)))
        assert {round(r.score_) for r in constant.collect()} == {want}


def cheapest(initials, found):
    """(cost, audit) by a table over all rows and states."""
    def inserted(now):
        for _ in range(3):
            for state, (cost, audit) in list(now.items()):
                to, new = turn_search.NEW[state][0], (cost + 2, audit + "I")
                now[to] = min(now.get(to, new), new)
        return now

    now = {0: (0, "")}
    for initial, fault in zip(initials, found, strict=True):
        after = {}
        for state, (cost, audit) in inserted(now).items():
            ways = [(state, cost + 3, "D")]
            if fault not in ("blank", "duplicate"):
                late = int(fault == "truncated")
                to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((initial, state))
                ways += [(to, cost + late, "K")] if to else []
                ways.append((3 if state == 2 else 2, cost + 2 + late, "R"))
            for to, price, letter in ways:
                after[to] = min(after.get(to, (price, audit + letter)), (price, audit + letter))
        now = after
    return min(v for state, v in inserted(now).items() if state in (0, 3))


def test_search_is_optimal_and_small():
    pick = random.Random(3)
    for _ in range(1500):
        n = pick.randint(0, 14)
        initials = [pick.choice("suuaax ") if pick.random() < 0.9 else "" for _ in range(n)]
        found = [pick.choice(["", "", "", "truncated", "blank", "duplicate"]) for _ in range(n)]
        assert turn_search.search(initials, found, 0, turn_search.CLOSE) == cheapest(initials, found)
    for letters in ("ua", "suax", "u", "xs", "suuua"):
        opened: list[int] = []
        initials = [pick.choice(letters) for _ in range(128)]
        turn_search.search(initials, [pick.choice(["", "truncated"]) for _ in range(128)], 0, turn_search.CLOSE, opened)
        assert opened[0] < 1000


def conversations_by_hand(rows):
    held = {}
    for conv, turn, role, text in rows:
        own = held.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, own in held.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, found = set(), []
        for _, role, text in own:
            letters = re.sub(r"[\x20\x09-\x0D]", "", text)
            found.append("blank" if not letters else "duplicate" if (role, text) in seen else "" if letters[-1] in ".!?" else "truncated")
            seen.add((role, text))
        initials, turns = [r[1][:1] for r in own], [r[0] for r in own if r[0] is not None]
        cost, audit = cheapest(initials, found)
        lines, last, place = [], "", 0
        for letter in audit:
            if letter == "I":
                role, text = ("assistant" if last == "u" else "user"), ""
            else:
                _, role, text = own[place]
                place += 1
                role = ("assistant" if last == "u" else "user") if letter == "R" else role
            if letter != "D":
                lines.append(f"{role}:{text}")
                last = role[0]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((conv, gaps, *(found.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("most", [3, turn_search.ROWS])
def test_conversations(spark, most):
    pick = random.Random(8)
    say = ["a.", "b", "c!", " ", None, "d. \n", "", "e", "f? " * 40, "é\x0b"]
    rows = [(pick.choice([1, 1, 1, 2, None, 7]), pick.choice([None, *range(60)]), pick.choice(["user", "assistant", "system", None, "", "tool"]), pick.choice(say)) for _ in range(900)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t}.") for c in range(100, 140) for t in range(6)]
    rows += [(300, 2**62, "user", "x."), (300, -(2**62), "user", "y."), (301, 5, "user", "long " * 200_000)]
    # a conversation of which every row is dropped
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "z."))
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, k int").repartition(6)
    got = sorted(map(tuple, turn_search.mended(df, most).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert got == conversations_by_hand(rows)
    assert (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got


def test_no_conversations(spark):
    assert turn_search.mended(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_whole_conversations_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")
    got = sorted(map(tuple, turn_search.mended(df).collect()), key=lambda r: r[0])
    assert got == conversations_by_hand([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def codes_by_hand(rows):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    width = -(-max(len(r[1]) for r in kept) // 16)
    parts = np.zeros((len(kept), 16 * width), np.int64)
    for row, r in zip(parts, kept, strict=True):
        row[: len(r[1])] = [min(max(math.floor(256 * x), -(1 << 26)), 1 << 26) for x in r[1]]
    parts = parts.reshape(len(kept), 16, width)
    first = {}
    for i, r in enumerate(kept):
        if r[0] is not None and (r[0] not in first or r[1] < kept[first[r[0]]][1]):
            first[r[0]] = i
    books = parts[[first[v] for v in sorted(first)][:64]].transpose(1, 0, 2).copy()

    def assign():
        far = ((parts[:, :, None, :] - books[None]) ** 2).sum(-1)
        return far.argmin(-1), far.min(-1).sum(-1)

    for _ in range(2):
        index, _ = assign()
        for p in range(16):
            for e in range(books.shape[1]):
                own = parts[index[:, p] == e, p]
                if len(own):
                    books[p, e] = [sum(map(int, c)) // len(own) for c in own.T]
    index, error = assign()
    by_label = {}
    for r, e in zip(kept, error.tolist(), strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{c:02x}" for c in code), e, by_label[r[2]], sha) for r, code, e in zip(kept, index.tolist(), error.tolist(), strict=True)), key=str)


def test_codes(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = sorted(map(tuple, pivot_codes.judged(df).collect()), key=str)
    assert got == codes_by_hand([tuple(r) for r in df.select("vec_id", "embedding", "label").collect()])


def test_codes_on_awkward_rows(spark):
    pick = random.Random(6)
    rows = [(i, [pick.choice([0.0, 0.25, -0.5, pick.gauss(0, 1)]) for _ in range(40)], pick.choice([None, 1, 2])) for i in range(150)]
    rows += [(200, None, 1), (201, [0.1, None], 1), (202, [math.nan] * 40, 2), (203, [math.inf] * 40, 2), (204, [], 3), (205, [1.5], 3)]
    rows += [rows[0], rows[1], (1, [9.0] * 40, None), (None, [0.5] * 40, 1), (None, [0.5] * 40, 1), (206, [1e30] * 40, 9), (207, [-1e30] * 40, 9)]
    schema = "vec_id long, embedding array<double>, label int, error int"
    df = spark.createDataFrame([(*r, 0) for r in rows], schema).repartition(5)
    got = sorted(map(tuple, pivot_codes.judged(df).collect()), key=str)
    assert got == codes_by_hand(rows)
    assert pivot_codes.judged(df.limit(0)).count() == 0
    assert pivot_codes.judged(df.where("vec_id IS NULL")).count() == 2
    assert pivot_codes.judged(df.where("vec_id = 204")).first().error == 0


def test_pivots_spare_distances():
    pick = np.random.default_rng(1)
    book = pick.integers(-200, 200, (64, 4))
    parts = book[pick.integers(0, 64, 500)] + pick.integers(-5, 6, (500, 4))
    pivots = pivot_codes.choose_pivots(book[None])
    tried: list[int] = []
    index, far = pivot_codes.nearest(parts, pivot_codes.to_pivots(parts[:, None], pivots)[:, 0], book, pivots[0], tried)
    every = ((parts[:, None] - book[None]) ** 2).sum(-1)
    assert (index == every.argmin(1)).all() and (far == every.min(1)).all()
    assert sum(tried) < 0.25 * 500 * 64
