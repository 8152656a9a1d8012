"""The dealt operators against brute force, and on awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import bpe_words, coordinate_join, line_join, mcd, piece_paths, plane_files, poisson_mix, quality_machine, sentence_spans, syncmers, url_trees
from tidemark.llm.queries import BPE, PIECES, SQL

SPACES = re.compile(r"[\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, n_removed int"


def rows():
    """Copies, near copies, repeats, nulls, empties, a long text, repeated and tied ids."""
    pick = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    say = lambda n: " ".join(pick.choice(words) for _ in range(n))
    base = ". ".join(say(9) for _ in range(6)) + ".\n" + say(30)
    out = [(i, say(pick.choice([1, 2, 12, 60])) + ".\n" + say(25) + ".", "en" if i % 3 else "de", f"s{i % 4}") for i in range(60)]
    for i in range(60, 75):
        parts = base.split(" ")
        parts[pick.randrange(len(parts))] = f"edit{i}"
        out.append((i, " ".join(parts), "en", "s0"))
    out += [(76, base, "en", "s0"), (77, base, "en", None), (78, None, None, None), (79, "", "en", "s1"), (80, " \n\t ", "fr", "s2")]
    out += [(81, say(20000), "en", "s3"), (None, base, "en", "s0"), (None, None, None, None), (82, "é 漢字 ▁ \ue000 \x00", "ja", "s9")]
    out += [(83, say(40), "en", "s1"), (83, say(40), "en", "s1"), (84, base, "en", "s0"), (84, base, "en", "s0")]
    return [(a, b, c, d, None if b is None else len(b), 0.5, 1) for a, b, c, d in out]


@pytest.fixture(scope="module")
def given():
    return rows()


@pytest.fixture(scope="module")
def docs(spark, given):
    return spark.createDataFrame(given, COLUMNS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def words(text, lower=False):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "") if lower else text or ""
    return [w for w in SPACES.split(text) if w]


def test_syncmers(docs, given, empty):
    got = {r.doc_id: r for r in syncmers.edited(docs).collect() if r.doc_id is not None and r.doc_id not in (83, 84)}
    ids = sorted({r[0] for r in given if r[0] is not None}, reverse=True)
    text = {r[0]: r[1] or "" for r in given if r[0] is not None}
    for i, doc in enumerate(ids):
        after = ids[(i + 1) % len(ids)]
        if doc in got and after not in (83, 84):
            n = len(text[doc])
            want = text[doc][: n - n // 3] + text[after][: n // 3]
            assert got[doc].n_chars == n
            assert got[doc].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert got[76].fingerprint == got[77].fingerprint != ""
    assert got[78].fingerprint == got[79].fingerprint == "" and got[79].near_next == 1.0
    assert got[77].near_next == 1.0 and got[81].near_edited > 0.3 and got[81].near_next < 0.1
    assert syncmers.edited(docs).count() == len(given)
    assert syncmers.edited(empty).count() == 0


def test_syncmers_are_context_free(spark):
    text = " ".join(f"t{i * i % 97}" for i in range(80))
    df = spark.createDataFrame([(text, "x y z " + text)], "a string, b string")
    row = df.select(syncmers.anchors(F.col("a")).alias("a"), syncmers.anchors(F.col("b")).alias("b")).first()
    assert {(x.position + 3, x.hash) for x in row.a} <= {(x.position, x.hash) for x in row.b}


def test_machine_identity():
    pick = np.random.default_rng(2)
    m = quality_machine.Machine(0.3, pick.normal(size=quality_machine.WIDTH), pick.normal(size=(quality_machine.WIDTH, 4)))
    index, x = np.array([3, 50, 700, 8195]), np.array([0.5, 1.0, -2.0, 0.25])
    pairs = sum((m.factors[index[a]] @ m.factors[index[b]]) * x[a] * x[b] for a in range(4) for b in range(a + 1, 4))
    assert abs(m.margin(index, x) - (0.3 + m.weights[index] @ x + pairs)) < 1e-9


def test_machine_learns_and_scores_every_row(spark, docs, given, empty):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    known = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    machine = quality_machine.train(known, labels)
    held = quality_machine.scored(known, machine).join(labels, "doc_id").where(quality_machine.held_out())
    right = held.select(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("quality")).cast("int")).alias("a")).first().a
    assert right > 0.95
    out = quality_machine.scored(docs, machine, "p").collect()
    assert len(out) == len(given) and all(0 <= r.p <= 1 for r in out)
    assert quality_machine.accepted(docs, labels.limit(0)).columns == docs.columns
    assert quality_machine.accepted(empty, labels.limit(0)).count() == 0


def test_bpe_words_equal_the_library():
    own, library = bpe_words.WordEncoder(BPE, cache=50), Tokenizer.from_file(BPE)
    pick = random.Random(1)
    parts = ["a", "B", "é", "1", " ", "  ", "\n", " \n", "\n ", ".", "'s", "'", "\t", "\xa0", "漢", "<|endoftext|>", " ", "!", "they're", "-", "word,", " long"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 12))) for _ in range(1500)]
    for at in range(0, len(texts), 100):
        some = texts[at : at + 100]
        for text, ids in zip(some, own.encode(some), strict=True):
            assert np.frombuffer(ids, own.kind).tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("bits", [False, True])
def test_planes(spark, docs, given, empty, bits, tmp_path):
    ids = np.random.default_rng(3).integers(0, 1 << 32, 1000, dtype=np.uint32)
    assert (plane_files.unplanes(plane_files.planes(ids, bits), len(ids), bits) == ids).all()
    path = str(tmp_path / "x.tpl")
    with pafs.LocalFileSystem().open_output_stream(path) as sink:
        writer = plane_files.Writer(sink, bits, block=64)
        for i in range(40):
            writer.add(i if i else None, ids[i * 25 : i * 25 + i])
        writer.close()
    with pafs.LocalFileSystem().open_input_file(path) as source:
        for (name, _, found), i in zip(plane_files.Reader(source).documents(), range(40), strict=True):
            assert name == (i if i else None)
            assert np.concatenate([*found, []]).tolist() == ids[i * 25 : i * 25 + i].tolist()
    library, start = Tokenizer.from_file(BPE), 0
    got = plane_files.round_trip(docs, BPE, 2, bits).orderBy("start").collect()
    order = sorted(given, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for row, (doc, text, *_) in zip(got, order, strict=True):
        want = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert tuple(row) == (doc, start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    assert plane_files.round_trip(empty, BPE, 2, bits).count() == 0


def test_urls(spark):
    urls = [f"https://{h}/{p}/{i}" for i, (h, p) in enumerate((h, p) for h in ("www.example.com", "a.example.com", "b.net", "x.org", "net") for p in ("en", "es", "fr"))]
    urls += [None, "", "no scheme", "http://A.COM", "http://A.COM/x?y=http://z.net/es/#q", "x://net/es/", "http://example.comx/en/", "http://notnet.org/es/", urls[0]]
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")
    got = sorted(url_trees.judge(df).collect(), key=lambda r: r.page_id)
    assert len(got) == len(urls)
    for row, url in zip(got, urls, strict=True):
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.split("[/?#]", rest)[0]
            path = re.split("[?#]", rest[len(host) :])[0]
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [r for r in url_trees.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.host + r.path), default=None)
        assert (row.host, row.path) == (host, path)
        assert row.rule == (best.host + best.path if best else None)
        assert row.verdict in ("allow", "block") and (not best or row.verdict == best.verdict)
    assert url_trees.judge(df.limit(0)).count() == 0
    assert {r.verdict for r in url_trees.judge(df.where("page_id IN (15, 16)")).collect()} == {"allow"}


def ordered(given):
    seen, out = set(), []
    for r in sorted(given, key=lambda r: (r[0] is None, r[0] or 0)):
        if (r[0], r[1]) not in seen:
            seen.add((r[0], r[1]))
            out.append(r)
    return [r for r in out if r[0] != 83 and r[0] is not None]


def test_lines(docs, given, empty):
    kept: list[frozenset] = []
    want = {}
    for doc, text, *_ in ordered(given):
        stay = []
        for line in (text or "").split("\n"):
            own = frozenset(words(line))
            if not own or not any(100 * len(own & o) >= 80 * len(own | o) for o in kept):
                stay.append(line)
            if own:
                kept.append(own)
        want[doc] = None if text is None else "\n".join(stay)
    got = line_join.cleaned(docs.where("doc_id != 83")).collect()
    assert {r.doc_id: r.text for r in got} == want
    assert line_join.cleaned(docs).count() == len(given) and line_join.cleaned(empty).count() == 0


def test_lines_large_groups(spark):
    """Near copies of one line under words of many and of few lines, and copies that are not like the first."""
    rows = []
    for i in range(200):
        base = [f"w{j}" for j in range(20)]
        base[i % 20] = f"x{i // 20}y{i % 20}"
        base[i * 7 % 20] = f"z{i % 9}"
        rows.append((i, " ".join(base) + "\n" + " ".join(f"v{i // 4}k{j}" for j in range(6 + i % 2))))
    rows += [(None, rows[3][1]), (None, None), (300, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept, want = [], []
    for doc, text in rows:
        stay = []
        for line in (text or "").split("\n"):
            own = frozenset(line.split())
            if not own or not any(100 * len(own & o) >= 80 * len(own | o) for o in kept):
                stay.append(line)
            if own:
                kept.append(own)
        want.append((doc, None if text is None else "\n".join(stay)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in line_join.cleaned(df).collect()), key=key) == sorted(want, key=key)


def test_lines_shuffle_once(spark):
    """The second pass reads one shuffle of postings on both sides; the first one posts frequent words only."""
    rows = [(i, f"common words here and number{i} of{i} line{i}") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    heads = line_join.classes(line_join.described(df, line_join.rarity(df)))
    posted = line_join.posted(heads, "often")
    assert posted.count() == 300 and posted.where("place >= often").count() == 0
    pairs = line_join.open_pairs(heads, heads.select("r").limit(0))
    pairs.collect()
    plan = pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan and plan.count("- Exchange hashpartitioning(token") == 1
    assert line_join.cleaned(df).where("n_removed > 0").count() == 0


def test_lines_white_space_and_names(spark):
    words10 = "one two three four five six seven eight nine ten"
    rows = [
        (1, words10 + "\n\t\x0b \r\n\n", 1),
        (2, "\t" + words10.replace(" ", "\t") + "\r\nstays\x0bhere", 2),
        (3, words10.replace("ten", "zehn") + "\x0cnew\xa0word\nhere  stays", 3),
        (4, words10.replace(" ", "\x0c").replace("ten", "eleven"), 4),
        (5, words10.replace(" ", "\xa0"), 5),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int")
    got = {r.doc_id: r for r in line_join.cleaned(df).collect()}
    assert got[1].text == rows[0][1] and got[1].n_lines == 4 and got[1].n_removed == 0
    assert got[2].text == "stays\x0bhere" and got[2].n_removed == 1
    assert got[3].text == rows[2][1].split("\n")[0] and got[3].n_removed == 1  # 9 of 12 words are shared: 75 %
    assert got[4].text == "" and got[4].n_removed == 1  # 9 of 11
    assert got[5].text == rows[4][1] and [got[i]["a.b"] for i in range(1, 6)] == [1, 2, 3, 4, 5]


def test_spans(docs, given, empty):
    seen, want = set(), {}
    for doc, text, *_ in ordered(given):
        parts = re.split(sentence_spans.CUT, text or "")
        real = [i for i, p in enumerate(parts) if p.strip(sentence_spans.BLANK)]
        said, gone = [parts[i].strip(sentence_spans.BLANK) for i in real], set()
        for j in range(max(len(said) - 2, min(len(said), 1))):
            run = tuple(said[j : j + 3])
            if run in seen:
                gone |= set(range(j, min(j + 3, len(said))))
            seen.add(run)
        drop = {real[g] for g in gone}
        want[doc] = (len(gone), None if text is None else "".join(p for i, p in enumerate(parts) if i not in drop))
    got = sentence_spans.deduplicated(docs.where("doc_id != 83")).collect()
    assert {r.doc_id: (r.n_removed, r.text) for r in got if r.doc_id is not None} == want
    assert sentence_spans.deduplicated(docs).count() == len(given) and sentence_spans.deduplicated(empty).count() == 0


def test_spans_of_hot_hashes_in_lanes(spark, monkeypatch):
    """A passage in all documents, spread over lanes, is cut from the same places; texts of null ids are told apart."""
    passage = "One two three. Four five six. Seven eight nine."
    rows = [(i if i % 5 else None, f"Only here {i} a. {passage} And {i} here b.") for i in range(40)]
    docs = spark.createDataFrame([*rows, (3, None), (7, "")], "doc_id bigint, text string")

    def cut():
        return sorted(map(str, sentence_spans.deduplicated(docs).collect()))

    whole = cut()
    monkeypatch.setattr(sentence_spans, "HEAVY", 3)
    assert cut() == whole and sum("n_removed=3" in r for r in whole) == 39


def test_spans_of_few_long_sentences(spark):
    """Repeated passages that hold fewer than three whole sentences."""
    say = lambda n, mark: " ".join(f"{mark}{i}" for i in range(n)) + ". "
    two, one, short = say(30, "a") + say(31, "b"), say(60, "c"), say(5, "d") + say(6, "e")
    texts = [say(9, f"x{i}") + two + say(9, f"y{i}") + one + say(9, f"z{i}") + short + say(9, f"v{i}") for i in range(2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in sentence_spans.deduplicated(df).collect()}
    assert (got[0].n_removed, got[0].text) == (0, texts[0])
    assert (got[1].n_sentences, got[1].n_removed) == (9, 3)
    assert got[1].text == texts[1].replace(two, "").replace(one, "")


def test_mixture_equals_sql(docs, given, empty):
    got = sorted(tuple(r) for r in poisson_mix.mixed(docs.where("doc_id IS NOT NULL AND source IS NOT NULL").select("doc_id", "source", "text")).collect())
    base = duckdb.connect()
    base.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, text VARCHAR)")
    base.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r[0], r[3], r[1]) for r in given if r[0] is not None and r[3] is not None])
    assert got == sorted(base.execute(SQL["op7_mixture"]).fetchall())
    assert poisson_mix.mixed(docs, {"s0": 0.5}).columns == [*docs.columns, "mix_copy", "mix_order"]
    assert poisson_mix.mixed(empty).count() == 0


@pytest.mark.parametrize("rate", [650, 800, 5000])
def test_mixture_of_large_rates(spark, rate):
    given = [(0, "b" * (80 * rate - 40), "big")] + [(i, "x", "small") for i in range(1, 31)] + [(None, chr(97 + i), "small") for i in range(10)]
    df = spark.createDataFrame(given, "doc_id long, text string, source string")
    found = poisson_mix.mixed(df, {"small": 0.5}).where("source = 'small'").groupBy("doc_id", "text").count().collect()
    counts = np.array([r["count"] for r in found])
    assert poisson_mix.rates(df, {"small": 0.5}).where("source = 'small'").first().rate == rate
    assert len(counts) == 40 and abs(counts.mean() - rate) < 4 * (rate / 40) ** 0.5
    assert 0.4 * rate < counts.var(ddof=1) < 2 * rate
    assert len({r["count"] for r in found if r.doc_id is None}) > 3


def test_statistics(docs, given, empty):
    got = {r.doc_id: r for r in mcd.judge(docs).collect()}
    for doc, text, *_ in given:
        if doc is None or doc == 83:
            continue
        own = words(text)
        runs = [tuple(own[i : i + 5]) for i in range(len(own) - 4)]
        many = {r for r in runs if runs.count(r) > 1} if len(own) < 1000 else set()
        inside = {i + j for i, r in enumerate(runs) if r in many for j in range(5)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        r = got[doc]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(own), sum(map(len, own)), len(inside)), doc
        assert r.n_dup_lines == len(lines) - len(set(lines)) and r.n_symbols == len(re.findall(r"[#*$%&|<>]", text or ""))
        assert r.base_failed == (len(own) < 10 or 100 * len(inside) > 20 * len(own)) and not (r.base_failed and r.kept)
    assert mcd.judge(docs).count() == len(given) and mcd.judge(empty).count() == 0


def test_outliers(spark):
    """Against the same concentration steps in numpy."""
    pick = np.random.default_rng(4)
    z = np.concatenate([pick.normal(size=(180, 2)), pick.normal(6, 0.3, size=(20, 2))])
    df = spark.createDataFrame([("p", *map(float, r)) for r in z], "pool string, z0 double, z1 double")
    spread = (0.1, 0.1)
    row = mcd.estimates(df, 0.75, 3, spread).first()
    q = np.quantile(z, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
    mean, cov = q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2 + 0.01)
    for _ in range(3):
        d = np.einsum("ij,jk,ik->i", z - mean, np.linalg.inv(cov), z - mean)
        near = z[d <= np.quantile(d, 0.75, method="inverted_cdf")]
        mean, cov = near.mean(0), mcd.consistency(0.75, 2) * np.cov(near.T, bias=True) + 0.01 * np.eye(2)
    assert np.allclose([row.m0, row.m1, row.c00, row.c10, row.c11], [*mean, cov[0, 0], cov[1, 0], cov[1, 1]])
    assert np.allclose(mean, 0, atol=0.4)


def test_outliers_settle(spark):
    """The half of the rows that lies densest is several steps from the median."""
    z = np.sqrt(np.arange(1, 601) / 600)
    df = spark.createDataFrame([("p", float(x), 0.0) for x in z], "pool string, z0 double, z1 double")
    four, last = (mcd.estimates(df, 0.5, n, (0.01, 1.0)).first() for n in (4, mcd.STEPS))
    mean = np.median(z)
    for _ in range(200):
        far = (z - mean) ** 2
        mean = z[far <= np.quantile(far, 0.5, method="inverted_cdf")].mean()
    assert abs(last.m0 - mean) < 1e-3 < abs(four.m0 - mean)


def test_outliers_per_statistic(spark):
    """Each planted text is far off in one statistic only."""
    plain = lambda i, n=40: " ".join(f"word{i * 97 + j:06d}" for j in range(n))
    texts = {i: "\n".join(plain(100 * i + j, 20) for j in range(10)) for i in range(60)}
    texts[100] = texts[0] + "\n" + "\n".join(["ad"] * 13)  # half of the lines repeat
    texts[101] = plain(9001).replace("word", "$word")
    texts[102] = plain(9002).replace("word", "word" * 20)
    texts[103] = plain(9003) + " " + plain(9003, 10)  # more than 20 % of the words
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in texts.items()], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in mcd.judge(df).collect()}
    assert all(got[i].kept for i in range(60))
    assert not any(got[i].kept for i in range(100, 104)) and [got[i].base_failed for i in range(100, 104)] == [False, False, False, True]


def best_path(own, text):
    """Every position's best path, by trying all pieces at it."""
    ids = {p: (i, s) for p, i, s in own}
    lowest = min(s for _, _, s in own) - piece_paths.UNKNOWN
    best = [(0.0, 0)] + [None] * len(text)
    for end in range(1, len(text) + 1):
        found = [(best[b][0] + ids[text[b:end]][1], best[b][1] + 1) for b in range(end) if text[b:end] in ids]
        best[end] = max(found, key=lambda x: (x[0], -x[1])) if found else (best[end - 1][0] + lowest, best[end - 1][1] + 1)
    return best[-1][0]


def test_piece_paths():
    pick = random.Random(9)
    names = [f"<0x{b:02X}>" for b in range(256)]
    vocabulary = ["▁", "a", "b", "▁a", "ab", "ba", "aab", "▁ab", "bb", "▁▁"]
    scores = [-float(pick.randint(1, 9)) for _ in vocabulary]
    own = piece_paths.Pieces([*names, *vocabulary], [0.0] * 256 + scores)
    known = [(p, i, s) for i, (p, s) in enumerate(zip(vocabulary, scores, strict=True))]
    for _ in range(300):
        text = "".join(pick.choice("ab c ") for _ in range(pick.randint(0, 10)))
        ids = own.encode(text).tolist()
        assert own.decode(ids) == text
        if text:
            marked = piece_paths.MARK + text.replace(" ", piece_paths.MARK)
            lowest = min(scores) - piece_paths.UNKNOWN
            got = sum(scores[i - 256] if i >= 256 else lowest for i in ids)
            assert abs(got - best_path(known, marked)) < 1e-9, text


def test_pieces_round_trip(docs, given, empty):
    back = piece_paths.decoded(piece_paths.encoded(docs, PIECES), PIECES).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.text) for r in back), key=key) == sorted(((r[0], r[1] or "") for r in given), key=key)
    assert piece_paths.encoded(empty, PIECES).count() == 0
    assert public_tokenizers.path("piece_bpe_32k.model") == PIECES


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, given, empty, k, percent):
    sets: dict[int, list[frozenset]] = {}
    for doc, text, *_ in given:
        own = words(text, lower=True)
        if doc is not None:
            sets.setdefault(doc, []).append(frozenset(tuple(own[i : i + k]) for i in range(max(len(own) - k + 1, min(1, len(own))))))
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and any(100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b] if x and y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    got = coordinate_join.near_duplicates(docs, k, percent).collect()
    assert len(got) == len(given)
    assert {r.doc_id: r.component_id for r in got} == {**{d: find(d) for d in sets}, None: None}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert coordinate_join.near_duplicates(empty, k, percent).count() == 0


def test_near_duplicates_of_many_copies_makes_few_pairs(spark, monkeypatch):
    """Copies of one original that are nearly, but not, alike enough with each other are no candidates."""
    rng, sets = random.Random(5), {}
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        own = [f"c{i}x{j}" if j in marks else w for marks in [set(rng.sample(range(150), 3 + i % 3))] for j, w in enumerate(base)]
        rows.append((i, " ".join(own)))
        sets[i] = {tuple(own[j : j + 3]) for j in range(148)}
    pairs = [(a, b) for a in sets for b in sets if a < b]
    likeness = {p: len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) for p in pairs}
    true, between = [p for p in pairs if 100 * likeness[p] >= 85], [p for p in pairs if 0.75 <= likeness[p] < 0.85]
    assert len(between) > 1000 and true
    asked, real = [], coordinate_join.confirmed
    monkeypatch.setattr(coordinate_join, "confirmed", lambda pairs, *more: asked.extend(pairs.distinct().collect()) or real(pairs, *more))
    got = {r.doc_id: r.component_id for r in coordinate_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert len({(r.a, r.b) for r in asked} - set(true)) < len(between) / 20
    least = {d: d for d in sets}
    for _ in sets:
        for a, b in true:
            least[a] = least[b] = min(least[a], least[b])
    assert got == least


def test_pipeline_stages(spark, docs):
    folder = "/root/testdata/sf0.001"
    for some in (docs, docs.limit(0)):
        now = some.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, folder)
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            now = spark.createDataFrame(now.collect(), now.schema)
        last = corpus_pipeline.STAGES[-1][1](spark, now, folder)
        assert {"doc_id", "piece_ids", "n_pieces"} <= set(last.columns) and last.count() == now.count()


def test_pipeline_removes_rows_not_ids(spark):
    """Two texts under one doc_id, copies without id, repeated rows, and rows without a word."""
    pick = random.Random(2)
    a, b = (" ".join(f"w{pick.randrange(500)}" for _ in range(80)) for _ in range(2))
    near = a.replace(a.split(" ")[40], "other", 1)
    rows = [(1, a), (2, near), (2, b), (None, a), (3, a), (3, a), (None, near), (4, None), (None, " "), (4, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 1, 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row_number int").repartition(3)
    out = corpus_pipeline.near_duplicates(spark, df, "")
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(1, a), (2, b), (4, None), (4, None), (None, " ")], key=str)
    assert corpus_pipeline.near_duplicates(spark, df.limit(0), "").count() == 0
