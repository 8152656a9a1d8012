"""Conversation structure repair by depth-first branch-and-bound.

Rows of a conversation, in the order of their turns, are kept (cost 0), given the role user or assistant (2)
or deleted (3); rows of empty text can be inserted (2). Blank and repeated rows must go, and a
truncated row that stays costs 1. The cheapest edits after which the role initials read ``(s?(ua)+)?``
are found, the ASCII-least initials (D, I, K, R) among the cheapest: the audit.

1. Search. A node is (row, state), the state what the roles before allow next. An explicit stack goes down by the
   likeliest edit first. A prefix is dropped if its cost and the lower bound of the rows behind it exceed the incumbent
   (cost, audit), or equal its cost with a later audit, or if the node's dominance table
   has a prefix that is as cheap and not later. When the stack is empty the incumbent is proved.
   The bound is the exact cost of a simpler problem (``bounds``).
2. Pieces. Rows are sorted by ranges of (conversation, turn), so that one long conversation is spread over
   tasks, and cut into pieces of at most ``ROWS`` rows or ``BYTES`` bytes while a task reads them. A conversation in one
   piece is solved there. The pieces of others are searched from every state to every state, and a second pass
   joins these answers in order, keeping one best prefix per state; what the prefixes share is settled and passed on.
   A prefix that is better in (cost, audit) stays better whatever follows, so this is exact. Rows repeated in
   different pieces are found by their digests, of which only the first piece is aggregated.

Of a conversation larger than a piece, one task reads an answer per piece, and one the repaired
texts in order, a row at a time: SHA-256 has no parallel form. Neither holds the conversation; the audit is a
cell of the result.

Defined results: null roles and texts are one space. Rows of equal turn stand in the order of (role, text). Null
turns come first and do not count for gaps; a null conversation is one of its own. Conversations
without rows after damage have zeros, an empty audit and the hash of nothing.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ship, stored

ROWS, BYTES = 128, 1 << 22
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing yet, after s, after u, after a. What each initial leads to, and a new role.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STEP = {"s": {START: AFTER_S}, "u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A}}
NEW = {START: (AFTER_U, "user"), AFTER_S: (AFTER_U, "user"), AFTER_U: (AFTER_A, "assistant"), AFTER_A: (AFTER_U, "user")}
#: What ends a conversation in each state: (cost, audit) of the rows inserted at its end.
CLOSE = {START: (0, ""), AFTER_S: (2 * INSERT, "II"), AFTER_U: (INSERT, "I"), AFTER_A: (0, "")}
#: Groups of states: nothing yet, a user may follow, an assistant may follow; and where a new row leads.
GROUP = {START: 0, AFTER_S: 1, AFTER_A: 1, AFTER_U: 2}
TURN = (2, 2, 1)
LEGAL = ("su", "ua", "au")
SPACE = " \t\n\v\f\r"


def faults(rows: list[tuple[str, str]], seen: set[bytes], mark=None) -> list[str]:
    """``blank``, ``duplicate``, ``truncated`` or nothing for each (role, text); ``seen`` has digests of earlier rows."""
    out = []
    for role, text in rows:
        own = (mark or digest)(role, text)
        last = text.rstrip(SPACE)[-1:]
        out.append("blank" if not last else "duplicate" if own in seen else "" if last in ".!?" else "truncated")
        seen.add(own)
    return out


def digest(role: str, text: str) -> bytes:
    """What tells (role, text) apart; ``_digest`` is the same in Spark."""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def bounds(initials: list[str], found: list[str], close: dict[int, tuple[int, str]]) -> list[list[int]]:
    """Lower bounds of the cost of the rows from each place on, by ``GROUP`` of the state.

    They are the exact costs of a simpler problem, in which a conversation may end behind an s as it may behind an a.
    """
    never = 1 << 60
    out = [[min([c for state, (c, _) in close.items() if GROUP[state] == g], default=never) for g in range(3)]]
    for initial, fault in zip(reversed(initials), reversed(found), strict=True):
        after, now = out[-1], []
        late = TRUNCATED if fault == "truncated" else 0
        for g in range(3):
            least = DELETE + after[g]
            if fault not in ("blank", "duplicate"):
                least = min(least, REROLE + late + after[TURN[g]])
                if (g, initial) in ((0, "u"), (1, "u"), (2, "a")):
                    least = min(least, KEEP + late + after[TURN[g]])
                elif (g, initial) == (0, "s"):
                    least = min(least, KEEP + late + after[1])
            now.append(least)
        out.append([min(now[g], INSERT + now[TURN[g]], 2 * INSERT + now[1]) for g in range(3)])
    return out[::-1]


def search(initials: list[str], found: list[str], start: int, close: dict[int, tuple[int, str]], count: list[int] | None = None) -> tuple[int, str] | None:
    """The least (cost, audit) from ``start`` over all rows to a state of ``close``, with its cost and audit; None without a way.

    ``count`` gets the number of nodes opened.
    """
    n, rest = len(initials), bounds(initials, found, close)
    best: tuple[int, str] | None = None
    table: dict[tuple[int, int], tuple[int, str]] = {(0, start): (0, "")}
    stack = [(0, start, 0, "")]
    opened = 0
    while stack:
        i, state, cost, audit = stack.pop()
        if table[i, state] != (cost, audit):
            continue
        if best is not None:
            least = cost + rest[i][GROUP[state]]
            if least > best[0] or (least == best[0] and audit > best[1][: len(audit)]):
                continue
        opened += 1
        if i == n:
            if state in close:
                whole = (cost + close[state][0], audit + close[state][1])
                best = whole if best is None else min(best, whole)
            continue
        late = TRUNCATED if found[i] == "truncated" else 0
        after, _ = NEW[state]
        ways = [(cost + DELETE, "D", i + 1, state), (cost + INSERT, "I", i, after)]
        if found[i] not in ("blank", "duplicate"):
            if state in STEP.get(initials[i], ()):
                ways.append((cost + KEEP + late, "K", i + 1, STEP[initials[i]][state]))
            ways.append((cost + REROLE + late, "R", i + 1, after))
        ways.sort(key=lambda w: (w[0] + rest[w[2]][GROUP[w[3]]], w[1]), reverse=True)  # the likeliest is on top
        for price, letter, j, to in ways:
            label = (price, audit + letter)
            held = table.get((j, to))
            if held is None or label < held:
                table[j, to] = label
                stack.append((j, to, *label))
    if count is not None:
        count.append(opened)
    return best


def repaired(rows: list[tuple[str, str]], start: int, audit: str) -> Iterator[str]:
    """``role:text`` of what ``audit`` leaves of the rows."""
    state, place = start, 0
    for letter in audit:
        if letter == "I":
            state, role = NEW[state]
            yield f"{role}:"
            continue
        role, text = rows[place]
        place += 1
        if letter == "K":
            state = STEP[role[:1]][state]
        elif letter == "R":
            state, role = NEW[state]
        if letter != "D":
            yield f"{role}:{text}"


class Hash:
    """SHA-256 of lines joined by line ends, a line at a time."""

    def __init__(self):
        self.state, self.any = hashlib.sha256(), False

    def add(self, line: str) -> None:
        self.state.update(("\n" if self.any else "").encode() + line.encode())
        self.any = True


class Counts:
    """Gaps and faults, added up over the pieces of a conversation in order."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.last = None

    def add(self, turns: list[int | None], initials: list[str], found: list[str]) -> None:
        for kind in found:
            if kind:
                setattr(self, kind, getattr(self, kind) + 1)
        for turn in turns:
            if turn is not None and turn != self.high:  # turns ascend
                self.turns += 1
                self.low, self.high = turn if self.low is None else self.low, turn
        for own in initials:
            self.illegal += self.last is not None and self.last + own not in LEGAL
            self.last = own

    def gaps(self) -> int:
        return min(self.high - self.low + 1 - self.turns, (1 << 63) - 1) if self.turns else 0

    def values(self) -> dict[str, int]:
        return {"gaps": self.gaps(), "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal}


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_ROW = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
_RESULT = pa.struct([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in RESULT.split(", ")])
_WAY = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])


def whole(rows: list[tuple]) -> dict:
    """The result of a conversation that is one piece; rows are (turn, role, text)."""
    said = [(role, text) for _, role, text in rows]
    initials, found, counts, mark = [role[:1] for role, _ in said], faults(said, set(), lambda *r: r), Counts(), Hash()
    counts.add([r[0] for r in rows], initials, found)
    cost, audit = search(initials, found, START, CLOSE)
    for line in repaired(said, START, audit):
        mark.add(line)
    return {**counts.values(), "cost": cost, "audit": audit, "repaired_sha256": mark.state.hexdigest()}


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows after the damage that crc32 of ``conv_id:turn`` chooses; dropped rows
    have 0 copies."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(named("text"), "[.!?]", "")).otherwise(named("text"))
    return conversations.select(
        F.col("conv_id").cast("bigint"),
        F.col("turn").cast("bigint"),
        F.when(kind == 4, "user").otherwise(named("role")).alias("role"),
        F.when(kind == 0, "").otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def pieces(rows: DataFrame, most: int = ROWS, size: int = BYTES) -> DataFrame:
    """conv_id, piece, and either ``result`` of a whole conversation or the ``rows`` of a piece of one; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number, now, outer = TaskContext.get().partitionId() << 32, 0, None, True
        held, weight, parts, ready, waiting = [], 0, 0, [], 0

        def close(alone: bool) -> None:
            nonlocal held, weight, number, parts, waiting
            ready.append((now[0], base + number, whole(held) if alone else None, None if alone else [dict(zip(("turn", "role", "text"), r, strict=True)) for r in held]))
            waiting += 0 if alone else weight
            held, weight, number, parts = [], 0, number + 1, parts + 1

        def batch_of() -> pa.RecordBatch:
            nonlocal ready, waiting
            names, kinds = ["conv_id", "piece", "result", "rows"], [pa.int64(), pa.int64(), _RESULT, pa.list_(_ROW)]
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in ready], k) for i, k in enumerate(kinds)], names=names)
            ready, waiting = [], 0
            return out

        for batch in batches:
            for conv, turn, role, text, copies in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        # the first conversation of a task may have begun in the one before
                        close(not outer and not parts)
                        outer = False
                    now, parts = (conv,), 0
                for _ in range(copies):
                    if held and (len(held) == most or weight + len(text) > size):
                        close(False)
                    held.append((turn, role, text))
                    weight += len(text)
                if len(ready) >= 256 or waiting > size:
                    yield batch_of()
        if now is not None:
            close(False)  # the last one may go on in the next task
            yield batch_of()

    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("salt")]
    salted = rows.withColumn("salt", F.monotonically_increasing_id())  # parts rows that are equal in all else
    dealt = salted.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "copies")
    row = "struct<turn: long, role: string, text: string>"
    result = "struct<" + ", ".join(c.replace(" ", ": ") for c in RESULT.split(", ")) + ">"
    return stored(dealt.mapInArrow(run, f"conv_id long, piece long, result {result}, rows array<{row}>"), "turn-pieces")


def _seen_before(parts: DataFrame) -> DataFrame:
    """(piece, seen): digests of the piece that an earlier piece of its conversation has too."""
    own = F.transform("rows", lambda r: F.unhex(F.sha2(F.concat(F.length(r["role"]).cast("string"), F.lit(":"), r["role"], r["text"]), 256)))
    marks = parts.select("k", "piece", F.explode(F.array_distinct(own)).alias("digest"))
    first = marks.groupBy("k", "digest").agg(F.min("piece").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = marks.join(first, ["k", "digest"]).where("piece > first")
    return stored(later.groupBy("piece").agg(F.collect_list("digest").alias("seen")), "turn-seen")


def _solved(parts: DataFrame) -> DataFrame:
    """Each piece's faults, turns and initials, and its best ways between all states; stored."""
    names = ["k", "piece", "turns", "initials", "found", "ways"]
    kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(_WAY)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                out = []
                for k, piece, rows, seen in zip(*(c.to_pylist() for c in batch.slice(at, 16).columns), strict=True):
                    said = [(r["role"], r["text"]) for r in rows]
                    initials, found, ways = [role[:1] for role, _ in said], faults(said, set(seen or ())), []
                    for start in range(4):
                        for end in range(4):
                            way = search(initials, found, start, {end: (0, "")}) if start == end or end > AFTER_S or start == START and end and "s" in initials else None
                            if way:
                                ways.append({"start": start, "end": end, "cost": way[0], "audit": way[1]})
                    out.append((k, piece, [r["turn"] for r in rows], initials, found, ways))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=names)

    schema = "k string, piece long, turns array<long>, initials array<string>, found array<string>, ways array<struct<start: int, end: int, cost: long, audit: string>>"
    return stored(parts.join(_seen_before(parts), "piece", "left").select("k", "piece", "rows", "seen").mapInArrow(run, schema), "turn-solved")


class Fold:
    """The best way through the pieces so far to each state: (cost, [(piece, start, audit), ...])."""

    def __init__(self):
        self.ways: dict[int, tuple[int, list[tuple[int, int, str]]]] = {START: (0, [])}

    def add(self, piece: int, ways: list[dict]) -> None:
        found: dict[int, tuple[int, str, list]] = {}
        for w in ways:
            if w["start"] in self.ways:
                cost, before = self.ways[w["start"]]
                steps = [*before, (piece, w["start"], w["audit"])]
                new = (cost + w["cost"], "".join(a for *_, a in steps), steps)
                if w["end"] not in found or new[:2] < found[w["end"]][:2]:
                    found[w["end"]] = new
        self.ways = {end: (cost, steps) for end, (cost, _, steps) in found.items()}

    def settled(self) -> list[tuple[int, int, str]]:
        """The steps that all ways begin with; they are taken away from them. The newest stays, as
        the end may add to it."""
        held = [steps for _, steps in self.ways.values()]
        common = os.path.commonprefix(held)[: len(held[0]) - 1]
        self.ways = {end: (cost, steps[len(common) :]) for end, (cost, steps) in self.ways.items()}
        return common

    def end(self) -> tuple[int, list[tuple[int, int, str]]]:
        """The cost, and the steps left; the last one's audit has what is inserted at the end."""
        closed = []
        for state, (cost, steps) in self.ways.items():
            price, tail = CLOSE[state]
            if steps:
                steps = [*steps[:-1], (*steps[-1][:2], steps[-1][2] + tail)]
            closed.append((cost + price, "".join(a for *_, a in steps), steps))
        cost, _, steps = min(closed, key=lambda c: c[:2])
        return cost, steps


def _folded(solved: DataFrame) -> DataFrame:
    """Rows (k, piece, start, audit) of every piece, and one (k, result) per conversation without its hash; stored."""
    names = ["k", "piece", "start", "audit", "result"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), _RESULT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold, counts, audits, out = None, Fold(), Counts(), [], []

        def give(steps: list[tuple]) -> None:
            for step in steps:
                audits.append(step[2])
                out.append((now, *step, None))

        def finish() -> None:
            cost, steps = fold.end()
            give(steps)
            out.append((now, None, None, None, {**counts.values(), "cost": cost, "audit": "".join(audits), "repaired_sha256": None}))

        for batch in batches:
            for k, piece, turns, initials, found, ways in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != now:
                    if now is not None:
                        finish()
                    now, fold, counts, audits = k, Fold(), Counts(), []
                counts.add(turns, initials, found)
                fold.add(piece, ways)
                give(fold.settled())
            while out:
                part, out = out[:1000], out[1000:]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], kind) for i, kind in enumerate(kinds)], names=names)
        if now is not None:
            finish()
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=names)

    result = "struct<" + ", ".join(c.replace(" ", ": ") for c in RESULT.split(", ")) + ">"
    return stored(solved.repartition("k").sortWithinPartitions("k", "piece").mapInArrow(run, f"k string, piece long, start int, audit string, result {result}"), "turn-folded")


def _hashed(parts: DataFrame, chosen: DataFrame) -> DataFrame:
    """(k, sha) of the repaired conversations, from their pieces in order."""

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                ks, numbers, starts, audits, rows = (c.to_pylist() for c in part.columns)
                lines = [list(repaired([(r["role"], r["text"]) for r in own], start, audit)) for own, start, audit in zip(rows, starts, audits, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ks), pa.array(numbers), pa.array(lines, pa.list_(pa.string()))], names=["k", "piece", "lines"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mark, out = None, Hash(), []
        for batch in batches:
            for k, lines in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if k != now:
                    if now is not None:
                        out.append((now, mark.state.hexdigest()))
                    now, mark = k, Hash()
                for line in lines.as_py():
                    mark.add(line)
        if now is not None:
            out.append((now, mark.state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([h for _, h in out], pa.string())], names=["k", "sha"])

    mended = chosen.join(parts.select("piece", "rows"), "piece").select("k", "piece", "start", "audit", "rows").mapInArrow(mend, "k string, piece long, lines array<string>")
    return mended.repartition("k").sortWithinPartitions("k", "piece").mapInArrow(run, "k string, sha string")


def mended(conversations: DataFrame, most: int = ROWS, size: int = BYTES) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation."""
    ship(conversations.sparkSession)
    found = pieces(damaged(conversations), most, size)
    done = found.where("result IS NOT NULL").select("conv_id", "result.*")
    parts = found.where("result IS NULL").withColumn("k", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    folded = _folded(_solved(parts))
    shas = _hashed(parts, folded.where("piece IS NOT NULL").select("k", "piece", "start", "audit"))
    total = folded.where("piece IS NULL").select("k", "result.*").drop("repaired_sha256").join(shas.withColumnRenamed("sha", "repaired_sha256"), "k")
    rest = total.select(F.when(F.col("k") != " ", F.col("k").cast("bigint")).alias("conv_id"), *[c.split()[0] for c in RESULT.split(", ")])
    return done.unionByName(rest)
