"""Pieces of a SentencePiece vocabulary: encoding by the best path, and decoding.

The pieces are the patterns of an Aho-Corasick automaton. One pass over the characters follows
its transitions; at every position the output links name all pieces that end there, and each
relaxes the best score of its end from the best score of its beginning. The path of the
highest sum of scores is the encoding. An end that no piece reaches is reached by its
character's UTF-8 bytes' pieces, at ``UNKNOWN`` below the lowest score.

Ties: the path of fewer pieces wins, then the one whose last piece is longer.

A space is written as U+2581 and one is put before the text, as the vocabulary expects. Where
no piece has U+2581 behind another character, no piece spans the beginning of a run of
spaces: the text is cut there, the parts are encoded one by one and the results kept. The
same holds for any two neighbours that no piece has side by side.

Defined results: null and empty texts have no ids. Decoding an encoding gives the text back,
whatever is in it: a U+2581 of the text itself is written as bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import ship

MARK, UNKNOWN, CACHE = "▁", 10.0, 700_000
_OUTSIDE = "\ue000"
_RUNS = re.compile(r" +[^ ]*")
_known: dict[str, Pieces] = {}


class Pieces:
    def __init__(self, pieces: Sequence[str], scores: Sequence[float], special: frozenset[int] = frozenset(), cache: int = CACHE):
        """``special`` ids (controls, bytes) are no patterns; byte pieces are named <0xNN>."""
        self.pieces = list(pieces)
        ids = {p: i for i, p in enumerate(self.pieces)}
        self.byte_ids = [ids[f"<0x{b:02X}>"] for b in range(256)]
        self.bytes_of = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        usable = [i for i, p in enumerate(self.pieces) if p and i not in special and i not in self.bytes_of]
        self.lowest = min((scores[i] for i in usable), default=0.0) - UNKNOWN
        self.by_word = not any(MARK in self.pieces[i][1:] and self.pieces[i].strip(MARK) for i in usable)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for i in usable:
            self.automaton.add_word(self.pieces[i], (len(self.pieces[i]), i, float(scores[i])))
        if usable:
            self.automaton.make_automaton()
        self.empty = not usable
        self.pairs = {(a, b) for i in usable for a, b in zip(self.pieces[i], self.pieces[i][1:])}
        self.cache, self.kept, self.tails = cache, {}, {}
        self.spelled = [self.bytes_of.get(i, p.replace(MARK, " ").encode()) for i, p in enumerate(self.pieces)]

    def path(self, text: str) -> list[int]:
        """The ids of the best path over ``text``, which has its marks already."""
        n, never, lowest = len(text), float("-inf"), self.lowest
        score, count, begins, ids = [never] * (n + 1), [0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        score[0], done = 0.0, 0
        for last, (length, i, value) in self.automaton.iter(text) if not self.empty else ():
            while done < last:  # the ends before this character's are final
                done += 1
                if score[done] == never:
                    score[done], count[done], begins[done] = score[done - 1] + lowest, count[done - 1] + 1, done - 1
            end = last + 1
            begin = end - length
            value += score[begin]
            if value > score[end] or value == score[end] and count[begin] + 1 < count[end]:
                score[end], count[end], begins[end], ids[end] = value, count[begin] + 1, begin, i
        while done < n:
            done += 1
            if score[done] == never:
                score[done], begins[done] = score[done - 1] + lowest, done - 1
        found: list[int] = []
        end = n
        while end:
            if ids[end] >= 0:
                found.append(ids[end])
            else:
                found.extend(self.byte_ids[b] for b in reversed(text[end - 1].replace(_OUTSIDE, MARK).encode()))
            end = begins[end]
        found.reverse()
        return found

    def _spelled(self, text: str) -> str:
        return text.replace(MARK, _OUTSIDE).replace(" ", MARK)

    def _word(self, word: str) -> bytes:
        """The ids of a word with its mark. It is cut where no piece has the two neighbours, as no path spans that
        place; so a word is searched once, whatever punctuation it meets."""
        marked = MARK + self._spelled(word)
        if word.isalnum():
            return np.array(self.path(marked), np.int32).tobytes()
        cuts = [at for at, pair in enumerate(zip(marked, marked[1:]), 1) if pair not in self.pairs]
        if not cuts:
            return np.array(self.path(marked), np.int32).tobytes()
        out = []
        for a, b in zip([0, *cuts], [*cuts, len(marked)]):
            part = marked[a:b]
            place, key = (self.tails, part) if a else (self.kept, word[: b - 1])
            ids = place.get(key)
            if ids is None:
                ids = np.array(self.path(part), np.int32).tobytes()
                if len(place) < self.cache:
                    place[key] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if not self.by_word or _OUTSIDE in text:
            return np.array(self._plain(text), np.int32)
        kept = self.kept
        words = text.split(" ")
        if "" in words:
            words = [w[1:] for w in _RUNS.findall(f" {text}")]
        found = list(map(kept.get, words))
        if None in found:
            for at, word in enumerate(words):
                if found[at] is None:
                    ids = found[at] = kept.get(word) or self._word(word)
                    if len(kept) < self.cache:
                        kept[word] = ids
        return np.frombuffer(b"".join(found), np.int32)

    def _plain(self, text: str) -> list[int]:
        """Without a cache; the private character that stands for a U+2581 may be in the text."""
        if _OUTSIDE not in text:
            return list(self.path(MARK + self._spelled(text)))
        out: list[int] = []
        for k, part in enumerate(text.split(_OUTSIDE)):
            if k:
                out.extend(self.byte_ids[b] for b in _OUTSIDE.encode())
            marked = (MARK if not k else "") + self._spelled(part)
            out.extend(self.path(marked))
        return out

    def decode(self, ids: Sequence[int]) -> str:
        text = b"".join([self.spelled[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def load(path: str) -> Pieces:
    """The pieces of a model file, once per process."""
    if path not in _known:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        special = frozenset(i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))
        _known[path] = Pieces([model.id_to_piece(i) for i in range(n)], [model.get_score(i) for i in range(n)], special)
    return _known[path]


def _free(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def encoded(docs: DataFrame, model: str, column: str = "text") -> DataFrame:
    """``docs`` without ``column``, with ``piece_ids`` instead, row by row."""
    ship(docs.sparkSession)
    place = docs.columns.index(column)
    rest = [f for f in docs.schema.fields if f.name != column]
    name = _free(docs, "piece_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = [own.encode(t) for t in part.column(place).to_pylist()]
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                others = [part.column(i) for i in range(part.num_columns) if i != place]
                yield pa.RecordBatch.from_arrays([*others, lists], names=[*(f.name for f in rest), name])

    return docs.mapInArrow(run, T.StructType([*rest, T.StructField(name, T.ArrayType(T.IntegerType()))]))


def decoded(rows: DataFrame, model: str, column: str = "piece_ids", name: str = "text") -> DataFrame:
    """``rows`` with the text of ``column`` as ``name``; null ids are the empty text."""
    ship(rows.sparkSession)
    place, name = rows.columns.index(column), _free(rows, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [own.decode(x or ()) for x in part.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())]))


def checked(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, piece_ids, exact of ``docs`` (doc_id, text): the ids, and whether decoding them gives the text back.

    Encoding and decoding are one pass over the texts.
    """
    ship(docs.sparkSession)
    names = ["doc_id", "n_pieces", "piece_ids", "exact"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(1).to_pylist()
                ids = [own.encode(t) for t in texts]
                exact = [own.decode(x.tolist()) == (t or "") for x, t in zip(ids, texts, strict=True)]
                counts = np.array([len(x) for x in ids], np.int64)
                bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts), lists, pa.array(exact)], names=names)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id long, n_pieces long, piece_ids array<int>, exact boolean")
