"""Byte-level BPE of whole texts through a cache of words.

The pre-tokenizer of a byte-level BPE never joins what stands on both sides of a single space
between two characters that are not white space: the space belongs to what follows. A text cut
there is encoded piece by piece with the same ids, and most pieces were seen before.
"""

from __future__ import annotations

import re

import numpy as np
from tokenizers import Tokenizer

CACHE = 700_000
_MARKS = ".,;:!?"
_SPACE = re.compile(r"\s")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_known: dict[str, WordEncoder] = {}


class _Known(dict):
    """Ids of pieces. A piece that is not kept stands for itself and is noted in ``new``."""

    def __init__(self) -> None:
        super().__init__()
        self.new: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> str:
        self.new[piece] = b""
        return piece


class WordEncoder:
    def __init__(self, path: str, cache: int = CACHE):
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.cache = cache
        self.words, self.heads = _Known(), _Known()
        self.line_end = self._encode(["\n"])[0]

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def _by_lines(self, pieces: list[str], lead: str) -> dict[str, bytes]:
        """Ids of ``lead + piece`` for pieces without white space, encoded together as lines."""
        out: dict[str, bytes] = {}
        mark = np.frombuffer(self.line_end, self.kind)
        size = mark.itemsize
        for at in range(0, len(pieces), 4000):
            part = pieces[at : at + 4000]
            text = lead + ("\n" + lead).join(part)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(ids == mark[0])
            if len(mark) == 1 and len(ends) == len(part) - 1:
                flat, starts = ids.tobytes(), [0, *((ends + 1) * size).tolist()]
                stops = [*(ends * size).tolist(), len(flat)]
                out.update((p, flat[b:e]) for p, b, e in zip(part, starts, stops, strict=True))
            else:
                out.update(zip(part, self._encode([lead + p for p in part]), strict=True))
        return out

    def _learn(self, known: _Known, lead: str) -> dict[str, bytes]:
        """Ids of the pieces noted in ``known.new``; kept, as far as there is room.

        Letters with one mark behind them are two pre-tokens, so only the letters are encoded.
        """
        plain, bare, odd = [], {}, []
        for p in known.new:
            if p.isalpha():
                plain.append(p)
            elif p[-1:] in _MARKS and p[:-1].isalpha():
                bare[p] = p[:-1]
            elif p and not _SPACE.search(p):
                plain.append(p)
            else:
                odd.append(p)
        plain.extend({w for w in bare.values() if w not in known and w not in known.new})
        fresh = self._by_lines(plain, lead)
        fresh.update(zip(odd, self._encode([lead + p for p in odd]), strict=True))
        marks = dict(zip(_MARKS, self._encode(list(_MARKS)), strict=True))
        for p, w in bare.items():
            fresh[p] = (fresh[w] if w in fresh else dict.__getitem__(known, w)) + marks[p[-1]]
        room = self.cache - len(known)
        if room > 0:
            known.update(fresh if room >= len(fresh) else list(fresh.items())[:room])
        known.new = {}
        return fresh

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned integers of ``kind``; null is empty."""
        heads, words, firsts, rests = self.heads, self.words, [], []
        recut: list[int] = []
        for i, text in enumerate(texts):
            parts = (text or "").split(" ")
            firsts.append(heads[parts[0]])
            del parts[0]
            rests.append(list(map(words.__getitem__, parts)))
        # A piece that is empty or has white space at its edge did not come from a safe cut.
        edge = lambda p: not p or p[0].isspace() or p[-1].isspace()
        wrong = {p for p in words.new if edge(p)}
        if wrong or any(p and p[-1].isspace() for p in heads.new):
            recut = [i for i, x in enumerate(rests) if not wrong.isdisjoint(x) or x and texts[i].split(" ", 1)[0][-1:].isspace()]
            for p in wrong:
                del words.new[p]
            for i in recut:
                first, *parts = _CUT.split(texts[i])
                firsts[i], rests[i] = heads[first], list(map(words.__getitem__, parts))
        head_ids, word_ids = self._learn(heads, ""), self._learn(words, " ")
        return [
            (f if f.__class__ is bytes else head_ids[f]) + b"".join([x if x.__class__ is bytes else word_ids[x] for x in rest])
            for f, rest in zip(firsts, rests, strict=True)
        ]


def encoder(path: str) -> WordEncoder:
    """The encoder of this process."""
    if path not in _known:
        _known[path] = WordEncoder(path)
    return _known[path]
