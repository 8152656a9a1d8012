"""Words of whole texts as 64-bit hashes, a block of Arrow rows at a time.

Words are runs of bytes other than ASCII white space, so a block is cut with a few passes of
numpy over its bytes. A text longer than ``BLOCK`` is cut at white space into several passes;
memory holds one block and eight bytes per word of one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(name: str, base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... (mod 2^64), n of them."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK + 64), base, np.uint64)
        steps[0] = 1
        have = _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def _hash_block(data: np.ndarray, starts: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``data``, and how many words begin before each of ``starts``.

    ``starts`` are the places at which texts begin; a word ends there at the latest.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[starts[starts <= n]] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    begin = np.flatnonzero(word & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    values = (_LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * _table("up", _BASE, n), out=sums[1:])
    down = _table("down", pow(_BASE, -1, 1 << 64), n)
    raw = (sums[end] - sums[begin]) * down[begin]
    return mix(raw + (end - begin).astype(np.uint64)), np.searchsorted(begin, starts)


def _long(data: np.ndarray, lower: bool) -> np.ndarray:
    """Hashes of the words of one long text, a piece after the other."""
    out, at = [], 0
    while at < len(data):
        to = min(at + BLOCK, len(data))
        if to < len(data):
            spaces = np.flatnonzero(_SPACE[data[at:to]])
            if len(spaces):
                to = at + int(spaces[-1]) + 1
            else:
                step = BLOCK
                while to < len(data) and not _SPACE[data[to]].any():
                    more = np.flatnonzero(_SPACE[data[to : to + step]])
                    to = to + int(more[0]) if len(more) else min(to + step, len(data))
        out.append(_hash_block(data[at:to], np.zeros(1, np.int64), lower)[0])
        at = to
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def raw_texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def hashed_words(column: pa.Array, lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word offsets, hashes) for consecutive rows; text i has hashes[offsets[i]:offsets[i + 1]]."""
    data, at = raw_texts(column)
    row, n = 0, len(at) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(at, at[row] + BLOCK, side="right")) - 1)
        part = data[at[row] : at[last]]
        if last == row + 1 and len(part) > BLOCK:
            hashes = _long(part, lower)
            yield row, np.array([0, len(hashes)]), hashes
        else:
            hashes, offsets = _hash_block(part, at[row : last + 1] - at[row], lower)
            offsets[-1] = len(hashes)
            yield row, offsets, hashes
        row = last


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes, ascending, of every k consecutive words; of all words, if fewer."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    width = min(k, n)
    out = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        out = mix(out * np.uint64(_BASE) + words[j : n - width + 1 + j])
    return np.unique(out)
