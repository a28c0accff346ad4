"""Hashes of words and of word shingles, for all texts of an Arrow batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from outrate.llm.common import LOWER_BYTES

WIDTH = 5
#: Bytes of text hashed together; a longer text is taken alone.
CHUNK = 1 << 19

_rng = np.random.default_rng(7)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_power: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    if base not in _power or len(_power[base]) < n:
        factors = np.full(max(n, CHUNK + 1), base, np.uint64)
        factors[0] = 1
        _power[base] = np.multiply.accumulate(factors)
    return _power[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets of texts in them; null: empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def groups(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about CHUNK bytes."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1)
        yield a, b
        a = b


def word_bounds(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and the number of words before each text (n + 1)."""
    full = ~blank[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], full[:-1]]) if len(full) else full
    after = np.concatenate([full[1:], [False]]) if len(full) else full
    begin = np.flatnonzero(full & (~before | edge[:-1]))
    end = np.flatnonzero(full & (~after | edge[1:])) + 1
    return begin, end, np.searchsorted(begin, offsets)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, n), out=total[1:])
    inverse = pow(_BASE, -1, 1 << 64)
    return mix((total[end] - total[begin]) * _powers(inverse, n + 1)[begin])


def fold(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` words in a row."""
    n = len(words) - width + 1
    out = np.full(max(n, 0), width, np.uint64)
    for k in range(width if n > 0 else 0):
        out = out * np.uint64(_BASE) + words[k : k + n]
    return mix(out)


def sequences(texts: pa.Array, lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each group of texts: number of its first text, word hashes, words before each text, begins, ends (bytes of the text's
    group), offsets of the texts in the group."""
    data, offsets = buffers(texts)
    if lower and len(data):
        data = np.frombuffer(data.tobytes().translate(LOWER_BYTES), np.uint8)
    for a, b in groups(offsets):
        some, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        begin, end, first = word_bounds(some, at)
        yield a, word_hashes(some, begin, end), first, begin, end, at


def sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text; with fewer than WIDTH words, one of all words."""
    for _, words, first, *_ in sequences(texts):
        every = fold(words, WIDTH)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= WIDTH:
                found = np.sort(every[a : b - WIDTH + 1])
                yield found[np.concatenate([[True], found[1:] != found[:-1]])]
            else:
                yield fold(words[a:b], b - a) if b > a else np.zeros(0, np.uint64)
