"""Burrows-Wheeler transforms of small shards of strings, merged by refining their interleave.

A symbol is a block of ``BLOCK`` bytes: before the suffix that starts at p stands the block that
starts at p - BLOCK.  The last BLOCK places of each string begin no whole block; each of them counts
as a symbol of its own, after all others.  Merging never sorts suffixes again: it starts with the
shards one after another, and each round deals the order out by the symbol before each suffix.  After
k rounds suffixes stand in order of their first k symbols, and rows that round k separates share a
prefix of k - 1 symbols, so after ``length / BLOCK`` rounds every range of more than one row is a string of
``length`` bytes that begins at more than one place.
"""

from __future__ import annotations

import numpy as np

BLOCK = 8
#: Rows of a shard, so that ranks fit in 16 bits, whose sorts take linear time.
SHARD = 60_000


def _by_symbol(symbols: np.ndarray, most: int) -> np.ndarray:
    """Stable order of symbols below most, by radix sorts of 16 bits."""
    order = np.argsort((symbols & 0xFFFF).astype(np.uint16), kind="stable")
    if most > 1 << 16:
        order = order[np.argsort((symbols >> 16).astype(np.uint16)[order], kind="stable")]
    return order


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a shard by doubling.  symbols: number of the block at each place; those of short places are unique
    in it and the largest, and nothing is compared past them."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1]
    k = BLOCK
    while True:
        after = np.zeros(n, np.uint16)
        after[:-k] = rank[k:]
        order = np.argsort(after, kind="stable")
        order = order[np.argsort(rank.astype(np.uint16)[order], kind="stable")]
        one, two = rank[order], after[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
        if rank[order[-1]] == n - 1 or k >= n // 2:
            return order
        k *= 2


def merge(shards: list[np.ndarray], ends: list[int], most: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' transforms and the range of every row, after some rounds or as soon as no range has two rows.

    A transform has ``most`` where no block stands before a suffix; ends: how many rows of that kind each shard has.  A row's place
    in its shard is its rank among the rows of that shard.
    """
    n, m = sum(map(len, shards)), sum(ends)
    symbols = np.concatenate(shards)
    z = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(x) for x in shards])
    last = np.repeat(np.arange(len(shards), dtype=np.uint8), ends)
    part, before = np.zeros(n, np.int32), np.empty(n, symbols.dtype)
    new = np.ones(n, bool)
    for _ in range(rounds):
        before[np.argsort(z, kind="stable")] = symbols
        order = _by_symbol(before, most + 1)[: n - m]
        symbol, was = before[order], part[order]
        np.not_equal(symbol[1:], symbol[:-1], out=new[1 : n - m])
        new[1 : n - m] |= was[1:] != was[:-1]
        z = np.concatenate([z[order], last])
        part = np.cumsum(new, dtype=np.int32)
        if part[-1] == n:
            break
    return z, part


def repeated(strings: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(string, begin, end): maximal runs of begins of ``length``-byte strings that occur at more than one place among all strings.
    Every string has ``length`` bytes at least, a multiple of BLOCK; a shard holds at least one."""
    size = np.array([len(s) + 1 for s in strings])
    data = np.frombuffer(b"\0".join(strings) + b"\0" * (BLOCK + 1), np.uint8)
    begin, n = np.cumsum(size) - size, int(size.sum())
    value = np.zeros(n, np.uint64)
    for k in range(BLOCK):
        value |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    owner = np.repeat(np.arange(len(strings)), size)
    place = np.arange(n) - begin[owner]
    short = place > size[owner] - 1 - BLOCK
    kinds, block = np.unique(value, return_inverse=True)
    most = len(kinds)
    symbol = np.where(short, most + 1 + np.arange(n), block)
    before = np.where(place < BLOCK, most, np.concatenate([np.zeros(BLOCK, np.int64), block[:-BLOCK]])).astype(np.int32)
    cut = np.unique(np.searchsorted(begin, np.arange(0, n, SHARD // 2), "left"))
    cut = [*cut[cut < len(strings)].tolist(), len(strings)]
    shards, orders, ends = [], [], []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        at = slice(begin[a], begin[b - 1] + size[b - 1])
        orders.append(suffix_order(symbol[at]) + begin[a])
        shards.append(before[orders[-1]])
        ends.append(BLOCK * (b - a))
    z, part = merge(shards, ends, most, length // BLOCK)
    at = np.empty(n, np.int64)
    at[np.argsort(z, kind="stable")] = np.concatenate(orders)
    many = np.sort(at[np.bincount(part)[part] > 1])
    if not len(many):
        return []
    first = np.flatnonzero(np.concatenate([[True], (many[1:] != many[:-1] + 1) | (owner[many[1:]] != owner[many[:-1]])]))
    final = np.append(first[1:], len(many)) - 1
    a, b = many[first], many[final]
    return list(zip(owner[a].tolist(), place[a].tolist(), (place[b] + 1).tolist(), strict=True))
