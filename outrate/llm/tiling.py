"""Benchmark passages in documents, found by greedy string tiling.

Words are runs of letters and digits in lower case.  Every run of five words of a benchmark item
is a seed.  Documents are scanned once against a bit set of all seeds, whose size is fixed; what it
lets through is joined with the seeds exactly.  For each pair of document and item that share a seed,
rolling Karp-Rabin hashes give all matches of five words and more; the longest is marked first, then
the longest that is left of the others, and so on, so no word counts twice and passages in another
order count in full.  A document is contaminated if tiles cover at least ``COVER`` percent of an item.

Items of fewer than five words, null and empty texts match nothing.  Very long texts are tiled whole.
Rows without doc_id are judged like others.  Repeated rows get the same verdict, named once; repeated
items count once.  Empty tables give an empty result.  Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outrate.llm.bits import among, bitset
from outrate.llm.common import table
from outrate.llm.shingles import buffers, fold, groups, word_bounds, word_hashes

SEED, COVER = 5, 50
#: Pairs of equal seeds of an item and a text that are looked at together.
AT_ONCE = 1 << 20

_other = np.ones(256, bool)
_other[128:] = False
_other[np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8)] = False


def tokens(texts: pa.Array) -> Iterator[np.ndarray]:
    """Hashes of each text's words."""
    data, offsets = buffers(pc.utf8_lower(texts))
    for a, b in groups(offsets):
        some, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        begin, end, first = word_bounds(some, at, _other)
        hashes = word_hashes(some, begin, end)
        yield from (hashes[i:j] for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True))


def tiles(item: np.ndarray, text: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """(length, begin in item, begin in text) of the greedy tiling, longest first; ties: the earlier in the item, then in the text."""
    one, two = fold(item, least), fold(text, least)
    if not len(one) or not len(two):
        return []
    order = np.argsort(one, kind="stable")
    lo, hi = np.searchsorted(one[order], two, "left"), np.searchsorted(one[order], two, "right")
    hits = np.flatnonzero(hi > lo)
    ahead, behind = np.append(one, np.uint64(0)), np.append(two, np.uint64(0))  # behind the last and, by index -1, before the first
    begins, ends = [], []
    if not len(hits):
        return []
    total = np.cumsum((hi - lo)[hits])
    cuts = np.unique(np.searchsorted(total, np.arange(0, int(total[-1]), AT_ONCE), "left"))
    for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(hits)], strict=True):
        some = hits[x:y]
        n = (hi - lo)[some]
        j = np.repeat(some, n)
        i = order[lo[j] + np.arange(len(j)) - np.repeat(np.cumsum(n) - n, n)]
        # only the ends of matches are kept, so a word that both texts repeat many times takes no more room than their lengths
        new = (i == 0) | (j == 0) | (ahead[i - 1] != behind[j - 1])
        last = (i == len(one) - 1) | (j == len(two) - 1) | (ahead[i + 1] != behind[j + 1])
        begins.append(np.stack([j - i, i])[:, new])
        ends.append(np.stack([j - i, i])[:, last])
    begin, end = (np.concatenate(x, axis=1) for x in (begins, ends))
    begin, end = (x[:, np.lexsort((x[1], x[0]))] for x in (begin, end))  # in order of diagonal, then place: a match's ends meet
    i, j = begin[1], begin[0] + begin[1]
    sizes = end[1] - begin[1] + least
    heap = list(zip((-sizes).tolist(), i.tolist(), j.tolist(), strict=True))
    heapq.heapify(heap)
    free_item, free_text, found = np.ones(len(item), bool), np.ones(len(text), bool), []
    while heap:
        n, a, b = heapq.heappop(heap)
        free = free_item[a : a - n] & free_text[b : b - n]
        if free.all():
            free_item[a : a - n] = free_text[b : b - n] = False
            found.append((-n, a, b))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]])))
        for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if y - x >= least:
                heapq.heappush(heap, (x - y, a + x, b + x))
    return found


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seeds = [np.unique(fold(x, SEED)).view(np.int64) for x in tokens(b["text"])]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*seeds, np.zeros(0, np.int64)])), pa.array(np.repeat(b["item"].to_numpy(), [len(x) for x in seeds]))], names=["seed", "item"])


def _scan(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, hits = [], []
            for r, x in enumerate(tokens(b["text"])):
                every = fold(x, SEED)
                at = among(bits, every)
                if len(at):
                    rows.append(r)
                    hits.append(np.unique(every[at]).view(np.int64))
            if rows:
                some = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([some["key"], some["doc_id"], some["text"], pa.array(hits, pa.list_(pa.int64()))], names=["key", "doc_id", "text", "hits"])

    return run


def _tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "doc_id", "item_id", "n_tiles", "longest", "covered", "item_words"]
    for b in batches:
        out = []
        for r, (item, text) in enumerate(zip(tokens(b["item_text"]), tokens(b["text"]), strict=True)):
            found = tiles(item, text)
            if found and 100 * sum(n for n, _, _ in found) >= COVER * len(item):
                out.append((r, len(found), found[0][0], sum(n for n, _, _ in found), len(item)))
        if out:
            r, *more = zip(*out, strict=True)
            some = b.take(pa.array(r))
            yield pa.RecordBatch.from_arrays([some["key"], some["doc_id"], some["item_id"], *(pa.array(x, pa.int64()) for x in more)], names=names)


def _key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id.cast("string"), text)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> key, doc_id, item_id, n_tiles, longest, covered, item_words; a row for
    each contaminated document and item."""
    docs = docs.select(_key(F.col("doc_id"), F.col("text")).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    items = table(items.withColumn("item", F.xxhash64(F.col("item_id").cast("string"), "text")), "items")
    seeds = table(items.mapInArrow(_seeds, "seed long, item long"), "seeds")
    bits = bitset(seeds, F.col("seed"))
    hits = table(docs.mapInArrow(_scan(bits), "key long, doc_id long, text string, hits array<long>"), "hits")
    pairs = hits.select("key", F.explode("hits").alias("seed")).join(seeds, "seed").select("key", "item").distinct()
    both = pairs.join(hits.select("key", "doc_id", "text").distinct(), "key").join(items.select("item", "item_id", F.col("text").alias("item_text")), "item")
    return both.mapInArrow(_tile, "key long, doc_id long, item_id long, n_tiles long, longest long, covered long, item_words long")


def keep(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated.  The verdicts are written first, so that Spark knows their size and broadcasts
    them only if they are small."""
    bad = table(contaminated(docs, benchmark).select(F.col("key").alias("__bad")).distinct(), "contaminated")
    return docs.join(bad, _key(docs["doc_id"], docs["text"]) == bad["__bad"], "left_anti")
