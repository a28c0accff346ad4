"""Ranked search by an inverted index of shards, whose posting lists are cut into blocks of variable length.

A shard is a run of documents of one input partition, about SHARD bytes of text; texts are never shuffled.  A posting is a document's
number in its shard and its impact, what one occurrence in a question is worth but for the term's weight.  Dynamic programming cuts each
list where the bounds err least: the sum over blocks of (length times greatest impact less the sum of impacts) plus COST a block.

A question is put to every shard.  Block ends part the shard's documents into intervals, within which the sum of the blocks' bounds, each
times its term's weight, is one number.  As in WAND, only where that sum reaches the lowest of the k best scores so far can a document
enter: these pivots are taken from the highest bound down, all postings of their intervals are scored, the threshold rises, and what
stays below it is skipped, block by block, without being read.  Nothing is approximate, and equal scores count as long as their doc_id
may decide.  Questions meet shards in blocks of about ASKED terms; each shard returns k documents a question.

Null texts and texts without terms are no documents and match nothing; they have no score.  Very long texts are a shard of their own.
Of equal scores the smaller doc_id comes first, null after all others; repeated rows are documents of their own, and repeated questions
are each answered.  Empty tables give an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outrate.llm.common import LOWER_BYTES, table
from outrate.llm.shingles import buffers, groups, word_bounds

#: Bytes of text in a shard.
SHARD = 16 << 20
#: What a block costs against a sum of errors in impacts, and how many postings it holds at most.
COST, WIDEST = 1_000_000, 64
#: Terms of questions that go through a shard together.
ASKED = 1 << 16
#: Documents that are scored in the first step, at least; each next one takes twice as many.
FIRST = 64

_OUTSIDE = np.ones(256, bool)
_OUTSIDE[128:] = _OUTSIDE[48:58] = _OUTSIDE[65:91] = _OUTSIDE[97:123] = False
_NONE = np.iinfo(np.int64).max


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of some texts one after the other, and the number of terms before each text."""
    data = np.frombuffer(data.tobytes().translate(LOWER_BYTES), np.uint8)
    begin, end, first = word_bounds(data, offsets, _OUTSIDE)
    at = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(end - begin, out=at[1:])
    found = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(at), pa.py_buffer(data[~_OUTSIDE[data]].tobytes()))
    return found.dictionary_encode(), first


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs, every = 0, 0
    for b in batches:
        data, offsets = buffers(b["text"])
        for x, y in groups(offsets):
            _, _, first = word_bounds(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], _OUTSIDE)
            docs, every = docs + int((np.diff(first) > 0).sum()), every + int(first[-1])
    yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([every])], names=["docs", "terms"])


class Size(NamedTuple):
    """Documents with a term, and all their terms."""

    docs: int
    terms: int


def measure(docs: DataFrame) -> Size:
    r = docs.select("text").mapInArrow(_counted, "docs long, terms long").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    return Size(int(r.docs or 0), int(r.terms or 0))


def cut_blocks(lists: np.ndarray, impacts: np.ndarray, cost: int = COST, widest: int = WIDEST) -> np.ndarray:
    """Where blocks end, as numbers of postings, for all lists at once: lists has the n + 1 numbers of postings before each.

    The best cost of a list's first i postings is the least, over the last block's length, of the best of what is before it plus that
    block's.  All lists take step i together, the longest first, so that those still under way stand in a row."""
    size = np.diff(lists)
    order = np.argsort(-size, kind="stable")
    size, begin = size[order], lists[:-1][order]
    place = np.cumsum(size + 1) - size - 1
    best, back = np.zeros(int((size + 1).sum()), np.int64), np.zeros(int((size + 1).sum()), np.int32)
    for i in range(1, int(size[0]) + 1 if len(size) else 1):
        some = int(np.searchsorted(-size, -i, "right"))
        reach = min(i, widest)
        step = np.arange(1, reach + 1)
        greatest = np.maximum.accumulate(impacts[(begin[:some] + i)[:, None] - step], axis=1)
        total = best[(place[:some] + i)[:, None] - step] + greatest * step + cost
        chosen = total.argmin(axis=1)
        best[place[:some] + i], back[place[:some] + i] = total[np.arange(some), chosen], step[chosen]
    ends, left, alive = [], size.copy(), np.arange(len(size))
    while len(alive):
        alive = alive[left[alive] > 0]
        ends.append(begin[alive] + left[alive])
        left[alive] -= back[place[alive] + left[alive]]
    return np.sort(np.concatenate([np.zeros(0, np.int64), *ends]))


_INDEX = "shard long, term string, df long, docs binary, impacts binary, ends binary, bounds binary"


class _Shard:
    """What is read of a shard's documents before they are indexed."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.parts: list[tuple[pa.DictionaryArray, np.ndarray]] = []
        self.bytes = 0

    def add(self, ids: list[int | None], data: np.ndarray, offsets: np.ndarray) -> None:
        terms, first = _terms(data, offsets)
        count = np.diff(first)
        self.ids += [i for i, n in zip(ids, count.tolist(), strict=True) if n]
        self.parts.append((terms, count[count > 0]))
        self.bytes += len(data)

    def index(self, shard: int, size: Size) -> tuple[pa.RecordBatch, pa.RecordBatch]:
        """The shard's documents in order of their ids, and its posting lists."""
        every = pa.chunked_array([t for t, _ in self.parts]).unify_dictionaries()
        code = np.concatenate([c.indices.to_numpy() for c in every.chunks]).astype(np.int64)
        words = every.chunk(0).dictionary
        count = np.concatenate([n for _, n in self.parts])
        ids = np.array([_NONE if i is None else i for i in self.ids], np.int64)
        order = np.argsort(ids, kind="stable")
        number = np.empty(len(ids), np.int64)
        number[order] = np.arange(len(ids))
        ids, doc = ids[order], np.repeat(number, count)
        norm = np.array([25 + 75 * n * size.docs // size.terms for n in count[order].tolist()], np.int64)
        posting, tf = np.unique(code * len(ids) + doc, return_counts=True)
        code, doc = posting // len(ids), posting % len(ids)
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * norm[doc])
        lists = np.searchsorted(code, np.arange(len(words) + 1))
        ends = cut_blocks(lists, impact)
        first = np.concatenate([[0], ends[:-1]])
        bounds = np.maximum.reduceat(impact, first)
        block = np.searchsorted(ends, lists)
        block[1:] = np.searchsorted(ends, lists[1:], "right")
        d, i = doc.astype("<i4"), impact.astype("<i4")
        last, bound = (ends - np.repeat(lists[:-1], np.diff(block))).astype("<i4"), bounds.astype("<i4")

        def packed(x: np.ndarray, at: np.ndarray) -> pa.Array:
            return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((4 * at).astype(np.int64)), pa.py_buffer(x.tobytes())]).cast(pa.binary())

        n = len(words)
        rows = pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), words.cast(pa.string()), pa.array(np.diff(lists)), packed(d, lists), packed(i, lists), packed(last, block), packed(bound, block)], names=["shard", "term", "df", "docs", "impacts", "ends", "bounds"])
        known = pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([None], pa.string()), pa.array([len(ids)]), pa.array([ids.astype("<i8").tobytes()]), *(pa.array([b""]) for _ in range(3))], names=rows.schema.names)
        return known, rows


def index(docs: DataFrame, size: Size | None = None) -> DataFrame:
    """The index as a written table: a row for each shard and term (shard, term, df, and packed: numbers of documents, impacts, block ends,
    block bounds), and one for each shard without a term, which has the doc_ids of its documents."""
    size = size or measure(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own = TaskContext.get().partitionId() << 32, _Shard()
        for b in batches:
            ids = b["doc_id"].cast(pa.int64()).to_pylist()
            data, offsets = buffers(b["text"])
            for x, y in groups(offsets):
                if own.ids and own.bytes + offsets[y] - offsets[x] > SHARD:
                    yield from _sliced(own.index(shard, size))
                    shard, own = shard + 1, _Shard()
                own.add(ids[x:y], data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
        if own.ids:
            yield from _sliced(own.index(shard, size))

    return table(docs.select("doc_id", "text").mapInArrow(run, _INDEX), "inverted-index")


def _sliced(made: tuple[pa.RecordBatch, pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, rows = made
    yield known
    for k in range(0, rows.num_rows, 20_000):
        yield rows.slice(k, 20_000)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key = TaskContext.get().partitionId() << 36
    for b in batches:
        data, offsets = buffers(b["text"])
        for x, y in groups(offsets):
            terms, first = _terms(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
            n, wide = y - x, max(1, len(terms.dictionary))
            found, times = np.unique(np.repeat(np.arange(n), np.diff(first)) * wide + terms.indices.to_numpy().astype(np.int64), return_counts=True)
            row = found // wide
            yield pa.RecordBatch.from_arrays([pa.array(key + x + row), b["item_id"].cast(pa.int64()).take(pa.array(x + row)), terms.dictionary.take(pa.array(found % wide)).cast(pa.string()), pa.array(times)], names=["key", "item_id", "term", "times"])
        key += b.num_rows


class Lists(NamedTuple):
    docs: np.ndarray
    impacts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def best(lists: list[Lists], weights: list[int], n: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Numbers and scores of the k best of n documents, highest first, then the smaller number; and how many postings were read."""
    rise = np.zeros(n + 1, np.int64)
    edge = np.zeros(n + 1, bool)
    for t, w in zip(lists, weights, strict=True):
        first = t.docs[np.concatenate([[0], t.ends[:-1]])]
        after = t.docs[t.ends - 1] + 1
        rise[first] += w * t.bounds
        rise[after] -= w * t.bounds
        edge[first] = edge[after] = True
    low = np.flatnonzero(edge)
    bound = np.cumsum(rise)[low[:-1]]
    high, low = low[1:], low[:-1]
    order = np.argsort(-bound, kind="stable")
    order = order[bound[order] > 0]
    score, seen, least, at, step, read = np.zeros(n, np.int64), [], 1, 0, FIRST, 0
    width = np.cumsum((high - low)[order])
    while at < len(order) and bound[order[at]] >= least:
        to = int(np.searchsorted(width, (width[at - 1] if at else 0) + step, "left")) + 1
        some = np.sort(order[at:to][bound[order[at:to]] >= least])
        at, step = to, 2 * step
        a, b = low[some], high[some]
        for t, w in zip(lists, weights, strict=True):
            x, y = np.searchsorted(t.docs, a), np.searchsorted(t.docs, b)
            size = y - x
            total = np.cumsum(size)
            if total[-1]:
                p = np.repeat(x - total + size, size) + np.arange(total[-1])
                score[t.docs[p]] += w * t.impacts[p]
                read += int(total[-1])
        size = b - a
        seen.append(np.repeat(a - np.cumsum(size) + size, size) + np.arange(int(size.sum())))
        found = np.concatenate(seen)
        found = found[score[found] >= least]
        if len(found) > k:
            found = found[np.lexsort((found, -score[found]))[:k]]
        seen = [found]
        if len(found) == k:
            least = max(least, int(score[found].min()))
    found = np.concatenate([np.zeros(0, np.int64), *seen])
    found = found[score[found] > 0]
    found = found[np.lexsort((found, -score[found]))]
    return found, score[found], read


_FOUND = pa.schema([("key", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _answers(postings: pa.Table, questions: pa.Table, k: int) -> pa.Table:
    """postings: one shard's lists of the terms asked for; questions: the rows (key, item_id, term, value) of one block."""
    out: list[tuple] = []
    terms = postings["term"].to_pylist()
    columns = [postings[c].to_pylist() for c in ("docs", "impacts", "ends", "bounds")]
    lists, ids = {}, None
    for i, term in enumerate(terms):
        if term is None:
            ids = np.frombuffer(columns[0][i], "<i8")
        else:
            lists[term] = Lists(*(np.frombuffer(c[i], "<i4").astype(np.int64) for c in columns))
    if ids is None or not questions.num_rows:
        return _FOUND.empty_table()
    questions = questions.sort_by("key")
    key, item = questions["key"].to_numpy(), questions["item_id"].to_pylist()
    words, value = questions["term"].to_pylist(), questions["value"].to_pylist()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist()
    for x, y in zip(first, [*first[1:], len(key)]):
        some = [i for i in range(x, y) if words[i] in lists and value[i] > 0]
        found, score, _ = best([lists[words[i]] for i in some], [value[i] for i in some], len(ids), k) if some else ([], [], 0)
        out += [(int(key[x]), item[x], None if ids[f] == _NONE else int(ids[f]), int(s)) for f, s in zip(found, score)]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _FOUND)], schema=_FOUND) if out else _FOUND.empty_table()


def search(found: DataFrame, items: DataFrame, docs: int, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the index with the highest scores for each item; docs: documents with a term."""
    asked = table(items.select("item_id", "text").mapInArrow(_asked, "key long, item_id long, term string, times long"), "asked")
    blocks = max(1, -(-asked.count() // ASKED))
    # Few terms are asked for; whether they go to all tasks is for Spark to tell from their size.
    lists = found.where("term IS NOT NULL").join(asked.select("term").distinct(), "term", "left_semi")
    weight = F.floor(1000 * F.log((2 * F.lit(docs) + 2).cast("double") / (2 * F.col("df") + 1))).cast("long")
    df = found.where("term IS NOT NULL").select("term", "df").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block")
    valued = table(asked.join(df, "term").select("key", "item_id", "term", (F.col("times") * weight).alias("value"), block), "valued")
    shards = found.where("term IS NULL")
    number = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")).alias("block")
    heads = shards.select("shard", number, "term", "docs", "impacts", "ends", "bounds")
    if blocks > 1:
        lists = lists.join(valued.select("term", "block").distinct(), "term")
    else:
        lists = lists.withColumn("block", F.lit(0).cast("long"))
    one = heads.unionByName(lists.select("shard", "block", "term", "docs", "impacts", "ends", "bounds"))
    two = shards.select("shard", number).join(valued, "block").withColumnsRenamed({"shard": "at", "block": "part"})

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        return _answers(a, b, k)

    near = one.groupBy("shard", "block").cogroup(two.groupBy("at", "part")).applyInArrow(run, "key long, item_id long, doc_id long, score long")
    w = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    size = measure(docs)
    return search(index(docs, size), items, size.docs, k)
