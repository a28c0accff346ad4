"""Training sequences of related documents: windows filled by BM25 neighbours from a sharded inverted index.

1. Texts become token ids where they lie; the document frequency of every id is counted over all documents.
2. Documents are put into one order in which those with common rare ids stand together: by LEVELS MinHash values of their ids, each
   id weighted by its inverse document frequency.  So the share of weight that two documents have in common is the chance that they
   agree in a level, at any size of the corpus; equal documents always stand together.
3. This order is cut into shards of about SHARD bytes of ids.  A shard holds an inverted index of its documents with BM25 weights by
   the global frequencies.  The first unused document seeds a window, its best-scored unused neighbours by all of its ids follow until
   the window is full, then the next unused ones.  A document that does not fit is cut, and its rest seeds the next window.  So only
   a shard's last sequence is not full; it is padded to the next power of two.

Null and empty text: only the end id.  A long text takes many windows.  Rows of one doc_id or without one are documents of their own;
equal rows each come back.  Ties: the earlier row.  An empty table gives an empty result; extra columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outrate.llm.common import batch, table
from outrate.llm.shingles import mix
from outrate.llm.tokens import encoder

#: Ids in a window, and bytes of ids in a shard: what one index covers, so also what a task holds.
WINDOW, SHARD = 2048, 2 << 20
#: Shards in a partition, at least; and the most partitions (each is read as a stream).
RUN, PARTITIONS = 8, 20_000
#: BM25's parameters.
K1, B = 1.2, 0.75

TOKENS = "doc_id long, n long, ids binary, counts binary"
_tokens = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])
SHARDS = "shard long, doc_ids array<long>, lengths array<int>, ids binary"
_shards = pa.schema([("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("ids", pa.binary())])
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"
_pieces = pa.schema([(x.split()[0], pa.int64()) for x in PIECES.split(", ")])


def _terms(ids: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) in order of document, then term."""
    key = np.repeat(np.arange(len(lengths), dtype=np.int64) * size, lengths) + ids
    key, count = np.unique(key, return_counts=True)
    return key // size, key % size, count


def _tokenized(path: str, end_id: int):
    """A row for each document, and at the end one with the document frequencies of the partition (n is null there)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        total = np.zeros(code.size, np.int64)
        for b in batches:
            ids, n = code.with_end(b["text"], end_id)
            total += np.bincount(_terms(ids, n, code.size)[1], minlength=code.size)
            at = np.concatenate([[0], np.cumsum(n)]) * code.type.itemsize
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
            yield batch(_tokens, doc_id=b["doc_id"], n=pa.array(n), ids=raw, counts=pa.nulls(len(n), pa.binary()))
        some = np.flatnonzero(total)
        yield batch(_tokens, doc_id=[None], n=[None], ids=[None], counts=[np.stack([some, total[some]]).tobytes()])

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for counts in b["counts"]:
            term, n = np.frombuffer(counts.as_buffer(), np.int64).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int32)), pa.array(n)], names=["term", "n"])


def places(df: np.ndarray, idf: np.ndarray) -> list[np.ndarray]:
    """For each level the place of every id in an order drawn at random by weight; a document's value is its ids' least place."""
    bits = max(1, int(len(df) - 1).bit_length())
    weight = np.where(df > 1, np.maximum(idf, 1e-9), 1e-12)  # what only one document has tells nothing
    out = []
    for level in range(63 // bits):
        u = (mix(np.arange(len(df), dtype=np.uint64) + np.uint64((level + 1) << 32)).astype(np.float64) + 1) / 2.0**64
        place = np.empty(len(df), np.int64)
        place[np.argsort(-np.log(u) / weight, kind="stable")] = np.arange(len(df))
        out.append(place)
    return out


def _labelled(order: list[np.ndarray], kind: np.dtype):
    bits = max(1, int(len(order[0]) - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b["n"].to_numpy()
            ids, label = np.frombuffer(b"".join(x.as_buffer() for x in b["ids"]), kind), np.zeros(len(n), np.int64)
            if len(n):  # every document has its end id
                first = np.cumsum(n) - n
                for place in order:
                    label = (label << bits) | np.minimum.reduceat(place[ids], first)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["n"], b["ids"], pa.array(label)], names=["doc_id", "n", "ids", "label"])

    return run


def _cut(kind: np.dtype):
    """Rows in order: one row for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, docs, sizes, ids, held = TaskContext.get().partitionId() << 24, [], [], [], 0
        for b in batches:
            for doc, n, x in zip(b["doc_id"].to_pylist(), b["n"].to_pylist(), b["ids"], strict=True):
                docs.append(doc)
                sizes.append(n)
                ids.append(x.as_buffer())
                held += n * kind.itemsize
                if held >= SHARD:
                    yield batch(_shards, shard=[shard], doc_ids=[docs], lengths=[sizes], ids=[b"".join(ids)])
                    shard, docs, sizes, ids, held = shard + 1, [], [], [], 0
        if docs:
            yield batch(_shards, shard=[shard], doc_ids=[docs], lengths=[sizes], ids=[b"".join(ids)])

    return run


class Index:
    """Inverted index of a shard with BM25 weights.  Documents that are used go out of it, a quarter of the rest at a time."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, idf: np.ndarray, mean: float):
        doc, term, count = _terms(ids, lengths, len(idf))
        weight = idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * lengths[doc] / mean))
        self.n, self.size, self.unused = len(lengths), len(idf), np.ones(len(lengths), bool)
        self.first = np.searchsorted(doc, np.arange(self.n + 1))
        self.term = term.astype(np.int32)
        by = np.argsort(self.term, kind="stable")
        self.by, self.docs, self.weights = self.term[by], doc[by].astype(np.int32), weight[by]
        self.left = self.kept = self.n
        self._places()

    def _places(self) -> None:
        self.begin = np.searchsorted(self.by, np.arange(self.size + 1, dtype=np.int32))

    def use(self, doc: int) -> None:
        self.unused[doc] = False
        self.left -= 1
        if self.left < 0.75 * self.kept:
            stay = self.unused[self.docs]
            self.by, self.docs, self.weights = self.by[stay], self.docs[stay], self.weights[stay]
            self.kept = self.left
            self._places()

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused documents that share an id with the seed, the best first; ties: the earlier."""
        terms = self.term[self.first[seed] : self.first[seed + 1]]
        a, n = self.begin[terms], self.begin[terms + 1] - self.begin[terms]
        end = np.cumsum(n)
        at = np.repeat(a - end + n, n) + np.arange(end[-1] if len(end) else 0)
        score = np.bincount(self.docs[at], self.weights[at], self.n)
        score[~self.unused] = 0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def order(lengths: np.ndarray, index: Index) -> list[int]:
    """The shard's documents in the order in which they fill windows."""
    out: list[int] = []
    free, queue, at, next_one = 0, np.zeros(0, np.int64), 0, 0
    while len(out) < len(lengths):
        if free <= 0:  # a new window begins with the rest of the last document, or with a new seed
            rest = free < 0
            free = WINDOW - (-free % WINDOW) if free else WINDOW
            queue, at = (index.neighbours(out[-1]) if rest else queue[:0]), 0
        while at < len(queue) and not index.unused[queue[at]]:
            at += 1
        if at < len(queue):
            doc = int(queue[at])
        else:
            while not index.unused[next_one]:
                next_one += 1
            doc = next_one
        index.use(doc)
        out.append(doc)
        free -= int(lengths[doc])
        if free > 0 and at >= len(queue):
            queue, at = index.neighbours(doc), 0
    return out


def _packed(idf: np.ndarray, mean: float, kind: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                docs, lengths = b["doc_ids"][i].as_py(), b["lengths"][i].values.to_numpy().astype(np.int64)
                ids = np.frombuffer(b["ids"][i].as_buffer(), kind)
                begin = np.cumsum(lengths) - lengths
                wide, rows, place, shard = ids.astype("<u4"), [], 0, b["shard"][i].as_py() << 24
                for d in order(lengths, Index(ids, lengths, idf, mean)):
                    start, n, at = 0, int(lengths[d]), int(begin[d])
                    while start < n:
                        size = min(n - start, WINDOW - place % WINDOW)
                        rows.append((docs[d], start, size, zlib.crc32(wide[at + start : at + start + size]), n, shard + place // WINDOW, place % WINDOW))
                        start, place = start + size, place + size
                rest = place % WINDOW
                tail = 1 << (rest - 1).bit_length() if rest else WINDOW
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                last = columns[5].to_numpy() == shard + (place - 1) // WINDOW
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.where(last, tail, WINDOW))], schema=_pieces)

    return run


def shards(docs: DataFrame, tokenizer: str, end_id: int) -> tuple[DataFrame, np.ndarray, float]:
    """The documents' ids in shards (shard, doc_ids, lengths, ids), the inverse document frequency of each id, and the mean length."""
    code = encoder(tokenizer)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    every = table(docs.mapInArrow(_tokenized(tokenizer, end_id), TOKENS), "tokens")
    total = every.where("n IS NOT NULL").agg(F.count("*").alias("docs"), F.sum("n").alias("ids")).first()
    df = np.zeros(code.size)
    for r in every.where("n IS NULL").select("counts").mapInArrow(_frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r.term] = r.n  # as many rows as the vocabulary at most
    idf = np.log1p((total.docs - df + 0.5) / (df + 0.5))
    parts = min(PARTITIONS, max(1, math.ceil((total.ids or 0) * code.type.itemsize / (RUN * SHARD))))
    rows = every.where("n IS NOT NULL").select("doc_id", "n", "ids").mapInArrow(_labelled(places(df, idf), code.type), "doc_id long, n long, ids binary, label long")
    # The salt deals out a hot group of copies; bounds are drawn from labels and salts.
    rows = rows.withColumn("salt", F.xxhash64("doc_id")).repartitionByRange(parts, "label", "salt").sortWithinPartitions("label", "salt", "n", F.crc32("ids"))
    return table(rows.select("doc_id", "n", "ids").mapInArrow(_cut(code.type), SHARDS), "shards"), idf, (total.ids or 1) / max(1, total.docs)


def pack(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """docs (doc_id, text) -> a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length."""
    found, idf, mean = shards(docs, tokenizer, end_id)
    return found.mapInArrow(_packed(idf, mean, encoder(tokenizer).type), PIECES)
