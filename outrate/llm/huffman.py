"""Token ids on disk: canonical Huffman codes of bounded length, in blocks that decode on their own.

A written folder holds two Parquet tables: ``codebook`` (id, length) and ``blocks``, in ascending
order of doc_id.  A block holds whole documents: their ids, their token counts, the bits of their
tokens (most significant first, in big-endian 32-bit words), and for every ``STEP`` tokens the number
of bits they take, from which the decoder knows where it may start.  Spark's committer writes both
under temporary names, so a lost executor leaves no half of a block.

Null text counts as empty and still has its end id.  Null doc_ids come first; rows of equal doc_id
are ordered by a hash of their text and stay separate.  A long text is a block of its own.  An empty
table gives empty tables.  Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outrate.llm.common import batch, table
from outrate.llm.tokens import encoder

LIMIT, STEP, BLOCK = 18, 128, 1 << 18

RAW = "shard int, block int, before long, doc_ids array<bigint>, lengths array<int>, ids binary"
CODED = "shard int, block int, before long, doc_ids array<bigint>, lengths array<int>, steps binary, bits binary"
_raw = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("ids", pa.binary())])
_coded = pa.schema([*list(_raw)[:5], pa.field("steps", pa.binary()), pa.field("bits", pa.binary())])
_out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code with no code over limit, by package-merge; 0 for absent ids."""
    out = np.zeros(len(counts), np.uint8)
    present = np.flatnonzero(counts)
    n = len(present)
    if n < 2:
        out[present] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} symbols don't fit in codes of {limit} bits")
    order = present[np.argsort(counts[present], kind="stable")]
    leaves = counts[order].astype(np.int64)
    masks, last = [], np.zeros(0, np.int64)
    for _ in range(limit):
        even = len(last) // 2 * 2
        both = np.concatenate([leaves, last[0:even:2] + last[1:even:2]])
        by = np.argsort(both, kind="stable")
        masks.append(by < n)
        last = both[by]
    take, lengths = 2 * n - 2, np.zeros(n, np.uint8)
    for mask in reversed(masks):
        k = int(mask[:take].sum())
        lengths[:k] += 1
        take = 2 * (take - k)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes, code, was = np.zeros(len(lengths), np.uint64), 0, 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)):
        if n := int(lengths[i]):
            code <<= n - was
            codes[i], was, code = code, n, code + 1
    return codes


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """For every window of ``limit`` bits, the id it begins with and its length: id << 8 | length."""
    out = np.full(1 << limit, 1, np.uint32)
    codes = canonical(lengths)
    for i in np.flatnonzero(lengths):
        n = int(lengths[i])
        at = int(codes[i]) << (limit - n)
        out[at : at + (1 << (limit - n))] = (int(i) << 8) | n
    return out


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, bytes]:
    """(bits of each STEP tokens, the bit stream)."""
    if not len(ids):
        return b"", b""
    n = lengths[ids].astype(np.int64)
    end = np.cumsum(n)
    off = end - n
    word, field = off >> 5, codes[ids] << (64 - n - (off & 31)).astype(np.uint64)
    heads = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros(int(end[-1] + 31 >> 5) + 1, np.uint32)
    out[word[heads]] = np.bitwise_or.reduceat(field >> np.uint64(32), heads)
    out[word[heads] + 1] |= np.bitwise_or.reduceat(field & np.uint64(0xFFFFFFFF), heads).astype(np.uint32)
    ends = np.append(end[STEP - 1 :: STEP], end[-1:] if len(ids) % STEP else [])
    return np.diff(ends, prepend=0).astype("<u2").tobytes(), out[: end[-1] + 31 >> 5].astype(">u4").tobytes()


def unpack(steps: bytes, bits: bytes, n: int, lookup: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The n ids of a block: all its runs of STEP tokens advance together, one table look-up a token."""
    if not n:
        return np.zeros(0, np.uint32)
    words = np.concatenate([np.frombuffer(bits, ">u4").astype(np.uint64), np.zeros(STEP * limit // 32 + 3, np.uint64)])
    pairs = (words[:-1] << np.uint64(32)) | words[1:]
    size = np.frombuffer(steps, "<u2").astype(np.int64)
    at = np.cumsum(size) - size
    out = np.empty((STEP, len(at)), np.uint32)
    mask, top = np.uint64((1 << limit) - 1), 64 - limit
    for k in range(STEP):
        entry = lookup[(pairs[at >> 5] >> (top - (at & 31)).astype(np.uint64)) & mask]
        out[k] = entry >> 8
        at += entry & 255
    return out.T.reshape(-1)[:n]


def _blocks(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, shard = encoder(path), TaskContext.get().partitionId()
        block, before, ids, docs, sizes, held = 0, 0, [], [], [], 0

        def row():
            return batch(_raw, shard=[shard], block=[block], before=[before], doc_ids=[[d for some in docs for d in some]], lengths=[np.concatenate(sizes)], ids=[b"".join(ids)])

        for b in batches:
            every, count = code.with_end(b["text"], end_id)
            end, doc_ids, at = np.cumsum(count), b["doc_id"].to_pylist(), 0
            while at < len(count):
                done = int(end[at - 1]) if at else 0
                to = min(len(count), int(np.searchsorted(end, done + BLOCK - held)) + 1)  # the row that fills the block
                ids.append(every[done : end[to - 1]].tobytes())
                docs.append(doc_ids[at:to])
                sizes.append(count[at:to])
                held += int(end[to - 1]) - done
                at = to
                if held >= BLOCK:
                    yield row()
                    block, before, ids, docs, sizes, held = block + 1, before + held, [], [], [], 0
        if docs:
            yield row()

    return run


def _counts(size: int, kind: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for ids in b["ids"]:
                total += np.bincount(np.frombuffer(ids.as_buffer(), kind), minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["id", "n"])

    return run


def _encode(lengths: np.ndarray, kind: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical(lengths)
        for b in batches:
            for i in range(b.num_rows):
                steps, bits = pack(np.frombuffer(b["ids"][i].as_buffer(), kind), lengths, codes)
                one = b.slice(i, 1)
                yield batch(_coded, **{k: one[k] for k in _coded.names[:5]}, steps=[steps], bits=[bits])

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Tokenizes docs (doc_id, text), counts ids over all of them, and writes the two tables."""
    code = encoder(tokenizer)
    size, kind = code.size, code.type
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("salt", F.xxhash64("text"))
    # The salt deals out rows of one doc_id; it is sampled for the bounds in place of texts.
    ordered = rows.repartitionByRange("doc_id", "salt").sortWithinPartitions("doc_id", "salt").select("doc_id", "text")
    raw = table(ordered.mapInArrow(_blocks(tokenizer, end_id), RAW), "ids")
    counts = np.zeros(size, np.int64)
    found = raw.select("ids").mapInArrow(_counts(size, kind), "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    for r in found.collect():  # as many rows as the vocabulary at most
        counts[r.id] = r.n
    lengths = code_lengths(counts)
    spark = docs.sparkSession
    book = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(book, "id int, length int").coalesce(1).write.parquet(f"{path}/codebook")
    raw.mapInArrow(_encode(lengths, kind), CODED).write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The blocks, each with ``base``: the number of tokens before its shard."""
    blocks = spark.read.schema(CODED).parquet(f"{path}/blocks")
    sizes = blocks.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    shards = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    return blocks.join(F.broadcast(shards), "shard")  # a row for each partition that wrote


def codebook(spark: SparkSession, path: str, size: int) -> np.ndarray:
    lengths = np.zeros(size, np.uint8)
    for r in spark.read.schema("id int, length int").parquet(f"{path}/codebook").collect():
        lengths[r.id] = r.length
    return lengths


def _digest(lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = decode_table(lengths)
        for b in batches:
            for r in b.to_pylist():
                sizes = np.array(r["lengths"], np.int64)
                ends = np.cumsum(sizes)
                ids = unpack(r["steps"], r["bits"], int(ends[-1]), lookup).astype("<u4")
                crc = [zlib.crc32(ids[e - n : e].tobytes()) for n, e in zip(sizes, ends, strict=True)]
                yield batch(_out, doc_id=r["doc_ids"], start=pa.array(ends - sizes + r["base"] + r["before"]), n_tokens=pa.array(sizes), ids_crc32=crc)

    return run


def digests(spark: SparkSession, path: str, size: int) -> DataFrame:
    """Decodes every block: doc_id, start, n_tokens, ids_crc32 of each document."""
    return read(spark, path).mapInArrow(_digest(codebook(spark, path, size)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def texts(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """Decodes every block back to text: doc_id, text (without the end id)."""
    code = encoder(tokenizer)
    lengths = codebook(spark, path, code.size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, back = decode_table(lengths), encoder(tokenizer).tokenizer
        for b in batches:
            for r in b.to_pylist():
                ends = np.cumsum(np.array(r["lengths"], np.int64))
                ids = unpack(r["steps"], r["bits"], int(ends[-1]), lookup)
                parts = [ids[e - n : e - 1].tolist() for n, e in zip(r["lengths"], ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(back.decode_batch(parts, skip_special_tokens=False))], names=["doc_id", "text"])

    return read(spark, path).mapInArrow(run, "doc_id long, text string")
