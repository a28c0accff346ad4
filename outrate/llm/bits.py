"""A bit set of 64-bit keys with two probes each.  Its size is fixed, so it can be sent to every task; what it lets through is
checked by a join or does no harm."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2 ** 25 bits, 4 MB, however many keys there are.
BITS = 25


def _slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (keys >> np.uint64(64 - BITS)).astype(np.int64), (keys & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = np.concatenate(_slots(b[0].to_numpy().view(np.uint64)))
        yield pa.RecordBatch.from_arrays([pa.array((at >> 6).astype(np.int32)), pa.array(np.left_shift(np.int64(1), at & 63))], names=["word", "bits"])


def bitset(keys: DataFrame, key: Column) -> np.ndarray:
    """The set of the well-mixed 64-bit keys, as words of 64 bits."""
    out = np.zeros(1 << (BITS - 6), np.int64)
    found = keys.select(key.alias("key")).where("key IS NOT NULL").mapInArrow(_words, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    at, bits = gathered(found)
    out[at] = bits
    return out.view(np.uint64)


def _dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [np.stack([b[0].to_numpy().astype(np.int64), b[1].to_numpy()]) for b in batches if b.num_rows]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(rows, axis=1).tobytes()], pa.binary())], names=["pairs"])


def gathered(pairs: DataFrame) -> np.ndarray:
    """Rows of two numbers, each first one once and below a fixed bound, brought to the driver: 16 bytes each."""
    found = [np.frombuffer(r.pairs, np.int64).reshape(2, -1) for r in pairs.mapInArrow(_dense, "pairs binary").collect()]
    return np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1)


def among(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Numbers of the keys that may be in the set."""
    one, two = _slots(keys)
    at = np.flatnonzero((bits[one >> 6] >> (one & 63).astype(np.uint64)) & np.uint64(1))
    two = two[at]
    return at[((bits[two >> 6] >> (two & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)] if len(at) else at
