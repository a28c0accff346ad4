"""Removes every byte that lies in a ``LENGTH``-byte string which starts more than once in the corpus.

1. Equal texts are told by two hashes; those of LENGTH bytes and more go as a whole, and one copy of
   each stands for them in what follows.
2. Winnowing: of the ``GRAM``-byte strings in a window of LENGTH bytes the one with the smallest hash
   is its anchor (the last of equal ones).  Equal windows have equal anchors at the same place, so only
   windows whose anchor occurs again can repeat.  The windows of one anchor lie together; with their
   bytes they are its context.
3. Equal contexts of one anchor repeat as a whole.  Of those that differ, one each is compared with
   the others of the same anchor: their Burrows-Wheeler transforms are built in shards and merged by
   interleave refinement, whose blocks after LENGTH rounds are the repeated strings (``bwt``).  No
   suffix is compared with those of other anchors, and none is sorted again.
4. An anchor with more than ``HOT`` contexts is split: windows that begin in the first or second half
   of its context are grouped anew by all bytes that such windows must share, until groups are small
   or the shared bytes are the whole window.  Equal halves repeat as a whole, and one of each goes on, so a
   group of near copies shrinks as its halves do.

All strings are judged on the input.  Null text: empty.  Texts shorter than LENGTH stay.  Rows of one
doc_id or without one are documents of their own.  Very long texts are taken in pieces that overlap, so
no string is missed.  An empty table gives an empty result.  Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outrate.llm.bits import among, bitset
from outrate.llm.bwt import repeated
from outrate.llm.common import table
from outrate.llm.shingles import _BASE, _BYTE, _powers, buffers, mix

LENGTH, GRAM, HOT = 200, 64, 2000
WIDE = LENGTH - GRAM + 1
#: Bytes of text hashed together, and of contexts whose transforms are merged together.
PIECE, MERGE = 1 << 19, 1 << 18
_PLACE = 24


def _pieces(offsets: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (text, begin, end) of about PIECE bytes; longer texts in pieces that share LENGTH - 1 bytes, so each window is in one."""
    held, size = [], 0
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for x in range(a, max(a + 1, b - LENGTH + 1), PIECE):
            held.append((i, x, min(b, x + PIECE + LENGTH - 1)))
            size += held[-1][2] - x
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def _anchors(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """For each list of pieces: text, hash of the anchor, first and last begin of its windows, place of the anchor (all in the text's bytes), hash of the context."""
    for held in _pieces(offsets):
        some = np.concatenate([data[a:b] for _, a, b in held])
        n = len(some)
        if n < LENGTH:
            continue
        size = np.array([b - a for _, a, b in held])
        end = np.cumsum(size)
        gram, k = _BYTE[some], 1
        while k < GRAM:
            gram = gram[:-k] * np.uint64(pow(_BASE, k, 1 << 64)) + gram[k:]
            k *= 2
        gram = mix(gram)
        least = (gram >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange((1 << _PLACE) - 1, (1 << _PLACE) - 1 - len(gram), -1, dtype=np.uint64)
        k = 1
        while 2 * k <= WIDE:
            least = np.minimum(least[:-k], least[k:])
            k *= 2
        least = np.minimum(least[: n - LENGTH + 1], least[WIDE - k : n - LENGTH + 1 + WIDE - k])
        place = (1 << _PLACE) - 1 - (least & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        # windows within one piece
        inside = np.zeros(n + 1, np.int32)
        full = size >= LENGTH
        np.add.at(inside, (end - size)[full], 1)
        np.add.at(inside, (end - LENGTH + 1)[full], -1)
        at = np.flatnonzero(np.cumsum(inside)[: n - LENGTH + 1])
        if not len(at):
            continue
        own = place[at]
        first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)]))
        lo, hi, anchor = at[first], at[np.append(first[1:], len(at)) - 1], own[first]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[some] * _powers(_BASE, n), out=total[1:])
        context = mix((total[hi + LENGTH] - total[lo]) * _powers(pow(_BASE, -1, 1 << 64), n + 1)[lo] + (anchor - lo).astype(np.uint64))
        which = np.searchsorted(end, lo, "right")
        text = np.array([i for i, _, _ in held])[which]
        shift = (np.array([a for _, a, _ in held]) - (end - size))[which] - offsets[text]
        yield text, gram[anchor], lo + shift, hi + shift, anchor + shift, context


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, gram, *_ in _anchors(*buffers(b["text"])):
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64))], names=["h"])


ITEM = "h long, cx long, k1 long, k2 long, lo int, hi int, anchor int"


def _items(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2 = b["k1"].to_numpy(), b["k2"].to_numpy()
            for text, gram, lo, hi, anchor, context in _anchors(*buffers(b["text"])):
                at = among(bits, gram)
                columns = gram[at].view(np.int64), context[at].view(np.int64), k1[text[at]], k2[text[at]], *(x[at].astype(np.int32) for x in (lo, hi, anchor))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h", "cx", "k1", "k2", "lo", "hi", "anchor"])

    return run


def _runs(group: str, part: str):
    """Rows in order of (group, part): adds whether the part occurs again, and whether the row stands for it.  One row is held back
    between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, again = None, False  # the row held back, and whether the one before it was of its part
        for b in batches:
            if last is not None:
                b = pa.concat_batches([last, b])
            if not b.num_rows:
                continue
            x, y = b[group].to_numpy(), b[part].to_numpy()
            same = np.concatenate([[again], (x[1:] == x[:-1]) & (y[1:] == y[:-1])])
            again, last = bool(same[-1]), b.slice(b.num_rows - 1)
            twice = same[:-1] | same[1:]
            yield pa.RecordBatch.from_arrays([*b.slice(0, b.num_rows - 1).columns, pa.array(twice), pa.array(~same[:-1])], names=[*b.schema.names, "twice", "stands"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([*last.columns, pa.array([again]), pa.array([not again])], names=[*last.schema.names, "twice", "stands"])

    return run


def _told(rows: DataFrame, group: str, part: str, schema: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose part occurs again in their group (some twice), and one row for each part.  Each partition keeps one row of a part
    before the shuffle, so a part that a third of all rows share brings as many rows as there are partitions."""
    marks = f"{schema}, twice boolean, stands boolean"
    local = table(rows.sortWithinPartitions(group, part).mapInArrow(_runs(group, part), marks), name)
    dealt = local.where("stands").drop("twice", "stands").repartition(group, part).sortWithinPartitions(group, part)
    heads = table(dealt.mapInArrow(_runs(group, part), marks), f"{name}-heads")
    return local.where("twice").union(heads.where("twice")), heads.where("stands").drop("twice", "stands")


def _select(bits: np.ndarray, inside: bool = True):
    """Rows whose k1 may be in the set, or the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = among(bits, mix(b["k1"].to_numpy().view(np.uint64)))
            if not inside:
                out = np.ones(b.num_rows, bool)
                out[at] = False
                at = np.flatnonzero(out)
            yield b.take(pa.array(at))

    return run


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(mix(b["k1"].to_numpy().view(np.uint64)).view(np.int64))], names=["key"])


def _keys(df: DataFrame) -> np.ndarray:
    return bitset(df.select("k1").mapInArrow(_mixed, "key long"), F.col("key"))


SPAN = "k1 long, k2 long, a int, b int"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of key: whole groups are gathered up to MERGE bytes, and their contexts' transforms merged."""
    rows: list[tuple] = []
    group: list[tuple] = []
    key, size = None, 0

    def flush() -> pa.RecordBatch:
        found = [(rows[i][0], rows[i][1], rows[i][2] + a, rows[i][2] + b - 1 + LENGTH) for i, a, b in repeated([r[3] for r in rows], LENGTH)] if len(rows) > 1 else []
        columns = zip(*found, strict=True) if found else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["k1", "k2", "a", "b"])

    for batch in batches:
        for r in zip(*(batch[c].to_pylist() for c in ("key", "k1", "k2", "lo", "s")), strict=True):
            if r[0] != key:
                if len(group) > 1:
                    rows += group
                if size >= MERGE:
                    yield flush()
                    rows, size = [], 0
                key, group = r[0], []
            group.append(r[1:])
            size += len(r[4])
    if len(group) > 1:
        rows += group
    if rows:
        yield flush()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of each row's context."""
    for b in batches:
        data, offsets = buffers(b["text"])
        at = offsets[:-1]
        s = [data[o + x : o + y + LENGTH].tobytes() for o, x, y in zip(at.tolist(), b["lo"].to_pylist(), b["hi"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(b[c] for c in ("h", "k1", "k2", "lo", "hi", "anchor")), pa.array(s, pa.binary())], names=["h", "k1", "k2", "lo", "hi", "anchor", "s"])


def _halved(contexts: DataFrame) -> DataFrame:
    """The rows' windows, which begin ``first`` to ``last`` bytes from the anchor, in two halves, each keyed by the bytes that all
    windows of its half share."""
    mid = F.expr("CAST(floor((first + last) / 2) AS INT)")
    halves = F.array(F.struct(F.col("first").alias("x"), mid.alias("y")), F.struct((mid + 1).alias("x"), F.col("last").alias("y")))
    some = contexts.withColumn("half", F.explode(halves)).select("h", "k1", "k2", "lo", "hi", "anchor", "s", F.col("half.x").alias("first"), F.col("half.y").alias("last"))
    some = some.withColumns({"__lo": F.greatest("lo", F.col("anchor") + F.col("first")), "__hi": F.least("hi", F.col("anchor") + F.col("last"))}).where("__lo <= __hi")
    s = F.expr(f"substring(s, __lo - lo + 1, __hi - __lo + {LENGTH})")
    core = F.expr(f"substring(s, anchor + last - lo + 1, first - last + {LENGTH})")
    return some.select(F.xxhash64("h", "first", "last", core).alias("key"), "h", "k1", "k2", F.col("__lo").alias("lo"), F.col("__hi").alias("hi"), "anchor", "first", "last", s.alias("s"))


HALF = "key long, h long, k1 long, k2 long, lo int, hi int, anchor int, first int, last int, s binary, part long"


def _compared(contexts: DataFrame) -> DataFrame:
    """Spans of windows that occur in more than one of the contexts, which are distinct for their anchor.  All hot groups are halved
    together, at most eight times."""
    rows = contexts.withColumns({"key": F.col("h"), "first": F.lit(1 - WIDE), "last": F.lit(0)})
    small, whole = [], []
    while True:
        hot = table(rows.groupBy("key").count().where(F.col("count") > HOT).select("key", F.lit(True).alias("hot")), "hot")
        if hot.isEmpty():
            small.append(rows)
            break
        marked = rows.join(hot, "key", "left")
        small.append(marked.where("hot IS NULL").drop("hot"))
        whole.append(marked.where("hot AND first = last").select("k1", "k2", F.col("lo").alias("a"), (F.col("hi") + LENGTH).alias("b")))
        halves = _halved(marked.where("hot AND first < last").drop("hot", "key")).withColumn("part", F.xxhash64("s"))
        # Halves that are equal repeat as a whole; one of them is compared further.
        twice, stands = _told(halves, "key", "part", HALF, "halves")
        whole.append(twice.select("k1", "k2", F.col("lo").alias("a"), (F.col("hi") + LENGTH).alias("b")))
        rows = stands.drop("part")
    together = reduce(DataFrame.union, [x.select("key", "k1", "k2", "lo", "s") for x in small])
    ordered = together.repartition("key").sortWithinPartitions("key")
    merged = table(ordered.mapInArrow(_merged, SPAN), "merged")
    return reduce(DataFrame.union, whole, merged)


RESULT = "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])
    for b in batches:
        data, offsets = buffers(b["text"])
        out = []
        for r, (k1, k2, spans) in enumerate(zip(b["k1"].to_pylist(), b["k2"].to_pylist(), b["spans"].to_pylist(), strict=True)):
            text = data[offsets[r] : offsets[r + 1]]
            edge = np.zeros(len(text) + 1, np.int32)
            np.add.at(edge, [s["a"] for s in spans], 1)
            np.add.at(edge, [s["b"] for s in spans], -1)
            gone = np.cumsum(edge)[:-1] > 0
            kept = text[~gone].tobytes()
            runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
            out.append((k1, k2, int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")))
        columns = zip(*out, strict=True) if out else [[]] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _same(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(text, F.lit(LENGTH))


def remove(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text (null where nothing was removed; where a
    cut left half a character, without it)."""
    k1, k2 = _same(F.col("text"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", "text", k1.alias("k1"), k2.alias("k2"), F.octet_length("text").cast("long").alias("n_bytes"))
    rows = table(docs.select("doc_id", "k1", "k2", "n_bytes", F.sha2("text", 256).alias("sha")), "rows")
    copies = table(rows.where(F.col("n_bytes") >= LENGTH).groupBy("k1", "k2").count().where("count > 1").select("k1", "k2"), "copies")
    copied = _keys(copies)
    long = docs.where(F.col("n_bytes") >= LENGTH).select("k1", "k2", "text")
    schema = "k1 long, k2 long, text string"
    alone = long.mapInArrow(_select(copied, False), schema)
    texts = table(alone.union(long.mapInArrow(_select(copied), schema).dropDuplicates(["k1", "k2"])), "texts")
    counts = texts.select("text").mapInArrow(_hashes, "h long").groupBy("h").count().where("count > 1")
    bits = bitset(counts, F.col("h"))
    items = texts.mapInArrow(_items(bits), ITEM)
    twice, stand = _told(items, "h", "cx", ITEM, "runs")
    stand = stand.drop("cx")
    several = stand.groupBy("h").count().where("count > 1").select("h")
    stand = table(stand.join(several, "h", "left_semi"), "contexts")
    need = texts.mapInArrow(_select(_keys(stand)), schema).hint("merge")
    contexts = table(stand.join(need, ["k1", "k2"]).mapInArrow(_cut, "h long, k1 long, k2 long, lo int, hi int, anchor int, s binary"), "bytes")
    spans = twice.select("k1", "k2", F.col("lo").alias("a"), (F.col("hi") + LENGTH).alias("b")).union(_compared(contexts))
    gathered = table(spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "b")).alias("spans")).join(copies, ["k1", "k2"], "left_anti"), "spans")  # of one text each
    found = table(gathered.join(texts.mapInArrow(_select(_keys(gathered)), schema).hint("merge"), ["k1", "k2"]).select("k1", "k2", "spans", "text").mapInArrow(_removed, RESULT), "removed")
    gone = copies.withColumn("copied", F.lit(True))
    out = rows.join(found, ["k1", "k2"], "left").join(gone, ["k1", "k2"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        "doc_id", "n_bytes",
        F.when(F.col("copied"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copied"), 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copied"), F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(F.col("copied"), "").otherwise(F.col("kept_text")).alias("kept_text"),
    )
