"""Near-duplicate documents by an LSH forest over MinHash signatures.

Every document's set of word shingles gets ``trees * depth`` MinHash values.  A tree is the order of
all documents by its own ``depth`` values and, below them, the values of the next tree.  Documents
that agree on the first ``depth`` values form a region of the tree.  Within a region documents stand in
order, so those with the longest common prefixes are neighbours, however deep their region goes: each
becomes a candidate with the ``NEAR`` before it.  Regions of more than ``HOT`` documents are dealt out by
ranges of that order.
Equal sets are joined beforehand, candidates that their signatures rule out are dropped, and links are
confirmed on the full sets: first each document's likeliest partner, then all candidates that these
links have not joined yet.

In a region of more than ``SMALL`` documents not all pairs are compared that way.  Where such a region
is not wholly in one component yet, its documents go through an exact pass: their shingles are put into
one order, the rarest first, and two sets that are a link share one of their first shingles (prefix
filter).  All pairs of different components that do, and may be links by what stands behind it, are
confirmed too.

Trees and depth follow from the threshold: a pair at 0.85 shares a region of one tree with probability
0.85 ** 6 = 0.38, one at 0.80 with 0.80 ** 5 = 0.33; that none of 24 or 29 trees shows it has
probability 1e-5.

Null and empty text, or text of blanks: the set is empty, the document is linked with nothing.  Rows
without doc_id are linked with nothing, and kept.  Rows of one doc_id and equal text count as one
document in links but each comes back.  Very long texts are hashed whole, in a group of their own.  An
empty table gives an empty result.  Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outrate.llm.bits import among, bitset, gathered
from outrate.llm.common import hot_join, table
from outrate.llm.components import components, stars
from outrate.llm.shingles import mix, sets

#: The most trees, and the probability that a pair at the threshold shares no region.
TREES, MISS = 29, 1.2e-5
NEAR, SMALL, HOT = 3, 10, 4000
#: Shingles are counted in 2 ** SLOTS slots, 1 MB, to tell the rare ones; of a hot shingle's documents about DEAL stand in one block.
SLOTS, DEAL = 18, 512
#: Tasks that a document's candidates are dealt out to.
PARTS = 64
#: Confirmed links have 100 * intersection >= link * union.
LINK = 85


class Forest(NamedTuple):
    link: int
    trees: int
    depth: int
    #: Share of equal signature values under which a pair is dropped: five standard deviations below the link's.
    drop: float
    a: np.ndarray
    b: np.ndarray


def planned(link: int) -> Forest:
    """The deepest trees that miss a pair at the threshold with MISS at most."""
    t = link / 100
    trees = lambda depth: math.ceil(math.log(MISS) / math.log1p(-(t**depth)))
    depth = max((d for d in range(1, 9) if trees(d) <= TREES), default=1)
    n, rng = trees(depth) * depth, np.random.default_rng(11)
    a = rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1)
    return Forest(link, trees(depth), depth, math.floor(100 * (t - 5 * math.sqrt(t * (1 - t) / n))) / 100, a, rng.integers(0, 1 << 32, n, dtype=np.uint32))


_signed = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("sig", pa.binary())])
SIGNED = "doc_id long, n_shingles long, k1 long, k2 long, sig binary"


def _sign(plan: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(sets(b["text"]))
            size = np.array([len(x) for x in found], np.int64)
            has = np.flatnonzero(size)
            key, sig = np.zeros((2, len(found)), np.uint64), np.zeros((len(has), len(plan.a)), np.uint32)
            if len(has):
                every, at = np.concatenate([found[i] for i in has]), np.cumsum(size[has]) - size[has]
                for k, salt in enumerate((1, 2)):
                    key[k, has] = np.add.reduceat(mix(every ^ np.uint64(salt)), at)
                high = (every >> np.uint64(32)).astype(np.uint32)
                for k in range(len(plan.a)):
                    sig[:, k] = np.minimum.reduceat(high * plan.a[k] + plan.b[k], at)
            rows = dict(zip(has.tolist(), ((sig * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16), strict=True))
            signed = [rows[i].tobytes() if i in rows else None for i in range(len(found))]
            k1, k2 = key.view(np.int64)
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), pa.array(size), pa.array(k1), pa.array(k2), pa.array(signed, pa.binary())], schema=_signed)

    return run


_placed = pa.schema([("tree", pa.int32()), ("region", pa.int64()), ("label", pa.binary()), ("id", pa.int64())])


def _plant(plan: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b["sig"].to_pylist()), np.uint16).reshape(b.num_rows, -1)
            twice = np.concatenate([sig, sig[:, : plan.depth]], axis=1)
            for t in range(plan.trees):
                label = np.ascontiguousarray(twice[:, t * plan.depth : (t + 2) * plan.depth])
                h = np.full(b.num_rows, t, np.uint64)
                for k in range(plan.depth):
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + label[:, k])
                rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * plan.depth), b.num_rows, [None, pa.py_buffer(label.astype(">u2"))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, t, np.int32)), pa.array(h.view(np.int64)), rows, b["id"]], schema=_placed)

    return run


_pairs = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_pairs_edges = pa.schema([*_pairs, pa.field("key", pa.int64()), pa.field("label", pa.binary()), pa.field("id", pa.int64())])


def _neighbours(edges: bool):
    """Rows in order of (key, label): pairs of each with the NEAR rows before it, or with all of a small region.  edges: also the
    partition's first and last rows, whose neighbours may stand in other partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node, place = np.zeros((3, 0), np.int64)  # the last rows, and their places in their regions
        first, last = None, None
        for rows in batches:
            if not rows.num_rows:
                continue
            old = len(key)
            key, node = np.concatenate([key, rows["key"].to_numpy()]), np.concatenate([node, rows["id"].to_numpy()])
            at = np.arange(len(key))
            begin = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), at, 0))
            place = at - begin + np.where(begin == 0, place[0] if old else 0, 0)
            found = []
            for s in range(1, min(SMALL, len(key))):
                i = np.arange(max(s, old), len(key))
                i = i[(key[i] == key[i - s]) & ((s <= NEAR) | (place[i] < SMALL))]
                found.append(np.stack([np.minimum(node[i], node[i - s]), np.maximum(node[i], node[i - s])]))
            if found:
                a, b = np.concatenate(found, axis=1)
                nothing = [pa.nulls(len(a), t) for t in (pa.int64(), pa.binary(), pa.int64())] if edges else []
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *nothing], schema=_pairs_edges if edges else _pairs)
            key, node, place = key[-SMALL:], node[-SMALL:], place[-SMALL:]
            if edges:
                first = rows if first is None else pa.concat_batches([first, rows.slice(0, NEAR)]).slice(0, NEAR)
                first = first.slice(0, NEAR)
                last = pa.concat_batches([*([last] if last is not None else []), rows.slice(max(0, rows.num_rows - NEAR))])
                last = last.slice(max(0, last.num_rows - NEAR))
        if first is not None:
            ends = pa.concat_batches([first, last])
            nothing = pa.nulls(ends.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([nothing, nothing, ends["key"], ends["label"], ends["id"]], schema=_pairs_edges)

    return run


def _seen(placed: DataFrame, large: DataFrame) -> DataFrame:
    """Candidates (a, b).  Regions of more than HOT documents are dealt out by ranges of their order, so a task never has one alone;
    the rows at the ends of ranges, a few for each task, are compared once more together."""
    marked = hot_join(placed, large.drop("n"), ["tree", "region"], "left", large)
    cold = marked.where("hot IS NULL OR NOT hot").select(F.col("region").alias("key"), "label", "id")
    seen = cold.repartition("key").sortWithinPartitions("key", "label", "id").select("key", "id").mapInArrow(_neighbours(False), "a long, b long")
    if not large.where("hot").isEmpty():
        hot = marked.where("hot").select(F.col("region").alias("key"), "label", "id")
        ranges = hot.repartitionByRange("key", "label", "id").sortWithinPartitions("key", "label", "id")
        near = table(ranges.mapInArrow(_neighbours(True), "a long, b long, key long, label binary, id long"), "hot-neighbours")
        ends = near.where("a IS NULL").select("key", "label", "id").repartition(1).sortWithinPartitions("key", "label", "id")
        seen = seen.union(near.where("a IS NOT NULL").select("a", "b")).union(ends.select("key", "id").mapInArrow(_neighbours(False), "a long, b long"))
    return seen.where("a <> b").distinct()


def _likely(plan: Forest):
    """Drops pairs by their sizes and signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(x[c].to_pylist()), np.uint16).reshape(x.num_rows, -1) for c in ("sa", "sb"))
            share = (one == two).mean(axis=1)
            na, nb = x["na"].to_numpy(), x["nb"].to_numpy()
            ok = (share >= plan.drop) & (100 * np.minimum(na, nb) >= plan.link * np.maximum(na, nb))
            yield pa.RecordBatch.from_arrays([x["a"].filter(pa.array(ok)), x["b"].filter(pa.array(ok)), pa.array(share[ok])], names=["a", "b", "share"])

    return run


def _confirm(link: int):
    """Rows in order of cell, the cell's own document first: links of the others with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, mine = None, None
        for x in batches:
            a, b = [], []
            for cell, node, found in zip(x["cell"].to_pylist(), x["node"].to_pylist(), sets(x["text"]), strict=True):
                if node == cell:
                    own, mine = cell, found
                elif own == cell:
                    both = len(np.intersect1d(mine, found, assume_unique=True))
                    if 100 * both >= link * (len(mine) + len(found) - both):
                        a.append(cell)
                        b.append(node)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_pairs)

    return run


def _confirmed(pairs: DataFrame, docs: DataFrame, link: int) -> DataFrame:
    """pairs (a, b) that are links by their full sets.  A hot cell is dealt out over several tasks, its document with each part."""
    placed = pairs.select(F.col("a").alias("cell"), F.col("b").alias("node"), F.pmod(F.xxhash64("b"), F.lit(PARTS)).alias("part"))
    need = placed.union(placed.select("cell", F.col("cell").alias("node"), "part").distinct())
    rows = need.join(docs.select(F.col("doc_id").alias("node"), "text").hint("merge"), "node")  # texts never fit a broadcast
    ready = rows.repartition("cell", "part").sortWithinPartitions("cell", "part", F.col("node") != F.col("cell"))
    return table(ready.select("cell", "node", "text").mapInArrow(_confirm(link), "a long, b long"), "confirmed")


def _only(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.take(pa.array(among(bits, mix(b["doc_id"].to_numpy().view(np.uint64)))))

    return run


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(mix(b["doc_id"].to_numpy().view(np.uint64)).view(np.int64))], names=["key"])


def _candidates(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The documents that stand in pairs, and a few others; their texts need no shuffle for it."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().mapInArrow(_mixed, "key long")
    some = docs.where("doc_id IS NOT NULL").mapInArrow(_only(bitset(named, F.col("key"))), "doc_id long, text string")
    return table(some, "texts")


_prefix = pa.schema([("shingle", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("id", pa.int64())])


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (mix(shingles) >> np.uint64(64 - SLOTS)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << SLOTS, np.int64)
    for b in batches:
        for found in sets(b["text"]):
            np.add.at(total, _slots(found), 1)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["slot", "n"])


def _prefixes(counts: np.ndarray, link: int):
    """The shingles of each set that come first: a link shares link hundredths of the greater set at least, so one of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, size = [], []
            for found in sets(b["text"]):
                n = len(found)
                first.append(found[np.lexsort((found, counts[_slots(found)]))[: n - -(-link * n // 100) + 1 if n else 0]])
                size.append(n)
            if first:
                each = np.array([len(x) for x in first])
                at = np.concatenate([np.arange(k, dtype=np.int32) for k in each])
                columns = np.concatenate(first).view(np.int64), at, np.repeat(np.array(size, np.int32), each), np.repeat(b["doc_id"].to_numpy(), each)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_prefix)

    return run


_open = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _compared(link: int):
    """Rows in order of (shingle, i, j, side): pairs of both sides, two blocks of at most DEAL rows, that are of different components
    and may be links by their sizes and by what stands behind the shingle in both."""

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        node, component, n, at, side = (rows[c].to_numpy() for c in ("id", "component", "n", "at", "side"))
        one, two = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # side 2: a block with itself
        least = -(-link * (n[one, None].astype(np.int64) + n[two]) // (100 + link))
        fits = (component[one, None] != component[two]) & ((n - at)[one, None] >= least) & ((n - at)[two] >= least)
        x, y = np.nonzero(fits)
        a, b = node[one[x]], node[two[y]]
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], schema=_open)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b[c].to_numpy() for c in ("shingle", "i", "j")])
            cuts = np.flatnonzero(np.concatenate([[last is not None and (key[:, 0] != last).any()], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
            for x, y in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if x in cuts and held:
                    yield pairs(pa.Table.from_batches(held).combine_chunks())
                    held = []
                if y > x:
                    held.append(b.slice(x, y - x))
            last = key[:, -1]
        if held:
            yield pairs(pa.Table.from_batches(held).combine_chunks())

    return run


def _unjoined(crowd: DataFrame, texts: DataFrame, link: int) -> DataFrame:
    """crowd (id, component) -> all pairs (a, b) of different components that may be links by their sizes and first shingles.

    The documents that have a shingle among their first ones are dealt out to blocks, and each two blocks are compared in a task, so a
    shingle of many documents is neither one task's work nor as many rows as it has pairs.
    """
    counts = np.zeros(1 << SLOTS, np.int32)
    slot, n = gathered(texts.mapInArrow(_counts, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")))  # 2 ** SLOTS rows at most
    counts[slot] = np.minimum(n, 2**31 - 1)
    rows = table(texts.mapInArrow(_prefixes(counts, link), "shingle long, at int, n int, id long").join(crowd, "id"), "prefixes")
    several = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("component").alias("p"), F.max("component").alias("q")).where("p < q")
    several = table(several.select("shingle", "n", F.ceil(F.col("n") / DEAL).cast("int").alias("parts")), "several")
    rows = hot_join(rows, several.select("shingle", "parts"), ["shingle"], counts=several).withColumn("own", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    block = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    rows = rows.select("shingle", "id", "component", "n", "at", "own", block).withColumns({
        "i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1),
    })
    dealt = rows.select("shingle", "i", "j", "side", "id", "component", "n", "at").repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j")
    return table(dealt.mapInArrow(_compared(link), "a long, b long").distinct(), "unjoined")


def _crowd(placed: DataFrame, large: DataFrame, known: DataFrame) -> DataFrame | None:
    """(id, component) of the documents in large regions whose documents are not all in one component yet."""
    if large.isEmpty():
        return None
    some = table(hot_join(placed.select("tree", "region", "id"), large.select("tree", "region"), ["tree", "region"], counts=large), "in-large")
    named = some.select("id").distinct().join(known.select(F.col("node").alias("id"), "component"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    named = table(named, "named")
    some = some.join(named, "id")
    mixed = some.groupBy("tree", "region").agg(F.min("component").alias("p"), F.max("component").alias("q"), F.count("*").alias("n")).where("p < q")
    mixed = table(mixed.select("tree", "region", "n"), "mixed")
    if mixed.isEmpty():
        return None
    ids = hot_join(table(some.select("tree", "region", "id"), "in-mixed"), mixed.select("tree", "region"), ["tree", "region"], counts=mixed).select("id").distinct()
    return table(named.join(ids, "id", "left_semi"), "crowd")


def group(docs: DataFrame, link: int = LINK) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_shingles, component_id, kept; linked are texts with a similarity of link hundredths or more."""
    plan = planned(link)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = table(docs.mapInArrow(_sign(plan), SIGNED), "signed")
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    equal = ["k1", "k2", "n_shingles"]
    same = full.groupBy(*equal).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    nodes = table(hot_join(full.select("doc_id", *equal), same.drop("n"), equal, counts=same).select("doc_id", "rep").distinct(), "nodes")
    reps = full.join(nodes.where("doc_id = rep").select("doc_id").distinct(), "doc_id").select(F.col("doc_id").alias("id"), "n_shingles", "sig")
    placed = table(reps.mapInArrow(_plant(plan), "tree int, region long, label binary, id long"), "forest")
    large = placed.groupBy("tree", "region").agg(F.count("*").alias("n")).where(F.col("n") > SMALL)
    large = table(large.withColumn("hot", F.col("n") > HOT), "large")
    seen = _seen(placed, large)
    one, two = (reps.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sig").alias(f"s{x}")) for x in "ab")
    pairs = table(seen.join(one, "a").join(two, "b").mapInArrow(_likely(plan), "a long, b long, share double"), "candidates")
    best = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("share"), "a"))).where("rank = 1")
    sources = _candidates(docs, pairs)
    links = _confirmed(best.select("a", "b"), sources, link)
    known = stars(links, 2)  # these only spare confirmations
    a, b = (known.groupBy(F.col("node").alias(x)).agg(F.min("component").alias(f"c{x}")) for x in "ab")
    open_pairs = pairs.select("a", "b").join(a, "a", "left").join(b, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    open_pairs = table(open_pairs.select("a", "b"), "open")
    more = known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(nodes.where("doc_id <> rep"))
    if not open_pairs.isEmpty():
        more = more.union(_confirmed(open_pairs, sources, link))
    known = components(more)
    crowd = _crowd(placed, large, known)
    if crowd is not None:
        texts = _candidates(docs, crowd.select(F.col("id").alias("a"), F.col("id").alias("b")))
        late = _unjoined(crowd, texts, link)
        if not late.isEmpty():
            late = _confirmed(late, texts, link)
            if not late.isEmpty():
                known = components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(late))
    out = signed.join(known.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep(docs: DataFrame, link: int = LINK) -> DataFrame:
    """The rows of docs but for those of which a near copy with a smaller doc_id is in the same group."""
    gone = table(group(docs, link).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct(), "gone")  # of known size: broadcast only if small
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
