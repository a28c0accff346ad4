"""Alignment of two tokenizers' tokens over the same bytes.

A's tokens are of a space and the text, B's of the text, before which B sets its own space.  Where tokens end is marked in a packed
bitset over all bytes of a batch, one for A and one for B.  Their AND holds the shared cuts, which part the text into groups; their OR
ends the stretches that lie in one token of A and one of B, which are the links.  Counts of marks before a byte (rank, by counts of
bits) turn bytes into numbers of tokens, and the places of marks (select) into links.

A pair of ids' count is over the whole corpus.  Counts are added up in the tasks before the shuffle.  The most frequent pairs, at most
HOT however many there are, are looked up in the tasks; occurrences of all others are joined with their counts.  B's highest counts are
a row for each of B's ids, which its vocabulary bounds.

Null and empty texts, and those that a tokenizer doesn't give back byte for byte, have no tokens: zeros and an empty digest.  Very long
texts are read whole; B's tokenizer takes them in parts that begin with a blank, which none of its pieces crosses.  Repeated rows and
rows without doc_id are aligned like any other and count like any other.  An empty table gives an empty result.  Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outrate.llm import tokens
from outrate.llm.common import batch, table
from outrate.llm.shingles import buffers, groups

#: Pairs of ids that every task looks up itself: 17 bytes each.
HOT = 1 << 19
#: Bytes of a text that B's tokenizer takes at once.
LONG = 1 << 20
#: Distinct pairs that a task adds up before it hands them on.
HELD = 1 << 21


class Bits:
    """A packed bitset with rank and select."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def of(cls, places: np.ndarray, n: int) -> Bits:
        """The set of some places below n."""
        flags = np.zeros((n // 64 + 1) * 64, bool)
        flags[places] = True
        return cls(np.packbits(flags, bitorder="little").view("<u8"))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def __or__(self, other: Bits) -> Bits:
        return Bits(self.words | other.words)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many marks there are before each place."""
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & below)

    def select(self) -> np.ndarray:
        """The places of all marks."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


class Vocabulary:
    """The bytes of every id, one after the other."""

    def __init__(self, entries: list[bytes]):
        self.size = len(entries)
        self.length = np.array([len(e) for e in entries], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.length[ids]
        end = np.cumsum(size)
        return self.flat[np.repeat(self.begin[ids] - end + size, size) + np.arange(end[-1] if len(end) else 0)]


class Plain(tokens.Encoder):
    """The encoder without special tokens: their strings are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.kinds = tokens._kinds()
        byte = {c: b for b, c in tokens._LETTERS.items()}
        entries = [b""] * self.size
        for piece, i in self.tokenizer.get_vocab().items():
            entries[i] = bytes(map(byte.__getitem__, piece)) if all(c in byte for c in piece) else piece.encode()
        self.vocabulary = Vocabulary(entries)


class Pieces:
    """A sentencepiece model, whose pieces show spaces as U+2581 and bytes as <0xHH>."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        every = [m.id_to_piece(i) for i in range(m.vocab_size())]
        entries = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(every)]
        self.vocabulary = Vocabulary(entries)
        self.cuts = not any(b" " in e.lstrip(b" ") for e in entries)

    def _parts(self, text: str) -> list[str]:
        """A long text, cut before single blanks; the model sets each part's blank itself."""
        parts, at = [], 0
        while self.cuts and len(text) - at > LONG:
            to = text.find(" ", at + LONG)
            while to >= 0 and not (to + 1 < len(text) and text[to + 1] != " " and "!" <= text[to - 1] <= "~"):
                to = text.find(" ", to + 1)
            if to < 0:
                break
            parts.append(text[at:to])
            at = to + 1
        return [*parts, text[at:]]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        parts = [self._parts(t) for t in texts]
        found = self.model.encode(list(chain.from_iterable(parts)), num_threads=1)
        size = np.array([len(x) for x in found], np.int64)
        ids = np.fromiter(chain.from_iterable(found), np.int64, int(size.sum()))
        first = np.cumsum([0, *map(len, parts)])
        total = np.concatenate([[0], np.cumsum(size)])
        return ids, np.diff(total[first])


class Aligned(NamedTuple):
    """Some texts with tokens: their numbers in the batch; ids of A and of B; how many each text has; shared cuts as numbers of tokens up to
    them; tokens of every link, in order; how many cuts and links each text has."""

    rows: np.ndarray
    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray


def _diff(found: Bits, ends: np.ndarray) -> np.ndarray:
    return np.diff(found.rank(ends + 1), prepend=0)


def _taken(ids: np.ndarray, count: np.ndarray, keep: np.ndarray) -> np.ndarray:
    return ids[np.repeat(keep, count)]


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = Plain(a_path), Pieces(b_path)
        every = [(b"%d," % i, b"%d|" % i) for i in range(self.a.vocabulary.size)] + [(b"%d," % i, b"%d;" % i) for i in range(self.b.vocabulary.size)]
        self.written = list(chain.from_iterable(every))

    def align(self, texts: pa.Array) -> Iterator[Aligned]:
        """The texts that have tokens, by groups of them."""
        some = np.flatnonzero(np.array(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_pylist(), bool))
        texts = texts.take(pa.array(some))
        spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts.cast(pa.large_string()), pa.scalar(" ", pa.large_string()))
        data, offsets = buffers(spaced)
        for x, y in groups(offsets):
            yield self._group(some[x:y], texts.slice(x, y - x), spaced.slice(x, y - x), data[offsets[x] : offsets[y]], np.diff(offsets[x : y + 1]))

    def _group(self, rows: np.ndarray, texts: pa.Array, spaced: pa.Array, data: np.ndarray, size: np.ndarray) -> Aligned:
        (a, n_a), (b, n_b) = self.a.encode(spaced), self.b.encode(texts.to_pylist())
        ok = np.ones(len(rows), bool)
        for ids, count, v in ((a, n_a, self.a.vocabulary), (b, n_b, self.b.vocabulary)):
            length = np.diff(np.concatenate([[0], np.cumsum(v.length[ids])])[np.concatenate([[0], np.cumsum(count)])])
            ok &= length == size
            differ = v.joined(_taken(ids, count, ok)) != data[np.repeat(ok, size)]
            if differ.any():
                ok[np.flatnonzero(ok)[np.unique(np.searchsorted(np.cumsum(size[ok]), np.flatnonzero(differ), "right"))]] = False
        a, b = _taken(a, n_a, ok).astype(np.int64), _taken(b, n_b, ok)
        ends = np.cumsum(size[ok])
        n = int(ends[-1]) + 1 if len(ends) else 1
        in_a, in_b = Bits.of(np.cumsum(self.a.vocabulary.length[a]), n), Bits.of(np.cumsum(self.b.vocabulary.length[b]), n)
        shared, either = in_a & in_b, in_a | in_b
        cuts, at = shared.select(), either.select()
        return Aligned(rows[ok], a, b, n_a[ok], n_b[ok], in_a.rank(cuts + 1), in_b.rank(cuts + 1), in_a.rank(at), in_b.rank(at), _diff(shared, ends), _diff(either, ends))

    def digests(self, found: Aligned) -> list[str]:
        """Of each text the digest of its groups of ids."""
        place, code = [], []
        for ids, own, other, base in ((found.a, found.cut_a, found.cut_b, 0), (found.b, found.cut_b, found.cut_a, self.a.vocabulary.size)):
            number = np.arange(len(ids))
            group = np.searchsorted(own, number, "right")
            first = other if base else np.concatenate([[0], other[:-1]])  # a group's tokens of A stand before those of B
            place.append(number + first[group] if len(ids) else number)
            code.append(2 * (base + ids) + (number + 1 == own[group] if len(ids) else 0))
        order = np.empty(sum(map(len, place)), np.int64)
        for p, c in zip(place, code, strict=True):
            order[p] = c
        ends, get = np.cumsum(found.n_a + found.n_b).tolist(), self.written.__getitem__
        return [hashlib.sha256(b"".join(map(get, order[x:y].tolist()))[:-1]).hexdigest() for x, y in zip([0, *ends], ends)]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, a_ids, b_ids, groups, links): a group is the numbers of tokens (of A and of B) up to its end, a link the numbers of its two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for b in batches:
            rows: list[tuple] = [([], [], [], [])] * b.num_rows
            for f in own.align(b["text"]):
                a1, b1, g1, l1 = (np.cumsum(x) for x in (f.n_a, f.n_b, f.n_groups, f.n_links))
                for k, (r, i, j, g, m) in enumerate(zip(f.rows.tolist(), a1 - f.n_a, b1 - f.n_b, g1 - f.n_groups, l1 - f.n_links)):
                    ends = np.stack([f.cut_a[g : g1[k]] - i, f.cut_b[g : g1[k]] - j], 1).tolist()
                    rows[r] = (f.a[i : a1[k]].tolist(), f.b[j : b1[k]].tolist(), ends, np.stack([f.link_a[m : l1[k]] - i, f.link_b[m : l1[k]] - j], 1).tolist())
            cols = list(zip(*rows)) if rows else [[]] * 4
            ints = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), *(pa.array(list(c), t) for c, t in zip(cols, (ints, ints, pa.list_(ints), pa.list_(ints))))], names=["doc_id", "a_ids", "b_ids", "groups", "links"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, a_ids array<long>, b_ids array<long>, groups array<array<long>>, links array<array<long>>")


_DIGEST = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())])


def measured(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """For each row, under a key of its own: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct pairs of ids, A's times B's
    vocabulary plus B's, with the number of links of each.  A written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, key = aligner(a_path, b_path), TaskContext.get().partitionId() << 36
        wide, every = own.b.vocabulary.size, own.a.vocabulary.size * own.b.vocabulary.size
        for b in batches:
            counts = np.zeros((4, b.num_rows), np.int64)
            digest, pairs, times = [""] * b.num_rows, [b""] * b.num_rows, [b""] * b.num_rows
            for f in own.align(b["text"]):
                counts[:, f.rows] = f.n_a, f.n_b, f.n_groups, f.n_links
                place = np.repeat(np.arange(len(f.rows)), f.n_links)
                found, n = np.unique(place * every + f.a[f.link_a] * wide + f.b[f.link_b], return_counts=True)
                ends = np.searchsorted(found, np.arange(len(f.rows) + 1) * every).tolist()
                found, n = (found % every).astype("<u8"), n.astype("<u4")
                for r, d, x, y in zip(f.rows.tolist(), own.digests(f), ends, ends[1:]):
                    digest[r], pairs[r], times[r] = d, found[x:y].tobytes(), n[x:y].tobytes()
            yield batch(_DIGEST, key=pa.array(np.arange(key, key + b.num_rows)), doc_id=b["doc_id"].cast(pa.int64()), groups_sha256=digest, pairs=pairs, times=times, **dict(zip(("n_a", "n_b", "n_groups", "n_links"), map(pa.array, counts))))
            key += b.num_rows

    schema = "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
    return table(docs.select("doc_id", "text").mapInArrow(run, schema), "aligned")


def _held(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of all rows of a batch, their numbers of links, and how many pairs each row has."""
    pairs, times = (b[c].to_pylist() for c in ("pairs", "times"))
    return np.frombuffer(b"".join(pairs), "<u8").astype(np.int64), np.frombuffer(b"".join(times), "<u4").astype(np.int64), np.array([len(p) // 8 for p in pairs], np.int64)


def _sums(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(pairs, kind="stable")
    pairs, times = pairs[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
    return pairs[first], np.add.reduceat(times, first) if len(first) else times


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for b in chain(batches, [None]):
        if b is not None:
            held.append(_held(b)[:2])
            n += len(held[-1][0])
        if held and (b is None or n > HELD):
            pairs, times = _sums(*(np.concatenate(x) for x in zip(*held)))
            if b is None or len(pairs) > HELD // 2:
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(times)], names=["pair", "n"])
                held, n = [], 0
            else:
                held, n = [(pairs, times)], len(pairs)


def pair_counts(found: DataFrame, wide: int) -> DataFrame:
    """(pair, n, best): links of each pair over all rows, and whether that is its B id's highest.  A written table."""
    counts = table(found.select("pairs", "times").mapInArrow(_added, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    b = (F.col("pair") % wide).alias("b")
    most = counts.groupBy(b).agg(F.max("n").alias("most"))  # a row for each id of B at most
    return table(counts.select("*", b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")


def _dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [np.stack([b["pair"].to_numpy(), 2 * b["n"].to_numpy() + np.array(b["best"].to_pylist(), np.int64)]) for b in batches if b.num_rows]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(rows, axis=1).tobytes()], pa.binary())], names=["rows"])


def _frequent(counts: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """The least count of the most frequent pairs, at most HOT of them, and these in order with twice their count, plus one where it is best."""
    step = F.floor(8 * F.log2("n")).cast("int")
    steps = sorted(((r.step, r.pairs, r.least) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).collect()), reverse=True)  # at most 512 rows
    least, total = None, 0
    for _, pairs, n in steps:
        total += pairs
        if total > HOT:
            break
        least = n
    if least is None:
        least = steps[0][2] + 1 if steps else 1  # too many of the most frequent kind: all are joined
        least = max(least, 1 + (counts.agg(F.max("n")).first()[0] or 0))
    found = [np.frombuffer(r.rows, np.int64).reshape(2, -1) for r in counts.where(F.col("n") >= least).mapInArrow(_dense, "rows binary").collect()]
    every = np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1)
    every = every[:, np.argsort(every[0])]
    return least, every[0], every[1]


def digests(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row."""
    wide = Pieces(b_path).vocabulary.size
    found = measured(docs, a_path, b_path)
    counts = pair_counts(found, wide)
    least, pairs, doubled = _frequent(counts)

    def looked_up(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        own, times, size = _held(b)
        at = np.minimum(np.searchsorted(pairs, own), max(len(pairs) - 1, 0))
        return own, times, size, at, (pairs[at] == own) if len(pairs) else np.zeros(len(own), bool)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, times, size, at, hit = looked_up(b)
            value = doubled[at] if len(pairs) else np.zeros(len(at), np.int64)
            total = [np.concatenate([[0], np.cumsum(np.where(hit, x, 0))]) for x in (times * (value & 1), times * (value >> 1))]
            ends = np.concatenate([[0], np.cumsum(size)])
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), *(pa.array(np.diff(t[ends])) for t in total)], names=[*names, "n_best", "count_sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, times, size, _, hit = looked_up(b)
            key = np.repeat(b["key"].to_numpy(), size)
            yield pa.RecordBatch.from_arrays([pa.array(x[~hit]) for x in (key, own, times)], names=["key", "pair", "times"])

    names = ["key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    rows = found.select(*names, "pairs", "times").mapInArrow(known, "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    rare = counts.where(F.col("n") < least)
    if not rare.isEmpty():
        seen = found.select("key", "pairs", "times").mapInArrow(others, "key long, pair long, times long").join(rare, "pair")
        more = seen.groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best2"), F.sum(F.col("times") * F.col("n")).alias("sum2"))
        zero = F.lit(0).cast("long")
        rows = rows.join(more, "key", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("best2", zero), "count_sum": F.col("count_sum") + F.coalesce("sum2", zero)})
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
