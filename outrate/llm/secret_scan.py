"""Secrets in texts, also where they are wrapped: URL escapes, Unicode escapes, base64 and compressed data, one inside the other.

The base patterns are run over the whole text.  Then a worklist holds layers: the text first, later what is unwrapped from it.  Of a layer,
each line with escapes is unescaped in place, each run of base64 is decoded, and what that makes is decompressed where it begins as
compressed data does.  Every new layer is scanned by the same patterns and goes on the worklist, until nothing more unwraps.  A layer
that was seen before from the same place of the text is a cycle and goes no further.  Each character of a layer knows the stretch of the
text it comes from, so that found spans are given in the text; of decompressed data that is the whole of what was compressed.

A compressed layer of over MOST bytes, or layers of over ALL characters from one text in all, would hold a task's memory for one text;
they are not read and are counted (unread).  A span that lies in a base span of its kind adds nothing and is left out.

Null and empty texts have no spans.  Very long texts are read whole.  Ties: spans are in order of start, kind as listed, end; equal ones
from different layers count once, from the shortest path.  Repeated rows and rows without doc_id are scanned like any other.  An empty
table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a decompressed layer, and characters of all layers of a text, that are read.
MOST, ALL = 16 << 20, 64 << 20

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|%u[0-9A-Fa-f]{4})+")
_ONE = re.compile(r"(?:\\[uUx]\{?|%u)([0-9A-Fa-f]+)\}?")
_CODED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{60,}\r?\n)*[A-Za-z0-9+/_-]{16,}={0,2}")
_STRICT = re.compile(r"[A-Za-z0-9+/]{16,}={0,2}")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    value: str
    layers: str


class Layer(NamedTuple):
    """Text, the stretch of the original text behind each character (none: the original itself), and how it was unwrapped."""

    text: str
    start: np.ndarray | None
    end: np.ndarray | None
    path: tuple[str, ...]

    def origin(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (int(self.start[a:b].min()), int(self.end[a:b].max()))

    def stretches(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for many stretches of at least one character."""
        if self.start is None:
            return a, b
        return self.start[a], self.end[b - 1]


def matches(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans of the base patterns; matches that fail are dropped, and the search goes on after them."""
    for m in _ASSIGN.finditer(text):
        if m.end(1) - m.start(1) >= 6:
            yield "assign", m.start(), m.end()
    if "AKIA" in text:
        # A failed match runs to the end of its capitals and digits, so that nothing longer can begin inside it.
        for m in _ACCESS.finditer(text):
            yield "access", m.start(), m.end()
    for m in _HEX.finditer(text):
        yield "hex", m.start(), m.end()


def _readable(data: bytes) -> str | None:
    """Bytes as text: UTF-8, or UTF-16 where every second byte is zero; none where that gives anything but text."""
    if len(data) > 3 and not any(data[1:40:2]):
        encoding = "utf-16-le"
    else:
        encoding = "utf-8"
    try:
        text = data.decode(encoding)
    except UnicodeDecodeError:
        return None
    return text if len(text) >= 6 and text.translate({9: 32, 10: 32, 13: 32}).isprintable() else None


class TooLarge(Exception):
    pass


def _stream(new: Callable[[], object], data: bytes) -> bytes | None:
    try:
        made = new()
        out = made.decompress(data, MOST + 1)
    except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
        return None
    if len(out) > MOST:
        raise TooLarge
    return out or None


def _decompressed(data: bytes) -> tuple[str, bytes] | None:
    if data[:2] == b"\x1f\x8b":
        name, out = "gzip", _stream(lambda: zlib.decompressobj(31), data)
    elif len(data) > 2 and data[0] & 15 == 8 and data[0] >> 4 <= 7 and (data[0] << 8 | data[1]) % 31 == 0:
        name, out = "zlib", _stream(lambda: zlib.decompressobj(15), data)
    elif data[:3] == b"BZh":
        name, out = "bzip2", _stream(bz2.BZ2Decompressor, data)
    elif data[:6] == b"\xfd7zXZ\x00":
        name, out = "xz", _stream(lzma.LZMADecompressor, data)
    else:
        return None
    return (name, out) if out else None


def _bytes_of(run: str) -> bytes | None:
    run = run.rstrip("=")
    if len(run) % 4 == 1:
        return None
    return base64.b64decode(run.replace("-", "+").replace("_", "/") + "=" * (-len(run) % 4))


def _url(found: str) -> str | None:
    try:
        return bytes.fromhex(found.replace("%", "")).decode()
    except UnicodeDecodeError:
        return None


def _escaped(found: str) -> str | None:
    codes = [int(m, 16) for m in _ONE.findall(found)]
    if max(codes) > 0x10FFFF:
        return None
    try:
        return "".join(map(chr, codes)).encode("utf-16-le", "surrogatepass").decode("utf-16-le")
    except UnicodeDecodeError:
        return None


class Scan:
    """The worklist of one text."""

    def __init__(self, text: str):
        self.layers = deque([Layer(text, None, None, ())])
        self.seen: set[tuple[int, int, bytes]] = set()
        self.unread, self.read = 0, 0
        self.spans: dict[tuple[str, int, int], Span] = {}

    def run(self) -> list[Span]:
        while self.layers:
            layer = self.layers.popleft()
            path = ">".join(layer.path)
            for kind, a, b in matches(layer.text):
                at = (kind, *layer.origin(a, b))
                self.spans.setdefault(at, Span(*at, layer.text[a:b], path))
            self._unwrap(layer)
        own = {k: sorted((s.start, s.end) for s in self.spans.values() if s.kind == k and not s.layers) for k in KINDS}
        out = [s for s in self.spans.values() if not s.layers or not self._inside(s, own[s.kind])]
        return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind), s.end))

    @staticmethod
    def _inside(span: Span, base: list[tuple[int, int]]) -> bool:
        """Whether it lies in one of the base spans of its kind, which don't overlap."""
        i = bisect_right(base, (span.start, float("inf"))) - 1
        return i >= 0 and span.end <= base[i][1]

    def _unwrap(self, layer: Layer) -> None:
        text = layer.text
        if "\\" in text or "%u" in text:
            self._lines(layer, "unicode", _UNICODE, _escaped)
        if "%" in text:
            self._lines(layer, "url", _URL, _url)
        for m in _CODED.finditer(text):
            if not self._decode(layer, m.start(), m.end()):
                for part in _STRICT.finditer(text, m.start(), m.end()):
                    if part.span() != m.span():
                        self._decode(layer, *part.span())

    def _push(self, layer: Layer) -> None:
        """Cycles end here: the same text from the same place."""
        mark = (*layer.origin(0, len(layer.text)), hashlib.blake2b(layer.text.encode(errors="surrogatepass"), digest_size=16).digest())
        if mark not in self.seen:
            self.seen.add(mark)
            self.read += len(layer.text)
            if self.read > ALL:
                self.unread += 1
            else:
                self.layers.append(layer)

    def _lines(self, layer: Layer, name: str, escapes: re.Pattern, decode: Callable[[str], str | None]) -> None:
        """Each line with escapes, unescaped in place."""
        text, pos = layer.text, 0
        while m := escapes.search(text, pos):
            a = text.rfind("\n", 0, m.start()) + 1
            b = text.find("\n", m.end())
            b = pos = len(text) if b < 0 else b
            parts, first, after, at, changed = [], [], [], a, False
            for e in escapes.finditer(text, a, b):
                made = decode(e[0])
                if made is None:
                    continue
                changed = True
                parts += [text[at : e.start()], made]
                first += [np.arange(at, e.start()), np.full(len(made), e.start())]
                after += [np.arange(at, e.start()) + 1, np.full(len(made), e.end())]
                at = e.end()
            if changed:
                parts.append(text[at:b])
                first.append(np.arange(at, b))
                after.append(np.arange(at, b) + 1)
                start, end = layer.stretches(np.concatenate(first), np.concatenate(after))
                self._push(Layer("".join(parts), start, end, (*layer.path, name)))
            if pos >= len(text):
                break

    def _decode(self, layer: Layer, a: int, b: int) -> bool:
        """One run of base64, whole; whether it was anything."""
        run = layer.text[a:b]
        place = np.arange(a, b)
        if "\n" in run:
            kept = [i for i, c in enumerate(run) if c not in "\r\n"]
            run, place = "".join(run[i] for i in kept), place[kept]
        data = _bytes_of(run)
        if not data:
            return False
        path, marks, squeezed = (*layer.path, "base64"), {data}, False
        try:
            while made := _decompressed(data):
                name, data = made
                path, squeezed = (*path, name), True
                if data in marks:
                    return True
                marks.add(data)
        except TooLarge:
            self.unread += 1
            return True
        text = _readable(data)
        if text is None:
            return False
        if squeezed:
            x, y = layer.origin(a, b)
            self._push(Layer(text, np.full(len(text), x), np.full(len(text), y), path))
            return True
        wide = text.isascii() and len(data) == len(text)
        size = np.ones(len(text), np.int64) if wide else np.array([len(c.encode("utf-16-le" if len(data) >= 2 * len(text) and not any(data[1:40:2]) else "utf-8")) for c in text], np.int64)
        to = np.cumsum(size)
        start, end = layer.stretches(place[8 * (to - size) // 6], place[np.minimum((8 * to - 1) // 6, len(place) - 1)] + 1)
        self._push(Layer(text, start, end, path))
        return True


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("layers", pa.string())]))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans, unread = [], []
        for text in b["text"].to_pylist():
            scan = Scan(text or "")
            spans.append([s._asdict() for s in scan.run()])
            unread.append(scan.unread)
        yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), pa.array(spans, _SPANS), pa.array(unread, pa.int64())], names=["doc_id", "found", "unread"])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, found, unread): the secrets of every text in order (kind, start, end, value as it reads unwrapped, layers: empty for those of
    the base patterns, else how they were unwrapped), and how many layers were too large to be read."""
    return docs.select("doc_id", "text").mapInArrow(_scanned, "doc_id long, found array<struct<kind: string, start: long, end: long, value: string, layers: string>>, unread long")


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def digests(found: DataFrame) -> DataFrame:
    """Of scanned rows: doc_id, n_assign, n_access, n_hex (of the base patterns), base_sha256, spans, and n_wrapped, the spans that were added."""
    base = F.filter("found", lambda s: s["layers"] == "")
    counts = [F.size(_of_kind(base, k)).cast("long").alias(f"n_{k}") for k in KINDS]
    more = F.size(F.filter("found", lambda s: s["layers"] != "")).cast("long").alias("n_wrapped")
    return found.select("doc_id", *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("found")).alias("spans"), more, "unread")
