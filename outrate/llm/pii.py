"""Personal data: exact patterns, and a semi-Markov conditional random field for what they miss.

The base patterns (email, ip, card, phone) are found on whole texts.  Lines that hold digits or ``@``
outside of base spans are cut into windows of tokens, and the semi-Markov model scores every segment
of up to ``LONGEST`` tokens by features of the whole span: its digits, separators, check sums, parts
and borders.  Dynamic programming chooses boundaries and types of all segments of a window together.
A segment is reported if it beats reading the same tokens as ordinary text by ``MARGIN`` (log odds),
and overlaps no base span; base spans always stay.

The model is trained anew on a bounded sample: the ``SAMPLE`` distinct snippets around digits or
``@`` with the smallest hashes, their first ``SNIPPET`` characters (no text is cut when spans are sought), labelled by the base patterns, and rewritings of them with other
separators, so that it learns the shape of a span rather than one notation.

Null and empty text: no spans.  Rows without doc_id and repeated rows are each scanned by themselves.
An empty table gives an empty result; without snippets only base spans are found.  Very long texts are
read whole, READ tokens at a time.  Extra columns, whatever their names, are ignored by ``find`` and kept by
``mask``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The base patterns.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

SAMPLE, SNIPPET, EPOCHS, RATE, DECAY = 400, 120, 6, 0.25, 1e-4
LONGEST, AROUND, MARGIN = 14, 5, 3.0
#: Tokens the model reads together, and those at the end that it only looks at: what begins there is read with the next ones.
READ, AHEAD = 400, 2 * LONGEST
#: Digits of the shortest phone number; an ip may have fewer, in LEAST_GROUPS groups.  What has neither, nor ``@``, can be no type.
LEAST_DIGITS, LEAST_GROUPS = 7, 4

Span = tuple[str, int, int]
_token = re.compile(r"[^\W\d_]+|[0-9]+|\S")
_hint = re.compile(r"[0-9@]+")
_digits = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Base spans by kind, then start; code points, end exclusive."""
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:  # from each @ to both sides, which takes linear time where a search from the left may not
        a = at
        while a > end and LOCAL.match(text, a - 1):
            a -= 1
        m = DOMAIN.match(text, at) if a < at else None
        if m:
            out.append(("email", a, end := m.end()))
        at = text.find("@", m.end() if m else at + 1)
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


# -- features of whole spans

FEATURES = 44


def _features(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> list[int]:
    """Numbers of the features that tokens i..j-1, taken as one span, have."""
    a, b = tokens[i][0], tokens[j - 1][1]
    s = text[a:b]
    digits = sum(c in "0123456789" for c in s)
    letters = sum(c.isalpha() for c in s)
    on = [0, 1 + min(9, (0, 1, 2, 2, 3, 3, 3, 4, 5, 5, 6, 6, 7, 7, 7, 7, 8, 8, 8, 8)[digits] if digits < 20 else 9)]
    at, dots = s.count("@"), s.count(".")
    on.append(11 + min(at, 2))
    on.append(14 + (0 if not letters else 1 if digits or at else 2))
    on.append(17 + min(3, j - i - 1) if j - i < 4 else 20 + (j - i >= 8))
    if a == 0 or text[a - 1].isspace():
        on.append(22)
    if b == len(text) or text[b].isspace() or text[b] in ".,;:!?)":
        on.append(23)
    if (a and text[a - 1] in "0123456789") or (b < len(text) and text[b] in "0123456789"):
        on.append(24)
    if s[0] in "0123456789" and s[-1] in "0123456789":
        on.append(25)
    if s[0] in "+(" and s[-1] in "0123456789":
        on.append(26)
    if not (s[0].isalnum() or s[0] in "+(") or not s[-1].isalnum():
        on.append(27)
    parts = re.split(r"[^0-9]+", s.strip(" .()+-/"))
    if 16 <= digits <= 19 and not letters and luhn("".join(parts)):
        on.append(28)
    if len(parts) == 4 and not letters and all(p and len(p) <= 3 and int(p) <= 255 for p in parts):
        on.append(29)
    if at == 1 and re.fullmatch(r"\s*[\w.%+-]+\s*@\s*[\w-]+(\s*\.\s*[\w-]+)+\s*", s):
        on.append(30)
    if at == 1 and dots and re.search(r"\.\s*[A-Za-z]{2,6}$", s):
        on.append(31)
    if re.search(r"\s", s):
        on.append(32)
    if re.search(r"[^\w\s.@%+()/-]", s):
        on.append(33)
    if "(" in s and ")" in s:
        on.append(34)
    if re.fullmatch(r"[0-9]{4}(.?[0-9]{4}){3}", s):
        on.append(35)
    if not letters and re.fullmatch(r"[0-9]{3}\D{1,2}[0-9]{4}", s[-9:].lstrip(" ()-./")):
        on.append(36)
    if not letters and len(set(re.findall(r"[^0-9\s]", s))) > 2:
        on.append(37)
    if not letters and not at and digits:
        on.append(38)
    if at and not dots:
        on.append(39)
    if not letters and len(parts) == 1:
        on.append(40)
    if not letters and 2 <= len(parts) <= 3:
        on.append(41)
    if not letters and len(parts) > 4:
        on.append(42)
    if s.count(" ") > 5:
        on.append(43)
    return on


def tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _token.finditer(text)]


def lattice(text: str, toks: list[tuple[int, int]]) -> dict[tuple[int, int], list[int]]:
    """Features of all segments that could be an entity: they begin and end in a token with a letter, a digit, ``+`` or ``(``, and hold a digit or ``@``."""
    out, n = {}, len(toks)
    hint = [text[a] in "0123456789@" for a, _ in toks]
    ends = [text[b - 1].isalnum() for _, b in toks]
    begins = [text[a].isalnum() or text[a] in "+(" for a, _ in toks]
    for i in range(n):
        if begins[i]:
            seen = False
            for j in range(i + 1, min(n, i + LONGEST) + 1):
                seen |= hint[j - 1]
                if seen and ends[j - 1]:
                    out[i, j] = _features(text, toks, i, j)
    return out


# -- the model: weights of shape (kinds, FEATURES), and of one kind of segment after another

Model = tuple[np.ndarray, np.ndarray]
OTHER = len(KINDS)


def _lse(x: np.ndarray, axis: int | None = None) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis) if axis is not None else float(m.squeeze() + np.log(np.exp(x - m).sum()))


def _scores(model: Model, spans: dict[tuple[int, int], list[int]]) -> dict[tuple[int, int], np.ndarray]:
    return {k: model[0][:, f].sum(axis=1) for k, f in spans.items()}


def _by_end(spans: dict[tuple[int, int], np.ndarray]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, j in spans:
        out.setdefault(j, []).append(i)
    return out


def _gradient(model: Model, n: int, feats: dict[tuple[int, int], list[int]], gold: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log likelihood of a labelled window.  gold: begin -> (end, kind) of its entities; other tokens are segments of their own."""
    score, step = _scores(model, feats), model[1]
    ends = _by_end(feats)
    begins: dict[int, list[int]] = {}
    for i, j in feats:
        begins.setdefault(i, []).append(j)
    low = -1e9
    # ahead[j, k]: all ways to read tokens before j that end in a segment of kind k; the start counts as OTHER
    ahead = np.full((n + 1, OTHER + 1), low)
    ahead[0, OTHER] = 0.0
    enter = np.full((n + 1, OTHER + 1), low)  # by the kind that follows
    for j in range(n + 1):
        if j:
            ahead[j, OTHER] = enter[j - 1, OTHER]
            if j in ends:
                ahead[j, :OTHER] = _lse(np.array([enter[i, :OTHER] + score[i, j] for i in ends[j]]), 0)
        enter[j] = _lse(ahead[j][:, None] + step, 0)
    behind = np.full((n + 1, OTHER + 1), low)  # by the kind before
    behind[n] = 0.0
    for i in range(n - 1, -1, -1):
        out = np.full(OTHER + 1, low)
        out[OTHER] = behind[i + 1, OTHER]
        if i in begins:
            out[:OTHER] = _lse(np.array([behind[j, :OTHER] + score[i, j] for j in begins[i]]), 0)
        behind[i] = _lse(step + out[None, :], 1)
    total = behind[0, OTHER]
    g, s = np.zeros_like(model[0]), np.zeros_like(step)
    for (i, j), f in feats.items():
        p = np.exp(np.minimum(enter[i, :OTHER] + score[i, j] + behind[j, :OTHER] - total, 0))
        g[:, f] -= p[:, None]
    for i in range(n):
        out = np.full(OTHER + 1, low)
        out[OTHER] = behind[i + 1, OTHER]
        if i in begins:
            out[:OTHER] = _lse(np.array([behind[j, :OTHER] + score[i, j] for j in begins[i]]), 0)
        s -= np.exp(np.minimum(ahead[i][:, None] + step + out[None, :] - total, 0))
    i, last = 0, OTHER
    while i < n:
        j, k = gold.get(i, (i + 1, OTHER))
        s[last, k] += 1
        if k < OTHER:
            g[k, feats[i, j]] += 1
        i, last = j, k
    return g, s


def path(model: Model, n: int, feats: dict[tuple[int, int], list[int]], start: int = OTHER) -> list[tuple[int, int, int, bool]]:
    """(begin, end, kind, whether it passes MARGIN) of the entities on the best path after a segment of kind start."""
    score, step = _scores(model, feats), model[1]
    ends = _by_end(feats)
    best = np.full((n + 1, OTHER + 1), -np.inf)
    best[0, start] = 0.0
    back: dict[tuple[int, int], tuple[int, int]] = {}
    for j in range(1, n + 1):
        before = best[j - 1] + step[:, OTHER]
        best[j, OTHER], back[j, OTHER] = before.max(), (j - 1, int(before.argmax()))
        for i in ends.get(j, ()):
            reach = best[i][:, None] + step[:, :OTHER]
            value = reach.max(axis=0) + score[i, j]
            for k in np.flatnonzero(value > best[j, :OTHER]):
                best[j, k], back[j, int(k)] = value[k], (i, int(reach[:, k].argmax()))
    out, j, k = [], n, int(best[n].argmax())
    while j:
        i, last = back[j, k]
        if k < OTHER:
            over = step[last, k] + score[i, j][k] + step[k, OTHER] - step[last, OTHER] - (j - i) * step[OTHER, OTHER]
            out.append((i, j, k, bool(over >= MARGIN)))
        j, k = i, last
    return out[::-1]


def decode(model: Model, n: int, feats: dict[tuple[int, int], list[int]]) -> list[tuple[int, int, int]]:
    """(begin, end, kind) of the entities on the best path that pass MARGIN."""
    return [(i, j, k) for i, j, k, passes in path(model, n, feats) if passes]


def _labelled(text: str, spans: list[Span]) -> tuple[int, dict, dict] | None:
    toks = tokens(text)
    feats = lattice(text, toks)
    first, last, gold = {a: i for i, (a, _) in enumerate(toks)}, {b: i + 1 for i, (_, b) in enumerate(toks)}, {}
    free = 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a in first and b in last and (first[a], last[b]) in feats and first[a] >= free:
            gold[first[a]] = (last[b], KINDS.index(kind))
            free = last[b]
    return (len(toks), feats, gold) if toks and len(gold) == len(spans) else None


def _rewritten(text: str, spans: list[Span], rng: np.random.Generator) -> list[tuple[str, list[Span]]]:
    """The snippet with its only span in other notations."""
    if len(spans) != 1:
        return []
    (kind, a, b), out = spans[0], []
    s = text[a:b]
    d = re.sub("[^0-9]", "", s)
    sep = ("-", ".", " ", "/")[rng.integers(4)]
    if kind == "email":
        forms = [s.replace("@", " @ "), s.replace(".", " . ").replace("@", " @ ")]
    elif kind == "ip":
        forms = [s.replace(".", " . ")]
    elif kind == "card":
        forms = [sep.join(d[k : k + 4] for k in range(0, len(d), 4)), " - ".join(d[k : k + 4] for k in range(0, len(d), 4))]
    else:
        forms = [f"({d[-10:-7]}) {d[-7:-4]}-{d[-4:]}", sep.join((d[-10:-7], d[-7:-4], d[-4:])), f"+{d[:-10]}{sep}{sep.join((d[-10:-7], d[-7:-4], d[-4:]))}"] if len(d) > 10 else []
    for f in forms:
        out.append((text[:a] + f + text[b:], [(kind, a, a + len(f))]))
    if kind == "card":  # a broken check sum is no card, a number with letters nothing at all
        out.append((text[:a] + d[:-1] + str((int(d[-1]) + 1) % 10) + text[b:], []))
        out.append((text[:a] + d[:7] + "e" + d[7:] + text[b:], []))
    return out


def train(snippets: list[str]) -> Model:
    rng = np.random.default_rng(3)
    data = []
    for text in snippets:
        spans = base_spans(text)
        for t, s in [(text, spans), *_rewritten(text, spans, rng)]:
            if (x := _labelled(t, s)) is not None:
                data.append(x)
    model = np.zeros((OTHER, FEATURES)), np.zeros((OTHER + 1, OTHER + 1))
    model[0][:, 0] = -2.0
    seen = np.full_like(model[0], 1e-2), np.full_like(model[1], 1e-2)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(data)):
            for w, v, g in zip(model, seen, _gradient(model, *data[k]), strict=True):
                g = g - DECAY * w
                v += g * g
                w += RATE * g / np.sqrt(v)
    return model


# -- applied to texts


def _windows(text: str, base: list[Span]) -> Iterator[tuple[int, int]]:
    """Begin and end of the stretches that the model reads: around hints outside of base spans, within their lines."""
    taken = sorted((a, b) for _, a, b in base)
    k, at = 0, None
    for m in _hint.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k < len(taken) and taken[k][0] < m.end():
            continue
        a, b = max(0, m.start() - 40), min(len(text), m.end() + 60)
        a = max(a, text.rfind("\n", a, m.start()) + 1)
        b = x if (x := text.find("\n", m.end(), b)) >= 0 else b
        if at and a <= at[1]:
            at = at[0], max(b, at[1])
        else:
            if at:
                yield at
            at = a, b
    if at:
        yield at


def _worth(s: str) -> bool:
    groups = _digits.findall(s)
    return "@" in s or len(groups) >= LEAST_GROUPS or sum(map(len, groups)) >= LEAST_DIGITS


def _read(model: Model, s: str) -> Iterator[tuple[int, int, int]]:
    """(begin, end, kind) of the entities in a stretch, which is read by READ tokens at a time: bounded memory for a line of digits.

    Borders of spans are those of the stretch.  Each part decides on segments that begin before its last AHEAD tokens, so all of them
    lie within it; the next part begins there, or where the last of them ends.
    """
    toks, p, last = tokens(s), 0, OTHER
    while p < len(toks):
        part = toks[p : p + READ]
        more = p + READ < len(toks)
        decided = len(part) - AHEAD if more else len(part)
        to, after = decided, OTHER
        if _worth(s[part[0][0] : part[-1][1]]):
            for i, j, k, passes in path(model, len(part), lattice(s, part), last):
                if i < decided:
                    if passes:
                        yield part[i][0], part[j - 1][1], k
                    if j >= to:
                        to, after = j, k
        p, last = p + to, after


def spans(text: str, model: Model | None) -> list[Span]:
    """Base spans and the model's, by kind as listed, then start."""
    base = base_spans(text)
    found = list(base)
    if model is not None:
        for a, b in _windows(text, base):
            for x, y, k in _read(model, text[a:b]):
                if all(a + y <= p or q <= a + x for _, p, q in base):  # the model's own never overlap
                    found.append((KINDS[k], a + x, a + y))
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1]))


def written(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def _snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = set()
        for text in b["text"].to_pylist():
            end = -1
            for m in _hint.finditer(text or ""):
                if m.start() >= end:
                    a, end = max(0, m.start() - 30), m.end() + 40
                    out.add(text[max(a, text.rfind("\n", a, m.start()) + 1) : end].partition("\n")[0] if "\n" in text[m.end() : end] else text[max(a, text.rfind("\n", a, m.start()) + 1) : end])
        yield pa.RecordBatch.from_arrays([pa.array([x for x in out if _hint.search(x)], pa.string())], names=["snippet"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from a bounded sample of the documents' snippets."""
    found = docs.select("text").mapInArrow(_snippets, "snippet string").distinct()
    rows = found.orderBy(F.xxhash64("snippet"), "snippet").limit(sample).collect()
    return train([r.snippet[:SNIPPET] for r in rows]) if rows else None


def _per_text(model: Model | None, make: Callable[[list[Span], list[Span], str], tuple], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"].to_pylist(), strict=True):
                text = text or ""
                base = base_spans(text)
                rows.append((doc.as_py(), *make(base, spans(text, model) if _hint.search(text) else base, text)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _digest(base: list[Span], found: list[Span], text: str) -> tuple:
    return (*(sum(k == x for k, *_ in base) for x in KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(found), len(found) - len(base))


def find(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, numbers of base spans, base_sha256, spans, n_added."""
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_per_text(model, _digest, schema), "doc_id long, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string, n_added long")


def masked(text: str, found: list[Span]) -> str:
    """The text with every span replaced by its kind; of overlapping spans the first stands for all."""
    out, at = [], 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with personal data in their texts replaced, other columns as they were.  Rows keep their order and partitions."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [t if t is None or not _hint.search(t) else masked(t, spans(t, model)) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if k == at else b.column(k) for k in range(b.num_columns)], names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)
