"""Quality scores by co-training: one naive Bayes classifier reads the text, another only the page's metadata.

Every document becomes two short lists of numbers: what its text is like (ranges of shares of letters, digits, symbols, words seen before and
words equal to the one just before them, and how often words of each hash occur), and hashes of its metadata.  Both classifiers start from a bounded sample of
labelled documents.  In each round both score all documents; those that either is sure of (a calibrated probability of SURE) teach
the other.  What is learned from them are counts by class, summed in Spark over the whole table; nothing is sampled on that side, so it
grows with the input.  Taught and labelled counts weigh the same, and the classes' shares stay those of the labels.

A held-out fifth of the labelled sample, from which neither learns, calibrates each view's log odds in each round, and at the end
the weights with which the views are added.  All documents are then scored in one scan.

Null and empty text: the features of an empty text.  Null metadata: a value of its own.  Rows of one doc_id, or without one, are scored
each for itself.  Labels that are null or without a document are ignored; of several labels of a document each counts.  Without labels
of both kinds every score is 0.5 and all are kept.  An empty table gives an empty result.  Extra columns, whatever their names, are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outrate.llm.common import table
from outrate.llm.shingles import buffers, sequences

#: Labelled documents that the classifiers start from, at most.
LABELLED = 2000
ROUNDS, SURE, SMOOTH = 3, 0.95, 1.0
#: Bins for words, and for each of META kinds of metadata.
WORDS, META, BINS = 256, 4, 1024
#: Documents with a score below it are not kept.
KEEP = 0.5
_EDGES = np.array([0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 0.9])
_CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",", "!?", "#*$%&|<>", "\n", "\"'()=+_/@", " ")
_class = np.full(256, len(_CLASSES), np.uint8)
for _k, _s in enumerate(_CLASSES):
    _class[np.frombuffer(_s.encode(), np.uint8)] = _k
RANGES = len(_EDGES) + 1
STYLES = len(_CLASSES) + 3


def text_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text the range that each share falls in, and how many words have each hash."""
    style, hashed = np.zeros((len(texts), STYLES), np.uint8), np.zeros((len(texts), WORDS), np.int64)
    data, offsets = buffers(texts)
    for a, words, first, begin, end, at in sequences(texts):
        rows = len(at) - 1
        some = data[offsets[a] : offsets[a] + at[-1]]
        size = np.maximum(np.diff(at), 1)
        which = np.repeat(np.arange(rows), np.diff(at))
        shares = list((np.bincount(which * 16 + _class[some], minlength=16 * rows).reshape(rows, 16)[:, : len(_CLASSES)] / size[:, None]).T)
        owner = np.repeat(np.arange(rows), np.diff(first))
        count = np.maximum(np.diff(first), 1)
        order = np.lexsort((words, owner))
        o, w = owner[order], words[order]
        new = np.bincount(o[np.concatenate([[True], (o[1:] != o[:-1]) | (w[1:] != w[:-1])])] if len(o) else o, minlength=rows)
        same = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
        again = np.bincount(owner[1:][same], minlength=rows)
        length = np.bincount(owner, (end - begin).astype(float), minlength=rows) / count
        shares += [1 - new / count, again / count, np.minimum(length / 20, 1)]
        for k, s in enumerate(shares):
            style[a : a + rows, k] = np.searchsorted(_EDGES, s)
        hashed[a : a + rows] = np.bincount(owner * WORDS + (words >> np.uint64(56)).astype(np.int64), minlength=rows * WORDS).reshape(rows, WORDS)
    return style, hashed


_features = pa.schema([("doc_id", pa.int64()), ("style", pa.binary(STYLES)), ("words", pa.binary(4 * WORDS)), ("meta", pa.binary(2 * META))])
FEATURES = "doc_id long, style binary, words binary, meta binary"


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        style, hashed = text_features(b["text"])
        meta = np.stack([b[f"m{k}"].to_numpy() for k in range(META)], axis=1).astype("<u2")
        raw = [pa.FixedSizeBinaryArray.from_buffers(t, b.num_rows, [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary()) for t, x in zip((_features[1].type, _features[2].type, _features[3].type), (style, hashed.astype("<u4"), meta), strict=True)]
        yield pa.RecordBatch.from_arrays([b["doc_id"], *raw], names=_features.names)


def features(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source, n_chars) -> the features of every row, written to the shared folder."""
    size = F.floor(F.log2(F.greatest(F.coalesce("n_chars", F.lit(0)).cast("long"), F.lit(0)) + 1) * 2)
    kinds = (F.col("lang"), F.col("source"), size, F.concat_ws("/", size, F.coalesce("lang", F.lit("?"))))
    bins = [F.pmod(F.xxhash64(F.lit(k), F.coalesce(x.cast("string"), F.lit("\0"))), F.lit(BINS)).cast("int").alias(f"m{k}") for k, x in enumerate(kinds)]
    return table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *bins).mapInArrow(_featured, FEATURES), "features")


class Rows(NamedTuple):
    style: np.ndarray
    words: np.ndarray
    meta: np.ndarray


def _rows(style: pa.Array, words: pa.Array, meta: pa.Array) -> Rows:
    parts = (b"".join(x.as_buffer() for x in c) for c in (style, words, meta))
    s, w, m = parts
    return Rows(np.frombuffer(s, np.uint8).reshape(-1, STYLES), np.frombuffer(w, "<u4").reshape(-1, WORDS), np.frombuffer(m, "<u2").reshape(-1, META))


#: Counts by class: how many documents, styles, word hashes (each document's add up to one), and metadata.
SIZES = (1, STYLES * RANGES, WORDS, META * BINS)
_AT = np.cumsum((0, *SIZES))


def _counts(x: Rows, weight: np.ndarray, text: bool) -> np.ndarray:
    """Sums over rows of what one view sees, in millionths; weight: 0 or 1."""
    out = np.zeros(_AT[-1])
    some = np.flatnonzero(weight)
    out[0] = len(some)
    if text:
        at = x.style[some].astype(np.int64) + np.arange(STYLES) * RANGES
        out[_AT[1] : _AT[2]] = np.bincount(at.ravel(), minlength=SIZES[1])
        w = x.words[some]
        out[_AT[2] : _AT[3]] = (w / np.maximum(w.sum(axis=1, keepdims=True), 1)).sum(axis=0)
    else:
        at = x.meta[some].astype(np.int64) + np.arange(META) * BINS
        out[_AT[3] :] = np.bincount(at.ravel(), minlength=SIZES[3])
    return np.round(out * 1e6).astype(np.int64)


def _odds(labelled: np.ndarray, taught: np.ndarray) -> np.ndarray:
    """Log odds of every slot for class 1 from counts (class, slot): labelled and taught distributions have equal weight."""
    p = np.zeros((2, _AT[-1]))
    for counts in (labelled, taught):
        for c in (0, 1):
            for k in (1, 2, 3):
                part = slice(_AT[k], _AT[k + 1])
                groups = (STYLES, 1, META)[k - 1]
                n = counts[c, part].reshape(groups, -1) / 1e6
                if n.sum():
                    p[c, part] += ((n + SMOOTH / n.shape[1]) / (n.sum(axis=1, keepdims=True) + SMOOTH)).ravel()
    p = np.where(p > 0, p, 1.0)
    return np.log(p[1]) - np.log(p[0])


def _views(x: Rows, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of the parts of each view: (styles, words) and (metadata)."""
    style = text[x.style.astype(np.int64) + np.arange(STYLES) * RANGES + _AT[1]].sum(axis=1)
    words = (x.words / np.maximum(x.words.sum(axis=1, keepdims=True), 1)) @ text[_AT[2] : _AT[3]]
    return np.stack([style, words], axis=1), meta[x.meta.astype(np.int64) + np.arange(META) * BINS + _AT[3]].sum(axis=1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights and, last, the intercept of a ridge logistic regression on a few columns, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(len(w)), x.T @ (p - y) / len(x) + ridge * w)
    return w


def _calibrated(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


class Model(NamedTuple):
    text: np.ndarray
    meta: np.ndarray
    text_fit: np.ndarray
    meta_fit: np.ndarray
    both: np.ndarray


def _teach(model: Model):
    """Counts by class that the rows either view is sure of teach the other: slots of (view, class, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, limit = np.zeros((2, 2, _AT[-1]), np.int64), np.log(SURE / (1 - SURE))
        for b in batches:
            if b.num_rows:
                x = _rows(b["style"], b["words"], b["meta"])
                text, meta = (_calibrated(v, w) for v, w in zip(_views(x, model.text, model.meta), (model.text_fit, model.meta_fit), strict=True))
                for view, teacher in ((0, meta), (1, text)):
                    total[view, 0] += _counts(x, teacher <= -limit, view == 0)
                    total[view, 1] += _counts(x, teacher >= limit, view == 0)
        some = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total.ravel()[some])], names=["slot", "n"])

    return run


def train(feats: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> Model | None:
    """feats: of ``features``; labels (doc_id, quality) -> the classifiers, or None without labels of both kinds."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").cast("int").alias("quality"))
    sample = known.orderBy(F.xxhash64("__id"), "__id", "quality").limit(LABELLED).collect()
    chosen = feats.sparkSession.createDataFrame(sample, "__id long, quality int")  # LABELLED rows at most
    found = feats.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("quality", "style", "words", "meta").collect()
    found.sort(key=lambda r: (r.style, r.words, r.meta, r.quality))
    order = np.random.default_rng(5).permutation(len(found))
    y = np.array([float(found[i].quality > 0) for i in order])
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[~held].tolist())) < 2 or len(set(y[held].tolist())) < 2:
        return None
    every = _rows(*(pa.array([found[i][c] for i in order], pa.binary()) for c in ("style", "words", "meta")))
    learn, hold = (Rows(*(c[m] for c in every)) for m in (~held, held))
    own = np.stack([np.stack([_counts(learn, y[~held] == c, view == 0) for c in (0, 1)]) for view in (0, 1)])
    taught = np.zeros_like(own)
    unlabelled = feats.join(F.broadcast(chosen.select("__id").distinct()), F.col("doc_id") == F.col("__id"), "left_anti").select("style", "words", "meta")
    for k in range(rounds + 1):
        text, meta = (_odds(own[v], taught[v]) for v in (0, 1))
        parts = _views(hold, text, meta)
        fits = [fit(p, y[held]) for p in parts]
        model = Model(text, meta, *fits, fit(np.stack([_calibrated(p, w) for p, w in zip(parts, fits, strict=True)], axis=1), y[held]))
        if k < rounds:
            before, taught = taught, np.zeros_like(own)
            for r in unlabelled.mapInArrow(_teach(model), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # the slots of the counts at most
                taught.ravel()[r.slot] = r.n
            if (taught == before).all():
                break
    return model


def score(feats: DataFrame, model: Model | None) -> DataFrame:
    """feats -> doc_id, text_score, meta_score (calibrated log odds), score (probability of quality), kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two, p = np.zeros(b.num_rows), np.zeros(b.num_rows), np.full(b.num_rows, 0.5)
            if model is not None and b.num_rows:
                parts = _views(_rows(b["style"], b["words"], b["meta"]), model.text, model.meta)
                one, two = (_calibrated(v, w) for v, w in zip(parts, (model.text_fit, model.meta_fit), strict=True))
                p = 1 / (1 + np.exp(-_calibrated(np.stack([one, two], axis=1), model.both)))
            one, two, p = (np.round(x, 4) for x in (one, two, p))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(one), pa.array(two), pa.array(p), pa.array(p >= KEEP)], names=["doc_id", "text_score", "meta_score", "score", "kept"])

    return feats.mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, kept boolean")
