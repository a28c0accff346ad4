"""Features and scores of co-training, row by row in plain Python."""

import math
import random
import re
import struct

import pytest

from outrate.llm import cotraining as co
from outrate.llm.common import ready

EDGES = [0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 0.9]
GROUPS = [rb"[A-Z]", rb"[0-9]", rb"\.", rb",", rb"[!?]", rb"[#*$%&|<>]", rb"\n", rb"[\"'()=+_/@]", rb" "]


def _styles(text):
    data = (text or "").encode()
    shares = [len(re.findall(g, data)) / max(len(data), 1) for g in GROUPS]
    words = [w.lower() for w in re.split(rb"[ \t-\r]+", data) if w]
    n = max(len(words), 1)
    shares += [1 - len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:])) / n, min(sum(map(len, words)) / n / 20, 1)]
    return bytes(sum(e < s for e in EDGES) for s in shares), len(words)


def test_every_row(spark):
    ready(spark)
    rng = random.Random(3)
    texts = ["".join(rng.choice(["ab ", "Cd, ", "e9. ", "x!? ", "#*\n", "ü ", "(q) ", "long-word-here "]) for _ in range(rng.randint(1, 90))) for _ in range(240)]
    texts += [None, "", " \n\t ", "w", "Word " * 60_000, texts[0], texts[0]]  # no words, a very long text, repeated ones
    rows = [(i, t, rng.choice(["en", None]), f"s{i % 3}", rng.choice([None, len(t or "")])) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "no id", None, None, None)]  # repeated rows
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = spark.createDataFrame([(i, int((t or "").count("#") < 4)) for i, t, *_ in rows[:160]], "doc_id long, quality int")
    feats = co.features(docs)
    model = co.train(feats, labels)
    assert model is not None
    found = {r.doc_id: r for r in feats.collect()}
    want = {}
    for i, text, *_ in rows:
        style, n = _styles(text)
        words, meta = struct.unpack(f"<{co.WORDS}I", found[i].words), struct.unpack(f"<{co.META}H", found[i].meta)
        assert found[i].style == style and sum(words) == n, (i, style, found[i].style)
        one = sum(model.text[co._AT[1] + k * co.RANGES + s] for k, s in enumerate(style)), sum(c / max(n, 1) * model.text[co._AT[2] + k] for k, c in enumerate(words))
        two = sum(model.meta[co._AT[3] + k * co.BINS + m] for k, m in enumerate(meta))
        view = [one[0] * model.text_fit[0] + one[1] * model.text_fit[1] + model.text_fit[2], two * model.meta_fit[0] + model.meta_fit[1]]
        want[i] = [*view, 1 / (1 + math.exp(-(view[0] * model.both[0] + view[1] * model.both[1] + model.both[2])))]
    got = co.score(feats, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert [r.text_score, r.meta_score, r.score] == pytest.approx(want[r.doc_id], abs=1e-4)
        assert r.kept == (r.score >= 0.5)
