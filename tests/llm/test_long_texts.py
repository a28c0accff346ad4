"""Very long texts: operators that take whole texts in parts give what brute force gives on the whole."""

import base64
import hashlib
import random

import pytest

from outrate.llm import forest, quality_rules, repeats, tiling, warc
from outrate.llm.common import ready, scratch_path


@pytest.fixture(scope="module")
def long_rows():
    rng = random.Random(31)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9)))
    one = " ".join(word() for _ in range(190_000))  # over a megabyte
    shared = " ".join(word() for _ in range(60))
    two = " ".join(word() for _ in range(100_000)) + " " + shared + " " + one[600_000:601_500] + " " + " ".join(word() for _ in range(10_000)) + " " + shared
    near = one.split()
    for k in range(0, len(near), 1000):
        near[k] = "changed"
    return [(0, one), (1, two), (2, " ".join(near)), (3, "a short one with nothing to share " + shared), (4, None), (5, "")]


@pytest.fixture(scope="module")
def long_docs(spark, long_rows):
    ready(spark)
    return spark.createDataFrame(long_rows, "doc_id long, text string")


def test_repeats(long_docs, long_rows):
    data = {i: (t or "").encode() for i, t in long_rows}
    assert sum(len(b) > 2 * repeats.PIECE for b in data.values()) == 2
    seen: dict[bytes, int] = {}
    for b in data.values():
        for i in range(len(b) - 199):
            key = hashlib.blake2b(b[i : i + 200], digest_size=12).digest()
            seen[key] = seen.get(key, 0) + 1
    for r in repeats.remove(long_docs).collect():
        b, gone = data[r.doc_id], bytearray(len(data[r.doc_id]))
        for i in range(len(b) - 199):
            if seen[hashlib.blake2b(b[i : i + 200], digest_size=12).digest()] > 1:
                gone[i : i + 200] = b"\1" * 200
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        kept = bytes(x for x, y in zip(b, gone) if not y)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()), r.doc_id


def test_near_copies(long_docs, long_rows):
    sets = {}
    for i, t in long_rows:
        w = (t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    assert 100 * len(sets[0] & sets[2]) >= 85 * len(sets[0] | sets[2])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in forest.group(long_docs).collect()}
    assert got == {i: (len(s), 0 if i == 2 else i) for i, s in sets.items()}


def test_tiling(spark, long_docs, long_rows):
    item = long_rows[3][1].split(" share ")[1]
    found = {r.doc_id: r.covered for r in tiling.contaminated(long_docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert found == {1: 60, 3: 60}


def test_quality(long_docs, long_rows):
    got = {r.doc_id: r.n_words for r in quality_rules.judge(long_docs, ["doc_id"]).collect()}
    assert got == {i: len((t or "").split()) for i, t in long_rows}


def test_warc(spark, long_rows):
    path = scratch_path(spark, "test-warc-long")
    warc.write(spark.createDataFrame([(i, "u", t) for i, t in long_rows], "page_id long, url string, html string"), path, roll=100_000)
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.read(spark, path).collect()}
    assert got == {i: (len((t or "").encode()), base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()) for i, t in long_rows}
