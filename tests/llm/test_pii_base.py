"""The base spans of personal data of a whole given table, recomputed from the patterns as they are stated."""

import hashlib
import os
import re

import pytest

from outrate.llm import queries
from outrate.llm.common import ready

SF = "/root/testdata/sf0.001"


def _luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def _base(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.group().split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and _luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    return [(kind, *m.span()) for kind, (pattern, fits) in kinds.items() for m in re.finditer(pattern, text) if fits(m)]


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the given tables")
def test_base_spans_of_a_whole_table(spark):
    ready(spark)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = queries.op3_pii(spark, SF).collect()
    assert sorted(r.doc_id for r in found) == sorted(docs)
    some = 0
    for r in found:
        base = _base(docs[r.doc_id])
        some += len(base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in base) for kind in ("email", "ip", "card", "phone")]
        line = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(line).encode()).hexdigest()
        assert set(line) <= set(r.spans.split(",")) or not line
    assert some > 20
