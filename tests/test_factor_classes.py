"""Local outlier factors for every k: equal rows are measured once, and the same rows are on top."""

import numpy as np
from pyspark.sql import functions as F

from outrate.operators import factors, grids
from outrate.operators.state import kept


def test_equal_rows_are_one_class_for_every_k(spark, monkeypatch):
    monkeypatch.setattr(factors, "LISTED", 0)
    monkeypatch.setattr(factors, "TOGETHER", 5)
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(0, 2, (9, 2)), 1)[rng.integers(0, 9, 24)]
    x[23] = [30.0, 1.0]
    points = kept(spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "row_id long, x array<double>"))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    ks = list(range(23, 0, -1))
    got = {(r.k, r.row_id): r.score for r in factors.lof_every(points, ks, 2).collect()}
    assert len(got) == 24 * 23
    want = {}
    with np.errstate(all="ignore"):
        for k in ks:
            kd = np.sort(d, axis=1)[:, k - 1]
            near = d <= kd[:, None]
            lrd = near.sum(axis=1) / np.where(near, np.maximum(d, kd[None]), 0.0).sum(axis=1)
            score = np.array([lrd[n].mean() for n in near]) / lrd
            want |= {(k, i): score[i] for i in range(24)}
    np.testing.assert_allclose([got[k] for k in sorted(got)], [want[k] for k in sorted(got)], rtol=1e-9)
    truth = {0, 5, 11, 23}
    task = grids.task(points, spark.createDataFrame([(i,) for i in truth], "row_id long"), 2)
    monkeypatch.setattr(factors, "lof_every", None)  # a score for each row and k
    rows = {r.p1: (r.tp, r.tp + r.fp) for r in grids.lof(task).select("p1", F.col("tp"), F.col("fp")).collect()}
    for k in ks:
        order = sorted(range(24), key=lambda i: (not np.isnan(got[k, i]), -round(got[k, i], 9) if not np.isnan(got[k, i]) else 0, -i))[:4]
        assert rows[k] == (len(truth & set(order)), 4), k


def test_sums_from_ranks_are_sums_one_by_one(monkeypatch):
    """Several ks are a product of matrices; ties, weights, a row itself, and infinite densities."""
    monkeypatch.setattr(factors, "WIDE", 4)
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 9, (7, 1)), rng.integers(0, 9, (12, 1))
    d, w = np.abs(a - b.T).astype(float), rng.integers(0, 3, (7, 12)).astype(float)
    kd, other = (np.sort(rng.integers(0, 9, (n, 19)), axis=1).astype(float) for n in (7, 12))
    lrd = np.where(rng.random((12, 19)) < 0.1, np.inf, rng.random((12, 19)))
    for reach, values in ((True, other), (False, lrd)):
        for got, want in zip(factors._from_ranks(d, w, kd, values, reach), factors._one_by_one(d, w, kd, values, reach)):
            np.testing.assert_allclose(got, want, rtol=1e-12)
