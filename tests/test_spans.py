"""Grids over all cuts without a label for each row and cut: same counts as from labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from outrate.operators import density, detectors, grids, spans
from outrate.operators import ratedistortion as rd
from outrate.operators.state import kept


def test_counted_and_foremost(spark):
    rng = np.random.default_rng(3)
    lo = rng.integers(0, 9000, 300)
    hi = lo + rng.integers(0, 6000, 300)
    v, p = rng.integers(0, 40, 300) / 4, rng.integers(1, 4, 300)
    table = kept(spark.createDataFrame([(int(a), int(b), float(c), int(d), int(d % 2)) for a, b, c, d in zip(lo, hi, v, p)], "lo long, hi long, v double, p long, tp long"))
    steps = [0, 1, 4095, 4096, 5000, 8191, 8192, 9001, 14000]
    asked = kept(spark.createDataFrame([(s, float(s % 9)) for s in steps] + [(77, None)], "step long, base double"))
    found = {(r.step, r.k): (r.p, r.tp) for r in spans.counted(table, asked, [0.5, 1.0, 2.0]).collect() if r.p}
    want = {}
    for s in steps:
        for i, k in enumerate((0.5, 1.0, 2.0)):
            on = (lo <= s) & (s < hi) & (v >= s % 9 / k)
            if on.any():
                want[s, i] = (int(p[on].sum()), int((p[on] % 2).sum()))
    assert found == want
    first = {r.step: r.m for r in spans.foremost(table, asked.select("step"), F.struct("v", "lo"), F.col("lo"), 14).collect()}
    assert first == {s: min((v[i], lo[i]) for i in np.flatnonzero((lo <= s) & (s < hi)))[1] for s in [*steps, 77] if ((lo <= s) & (s < hi)).any()}


@pytest.fixture(scope="module")
def some(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 800, (26, 2)) / 8
    x = np.concatenate([x, x[:6], x[:3], x[:3]])
    points = spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(rng.permutation(len(x)), x)], "row_id long, x array<double>")
    return grids.task(points, points.where("row_id % 5 = 0"), 2)


def _rows(df):
    return sorted(tuple(None if v is None else round(v, 9) for v in r) for r in df.select("grid_order", "p1", "p2", "tp", "fp", "fn", "tn").collect())


def test_cuts_without_labels(some, monkeypatch):
    """Equal rows, all four kinds and all multipliers; before, every row was labelled at every cut."""
    thetas = list(range(some.n - 1, 0, -1))
    measured = kept(rd.measure(grids.tree(some, thetas), 2))
    kinds = {kind: _rows(grids.scored(some, rd.purge_perturbed(measured, kind, 2), [(k, None) for k in thetas])) for kind in grids.KINDS}
    ks = [0.1, 1.0, 3.0]
    every = _rows(grids.scored_flags(some, rd.flagged_by(measured, ks), len(thetas), ks, thetas))
    monkeypatch.setattr(detectors, "cut", None)
    assert _rows(grids.cpp_hac(some, ks)) == every
    for kind, want in kinds.items():
        assert _rows(grids.cp_hac(some, kind)) == want, kind
    assert _rows(grids.cp_hac(some, thin=3)) == [(i // 3, *r[1:]) for i, r in enumerate(kinds["maxmax"]) if i % 3 == 0]


def test_density_without_labels(some, monkeypatch):
    """Equal rows, noise, borders, all four kinds and three multipliers; before, every row was labelled at every point of the grid."""
    clusters, near, grid = grids._density(some)
    measured = kept(density.represented(clusters, some.points, near, grid, 2))
    kinds = {kind: _rows(grids.scored(some, detectors.purge_density(measured, kind), grids._named(grid))) for kind in grids.KINDS}
    ks = [0.1, 1.0, 3.0]
    flags = grids.flag_counts(some, rd.flagged_by(measured, ks), ks)
    flags = sorted((r.grid * 3 + r.k, r.tp, r.p) for r in flags.collect())
    monkeypatch.setattr(density, "clusters", None)
    found = grids.cpp_dbscan(some, ks).where("tp + fp > 0").select("grid_order", F.col("tp").cast("long"), (F.col("tp") + F.col("fp")).cast("long"))
    assert sorted(tuple(r) for r in found.collect()) == flags
    for kind, want in kinds.items():
        assert _rows(grids.cp_dbscan(some, kind)) == want, kind
