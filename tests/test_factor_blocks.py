"""The cluster-based factor at every point of a density grid, by blocks of rows."""

import math

import numpy as np
import pytest

from outrate.operators import density, neighbors
from outrate.operators.state import kept


@pytest.mark.parametrize(("block", "most"), [(7, None), (7, 5), (64, 5)])
def test_factors_read_no_lists_to_their_ends(spark, monkeypatch, block, most):
    monkeypatch.setattr(density, "BLOCK", block)
    monkeypatch.setattr(density, "nearest_where", None)  # lists that grow until each row meets one of a large cluster
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(0, 5, (40, 2)), 1)
    x[30:33] = x[3]  # equal rows, so that the smaller id decides
    labels = {0: rng.integers(0, 4, 40), 1: np.concatenate([np.zeros(3, int), np.arange(37) + 1]), 2: np.zeros(40, int)}
    large = {0: 2, 1: 1, 2: 0}
    points = kept(spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "row_id long, x array<double>"))
    clusters = kept(spark.createDataFrame([(g, i, int(c), large[g]) for g, of in labels.items() for i, c in enumerate(of)], "grid long, row_id long, cluster long, large long"))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    d1, want = d.min(axis=1), {}
    for g, of in labels.items():
        size = {int(c): (of == c).sum() for c in np.unique(of)}
        big = sorted(size, key=lambda c: (-size[c], c))[: large[g]]
        some = np.flatnonzero(np.isin(of, big))
        for i in range(40):
            if of[i] in big:
                want[g, i] = size[of[i]] * (d1[i] - d1[of == of[i]].mean())
            elif len(some):
                j = some[d[i, some].argmin()]
                want[g, i] = size[of[i]] * (d[i, j] - d1[of == of[j]].mean())
    near = kept(neighbors.knn(points, 3, 2))
    got = {(r.grid, r.row_id): r.score for r in density.cblof_knn(clusters, points, near, 2, most).collect()}
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got) and set(got) <= set(want)
    if most is None:
        assert got.keys() == want.keys()
    else:  # the highest of all are among the highest of their blocks
        for g in (0, 1):
            of = [k for k in want if k[0] == g]
            edge = sorted((round(want[k], 9) for k in of), reverse=True)[most - 1]
            assert {k for k in of if round(want[k], 9) >= edge} <= got.keys()
        assert len(got) < len(want) or block == 7 and math.ceil(40 / block) * most >= 40
    assert not any(g == 2 for g, _ in got)  # one cluster has no large one
