"""Grid searches, detectors for many parameters at once, and sources, against brute force on small fixtures."""

import hashlib
import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from outrate.operators import blocks, density, detectors, factors, grids, neighbors
from outrate.operators import ratedistortion as rd
from outrate.operators.state import kept
from outrate.sources import points as sources

rng = random.Random(11)
X = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(28)] + [(rng.gauss(6, 0.5), rng.gauss(6, 0.5)) for _ in range(12)] + [(20.0, 1.0), (-9.0, 8.0)]
TRUTH = {0, 7, 40, 41}
A = np.array(X)
D = np.sqrt(((A[:, None] - A[None]) ** 2).sum(axis=2))


@pytest.fixture(scope="module")
def points(spark):
    return kept(spark.createDataFrame([(i, list(p)) for i, p in enumerate(X)], "row_id long, x array<double>"))


@pytest.fixture(scope="module")
def task(spark, points):
    return grids.task(points, spark.createDataFrame([(i,) for i in TRUTH], "row_id long"), 2)


def _metrics(found):
    tp, p, n, m = len(found & TRUTH), len(found), len(X), len(TRUTH)
    if not tp:
        return 0.0, 0.0, 0.0, 0.0
    fp, fn = p - tp, m - tp
    tn = n - m - fp
    mcc = (tp * tn - fp * fn) / math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) if tn else 0.0
    return tp / p, tp / m, 2 * tp / (p + m), mcc


def _same(graded, want):
    rows = {r.grid_order: r for r in graded.collect()}
    assert len(rows) == len(want)
    for g, found in enumerate(want):
        assert (rows[g].precision, rows[g].recall, rows[g].f_score, rows[g].mcc) == pytest.approx(_metrics(found)), (g, rows[g])


@pytest.mark.parametrize("rows", [7, 1024])
def test_blocks(points, rows, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", rows)
    far = np.where(np.eye(len(X), dtype=bool), np.inf, D)
    got = {(r.a, r.rk): r.b for r in neighbors.knn(points, 3, 2).collect()}
    assert got == {(i, k + 1): int(j) for i in range(len(X)) for k, j in enumerate(np.argsort(far[i], kind="stable")[:3])}
    near = {r.row_id: r.b for r in neighbors.nearest_in(points, points.where("row_id < 5"), 2).collect()}
    assert near == {i: int(np.argmin(far[i, :5])) for i in range(len(X))}
    ties = points.sparkSession.createDataFrame([(i, [float(i)]) for i in range(6)], "row_id long, x array<double>")
    assert {(r.a, r.b) for r in neighbors.knn_with_ties(ties, 1, 1).collect()} == {(a, b) for a in range(6) for b in range(6) if abs(a - b) == 1}


def test_purging_by_one_move(spark, points):
    labels = [(i, 1 if i < 28 else 2 if i < 40 else 3 + i % 2) for i in range(len(X))]
    clusters = spark.createDataFrame(labels, "row_id long, cluster long").join(points, "row_id")
    measured = kept(rd.measure(clusters.withColumn("grid", F.lit(5)), 2))
    for kind in ("maxmax", "maxmin", "minmax", "minmin"):
        want = {r.row_id for r in rd.purge(rd.with_perturbed(clusters, kind, 2), 2).collect()}
        assert {r.row_id for r in rd.purge_perturbed(measured, kind, 2).collect()} == want
    ks = [0.5, 1.0, 2.0, 4.0]
    flags = {r.row_id: r.flags for r in rd.flagged_by(measured, ks).collect()}
    found = {(r.row_id, r.k) for r in rd.purge_parametric(rd.single(clusters), 2, ks).collect()}
    assert found == {(i, k) for i, n in flags.items() for k in ks[len(ks) - n :]}


def _dense(eps, least):
    core = [i for i in range(len(X)) if (D[i] <= eps).sum() >= least]
    label = {i: i for i in core}
    for _ in core:
        for i, j in combinations(core, 2):
            if D[i, j] <= eps:
                label[i] = label[j] = min(label[i], label[j])
    for i in range(len(X)):
        near = [label[j] for j in core if D[i, j] <= eps]
        if i not in core and near:
            label[i] = min(near)
    return label


def test_density_grids(spark, points, task):
    graded = kept(grids.dbscan_noise(task))
    want = [(least, eps) for least in range(3, 13) for eps in sorted({np.sort(D[i])[least] for i in range(len(X))})]
    rows = sorted(graded.collect(), key=lambda r: r.grid_order)
    assert [(r.p1, r.p2) for r in rows] == [(p, pytest.approx(e)) for p, e in want]
    for r in rows[::9]:
        assert r.recall == pytest.approx(_metrics(set(range(len(X))) - set(_dense(r.p2 + 1e-12, int(r.p1))))[1])
    clusters, near, grid = grids.density(task)
    params = [(r.least, r.eps) for r in grid.orderBy("grid").collect()]
    assert params == [(p, pytest.approx(e)) for p, e in want]
    got = {(r.grid, r.row_id): r.cluster for r in clusters.collect()}
    assert len(got) == len(params) * len(X)
    measured = kept(density.represented(clusters, points, near, grid, 2))
    purged = {(r.grid, r.row_id) for r in detectors.purge_density(measured, "maxmax").collect()}
    flags = {(r.grid, r.row_id): r.flags for r in rd.flagged_by(measured, [1.0]).collect()}
    for g, (least, eps) in list(enumerate(params))[::23]:
        label = _dense(eps, least)
        own = [got[g, i] for i in range(len(X))]
        assert all(own[i] == label[i] for i in label) and len({own[i] for i in range(len(X)) if i not in label} - set(label.values())) == len(X) - len(label)

        def parts(names, eps=eps):
            d = np.array([min([D[i, j] for j in range(len(X)) if j != i and names[j] == names[i] and D[i, j] <= eps], default=0.0) for i in range(len(X))])
            f = np.array([names.count(c) for c in names], float)
            return d, f, d.sum(), math.log2(len(X)) - np.log2(f).sum() / len(X)

        d, f, total, h = parts(own)
        change = np.array([(a * math.log2(a) - (a - 1) * (math.log2(a - 1) if a > 1 else 0)) / len(X) if a > 1 else 0.0 for a in f])
        most = min((-own.count(c), c) for c in set(own))[1]
        moved = min((-round(d[i], 9), i) for i in range(len(X)) if own[i] == most)[1]
        _, _, total2, h2 = parts([10**6 if i == moved else c for i, c in enumerate(own)])
        ok = total2 < total and h2 > h
        slope = (h - h2) / (total - total2) if ok else None
        assert {i for q, i in purged if q == g} == ({i for i in range(len(X)) if round(d[i] + change[i] / slope, 9) >= 0} if ok else set())
        assert {i for i in range(len(X)) if flags[g, i]} == {i for i in range(len(X)) if d[i] >= change[i] * total}
    factor = {}
    large = clusters.groupBy("grid").agg(F.lit(2).alias("large"))
    for r in density.cblof_knn(clusters.join(large, "grid"), points, near, 2).collect():
        factor[r.grid, r.row_id] = r.score
    assert len(factor) == len(got)
    d1 = np.where(np.eye(len(X), dtype=bool), np.inf, D).min(axis=1)
    for g in range(0, len(params), 31):
        own = [got[g, i] for i in range(len(X))]
        big = sorted(set(own), key=lambda c: (-own.count(c), c))[:2]
        mean = {c: np.mean([d1[i] for i, x in enumerate(own) if x == c]) for c in big}
        for i, c in enumerate(own):
            j = i if c in big else min((j for j in range(len(X)) if own[j] in big), key=lambda j: (D[i, j], j))
            assert factor[g, i] == pytest.approx(own.count(c) * ((d1[i] if c in big else D[i, j]) - mean[own[j]]))


def _tree():
    groups, cuts = [[i] for i in range(len(X))], {}
    while True:
        cuts[len(groups)] = [sorted(g) for g in groups]
        if len(groups) == 1:
            return cuts
        _, i, j = min((max(D[a, b] for a in p for b in q), min(p), min(q)) for p, q in combinations(sorted(groups, key=min), 2))
        p, q = (next(g for g in groups if min(g) == k) for k in (i, j))
        groups = [g for g in groups if g is not p and g is not q] + [p + q]


def test_tree_grids(task):
    cuts = _tree()
    thetas = list(range(len(X), 0, -1))
    got = {}
    for r in grids.tree(task, thetas).collect():
        got.setdefault((r.grid, r.cluster), []).append(r.row_id)
    assert all(sorted(sorted(v) for (g, _), v in got.items() if g == i) == sorted(cuts[t]) for i, t in enumerate(thetas))
    _same(grids.hac_singletons(task), [{g[0] for g in cuts[t] if len(g) == 1} for t in thetas])
    for search in (grids.cblof_hac, grids.cp_hac, grids.cpp_hac):
        assert grids.winners(search(task, thin=9)).count() == 4


def _lloyd(c):
    while True:
        a = np.round(np.sqrt(((A[:, None] - c[None]) ** 2).sum(axis=2)), 9).argmin(axis=1)
        new = np.array([A[a == k].mean(axis=0) for k in range(len(c)) if (a == k).any()])
        if new.shape == c.shape and np.allclose(new, c, atol=1e-12):
            return a
        c = new


def test_center_grids(task):
    ks = [5, 3, 2]
    labels = [_lloyd(A[:k]) for k in ks]
    _same(grids.kmeans_singletons(task, ks), [{int(i) for i in range(len(X)) if (a == a[i]).sum() == 1} for a in labels])
    got = {(r.grid, r.row_id): r.cluster for r in grids.kmeans(task, ks).collect()}
    assert all(len({(got[g, i], int(a[i])) for i in range(len(X))}) == len(set(a.tolist())) for g, a in enumerate(labels))
    cost = {n: {r.grid: r.c for r in grids.kmeans(task, ks, n).groupBy("grid").agg(F.sum(F.col("d") * F.col("d")).alias("c")).collect()} for n in (1, 4)}
    assert all(cost[4][g] <= cost[1][g] + 1e-9 for g in range(3))

    want = []
    for k in ks:  # k-means--
        c = A[:k]
        while True:
            d = np.sqrt(((A[:, None] - c[None]) ** 2).sum(axis=2))
            a, d = np.round(d, 9).argmin(axis=1), d.min(axis=1)
            out = sorted(range(len(X)), key=lambda i, d=d: (-round(d[i], 9), i))[: len(TRUTH)]
            rest = np.array([i not in out for i in range(len(X))])
            new = np.array([A[rest & (a == j)].mean(axis=0) for j in range(len(c)) if (rest & (a == j)).any()])
            if new.shape == c.shape and np.allclose(new, c, atol=1e-12):
                break
            c = new
        want.append(set(out))
    _same(grids.kmeans_mm(task, ks), want)

    want = []
    for k in ks[1:]:  # outlier removal
        for gamma in (1.2, 2.0):
            c, cut = A[:k], np.inf
            for r in range(10):
                d = np.sqrt(((A[:, None] - c[None]) ** 2).sum(axis=2))
                a, d = np.round(d, 9).argmin(axis=1), d.min(axis=1)
                cut = gamma * d[d <= cut].mean()
                if r < 9:
                    c = np.array([A[(d <= cut) & (a == j)].mean(axis=0) for j in range(len(c)) if ((d <= cut) & (a == j)).any()])
            want.append({i for i in range(len(X)) if d[i] > cut})
    _same(grids.kmor(task, ks[1:], [1.2, 2.0]), want)
    for search in (grids.cblof_kmeans, grids.cp_kmeans, grids.cpp_kmeans):
        assert grids.winners(search(task, ks)).count() == 4
    w = {r.metric: r for r in grids.winners(grids.kmeans_mm(task, ks)).collect()}
    values = [_metrics(f) for f in [set()]]
    assert set(w) == {"precision", "recall", "f_score", "mcc"} and values == [(0.0, 0.0, 0.0, 0.0)]


def test_factor_and_rank_grids(task):
    def lof(k):
        far = np.where(np.eye(len(X), dtype=bool), np.inf, D)
        kd = np.sort(far, axis=1)[:, k - 1]
        near = [np.flatnonzero(far[i] <= kd[i]) for i in range(len(X))]
        lrd = np.array([len(n) / np.maximum(D[i, n], kd[n]).sum() for i, n in enumerate(near)])
        return [lrd[n].mean() / lrd[i] for i, n in enumerate(near)]

    top = lambda s: set(sorted(range(len(X)), key=lambda i: (-s[i], -i))[: len(TRUTH)])
    ks = [20, 6, 2]
    _same(grids.lof(task, ks), [top(lof(k)) for k in ks])
    every = {(r.k, r.row_id): r.score for r in factors.lof_every(task.points, list(range(1, len(X))), 2).collect()}
    assert len(every) == len(X) * (len(X) - 1)
    for k in range(1, len(X)):
        assert [every[k, i] for i in range(len(X))] == pytest.approx(lof(k))
    z = (A - A.mean(axis=0)) / A.std(axis=0, ddof=1)
    far = np.where(np.eye(len(X), dtype=bool), np.inf, D)
    score = lambda k: [np.linalg.svd(z[np.argsort(far[i], kind="stable")[:k]], compute_uv=False)[:2].sum() for i in range(len(X))]
    _same(grids.lps(task, [5, 2]), [top(score(5)), top(score(2))])
    betas = grids.spread(0.1, 10, len(X))[::10]
    want = []
    for beta in betas:
        w, q = z.mean(axis=0), 0.5
        for _ in range(10):
            p = np.exp2(-beta * np.sqrt(((z - w) ** 2).sum(axis=1)))
            rate = np.minimum(1, len(X) * q * p)
            new = (rate[:, None] * z).sum(axis=0) / len(X), (rate == 1).sum() / len(X) + q * p[rate < 1].sum()
            if ((w - new[0]) ** 2).sum() <= 1e-10:
                break
            w, q = new
        want.append({int(i) for i in np.flatnonzero(rate < 1)})
    _same(grids.ocrd(task, thin=10), want)


def test_competition(task):
    found = grids.competition({"one": task, "two": task}, {"noise": grids.dbscan_noise, "mm": lambda t: grids.kmeans_mm(t, [3])}).cache()
    assert found.count() == 4 and found.where("seconds > 0").count() == 4
    table = {r.dataset: r for r in grids.wide(found, "recall").collect()}
    assert table["one"].noise == table["two"].noise and set(table) == {"one", "two"}
    assert {r.detector for r in grids.report(found).collect()} == {"noise", "mm"}


def test_sources(spark, points, tmp_path):
    sources.write_arff(points.withColumn("is_outlier", F.col("row_id").isin(sorted(TRUTH))), str(tmp_path / "p"), ["a", "b"])
    got = {r.src_id: (r.x, r.is_outlier, r.dataset) for r in sources.datasets(spark, {"p": str(tmp_path / "p")}).collect()}
    assert got == {float(i): (list(p), i in TRUTH, "p") for i, p in enumerate(X)}
    for sep in (" ", ","):
        path = str(tmp_path / f"s{ord(sep)}")
        sources.write_separated(points, path, sep)
        assert [r.x for r in sources.separated(spark, path, 2, sep).orderBy("row_id").collect()] == [list(p) for p in X]


def test_sparse_noise(spark):
    data = [(i, [float(i), 45.0]) for i in range(0, 60, 5)]
    got = sorted((r.row_id, tuple(r.x)) for r in sources.sparse_noise(spark.createDataFrame(data, "row_id long, x array<double>"), 40, drawn=10).collect())
    (x0, x1), (y0, y1) = sources.NOISE_BOX
    unit = lambda i, seed: (int(hashlib.md5(f"{i}:{seed}".encode()).hexdigest()[:12], 16) + 1) / 2**48
    rows = [(i, x0 + (x1 - x0) * unit(i, 1), y0 + (y1 - y0) * unit(i, 2)) for i in range(4, 404)]
    kept_rows = [(i, p) for i, p in enumerate(sources.NOISE_FIRST)]
    for i, *p in rows:
        if all(math.dist(p, q) >= 3.5 for _, q in kept_rows) and all(math.dist(p, q) >= 3.5 for _, q in data):
            kept_rows.append((i, tuple(p)))
    assert got == kept_rows[:40]
    one = spark.createDataFrame([(0, [0.0, 0.0])], "row_id long, x array<double>")
    assert sources.sparse_noise(one, 12, drawn=1).count() == 12  # more is drawn where too few are accepted
    with pytest.raises(ValueError, match="no room"):
        sources.sparse_noise(one, 100_000, drawn=1, most=10)


def test_tree_sql_with_equal_rows(spark, tmp_path):
    """SQL and query of the tree agree where rows and merges tie."""
    import duckdb

    from outrate.plans import queries

    values = [1.0, 1.0, 2.0, 3.0, 3.0, 3.0, 9.0, 10.0, 12.0, 13.0, 30.0, 80.0]
    spark.createDataFrame([(i, i % 3, v) for i, v in enumerate(values)], "s_suppkey long, s_nationkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    duckdb.sql(f"CREATE OR REPLACE VIEW supplier AS FROM '{tmp_path}/supplier.parquet/*.parquet'")
    for name in ("hac", "hac_singletons"):
        found, want = queries.QUERIES[name](spark, str(tmp_path)), duckdb.sql(queries.SQL[name])
        rows = sorted(tuple(r) for r in found.select(want.columns).collect())
        assert rows and rows == sorted(want.fetchall())


def test_reference_modes(spark, points, task):
    """What the originals' slips give, recomputed row by row; labels and places count from 1."""
    labels = [1 + (i % 3 if i < 28 else 3 if i < 40 else i - 36) for i in range(len(X))]  # four clusters of more rows, two of one
    size = {c: labels.count(c) for c in set(labels)}
    order = sorted(size, key=lambda c: (-size[c], c))
    mean = {c: A[[i for i, x in enumerate(labels) if x == c]].mean(axis=0) for c in size}
    sizes, big = [size[c] for c in order], set(order[:2])
    centers = [mean[labels[c - 1]] for c in big]
    want = [sizes[c - 1] * (math.dist(p, mean[c]) if c in big else min(math.dist(p, m) for m in centers)) for p, c in zip(X, labels, strict=True)]
    rows = kept(points.join(spark.createDataFrame(list(enumerate(labels)), "row_id long, cluster long"), "row_id"))
    got = {r.row_id: r.score for r in detectors.cblof(rows, 2, 2, "reference").collect()}
    assert [got[i] for i in range(len(X))] == pytest.approx(want)

    d1 = np.where(np.eye(len(X), dtype=bool), np.inf, D).min(axis=1)
    means = [np.mean([d1[i] for i, x in enumerate(labels) if x == c]) for c in dict.fromkeys(labels)]
    for i, c in enumerate(labels):
        j = i if c in big else min((j for j in range(len(X)) if labels[j] in big), key=lambda j: (D[i, j], j))
        at = c - 1 if c in big else j
        want[i] = sizes[c - 1] * ((d1[i] if c in big else D[i, j]) - means[at] / size[labels[j]]) if at < len(means) else None
    got = {r.row_id: r.score for r in detectors.cblof_knn(rows, 2, 2, "reference").collect()}
    assert None in want and [i for i in got if got[i] is None] == [i for i in range(len(X)) if want[i] is None]
    assert [got[i] for i in got if got[i] is not None] == pytest.approx([want[i] for i in got if want[i] is not None])

    z = (A - A.mean(axis=0)) / A.std(axis=0, ddof=1)
    got = {r.row_id: r.score for r in detectors.lps(points, 5, 2, 2, "reference").collect()}
    for i in range(len(X)):
        far = np.where(np.arange(len(X)) == i, np.inf, D[i])
        u, d, v = np.linalg.svd(z[np.argsort(far, kind="stable")[:5]], full_matrices=False)
        product = sum(d[k] * np.outer(u[k], v.T[k]) for k in range(2))
        assert got[i] == pytest.approx(np.linalg.norm(product, "nuc"))
    assert detectors.cblof(rows.where("false"), 2, 2, "reference").count() == 0 and detectors.cblof_knn(rows.where("false"), 2, 2, "reference").count() == 0
    assert [(r.p1, r.p2) for r in grids.cpp_hac(task, [1.0, 2.0], mode="reference").select("p1", "p2").orderBy("p2").collect()] == [(len(X) - 1.0, 1.0), (len(X) - 1.0, 2.0)]


def test_opposite_moves_end_the_reference_mode(spark):
    """Two centers that move by the same way towards each other's other side: their moves cancel, and the first round is the last."""
    line = [4.0, 6.0, 0.0, 0.0, 10.0, 10.0, -40.0]
    rows = spark.createDataFrame([(i, [x]) for i, x in enumerate(line)], "row_id long, x array<double>")
    start = spark.createDataFrame([(1, [4.0]), (2, [6.0])], "center long, c array<double>")
    found = {m: {r.row_id: r.d for r in detectors.kmeans_mm(rows, start, 1, 1, mode=m).collect()} for m in ("canonical", "reference")}
    assert found["reference"] == {6: 44.0} and found["canonical"][6] == pytest.approx(40 + 4 / 3)
