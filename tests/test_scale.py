"""What keeps operators from meeting everything with everything: blocks, forests, running sums, merged hulls, readers by ranges."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from outrate.operators import blocks, density, detectors, grids, linkage, neighbors, prefix
from outrate.operators import ratedistortion as rd
from outrate.operators.state import kept
from outrate.sources import points as sources

POINTS = "row_id long, x array<double>"


def _frame(spark, x):
    return kept(spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], POINTS))


def _clustered(n=900, dims=6, groups=15, seed=2):
    rng = np.random.default_rng(seed)
    return rng.normal(0, 20, (groups, dims))[rng.integers(0, groups, n)] + rng.normal(0, 1, (n, dims))


@pytest.mark.parametrize("rows", [40, 64])
def test_neighbours_of_clusters_cost_a_third_at_most(spark, rows, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", rows)
    x = _clustered()
    x[100:160] = x[100]  # equal rows fill more than a block
    points, n = _frame(spark, x), len(x)
    d = blocks.distances(x, x)
    np.fill_diagonal(d, np.inf)
    seen = spark.sparkContext.accumulator(0)
    got = {(r.a, r.rk): (r.b, r.d) for r in neighbors.knn(points, 4, 6, seen).collect()}
    order = np.argsort(d, axis=1, kind="stable")[:, :4]
    assert got == {(i, k + 1): (int(j), d[i, j]) for i in range(n) for k, j in enumerate(order[i])}
    assert seen.value < n * n / 3
    ties = {(r.a, r.b) for r in neighbors.knn_with_ties(points, 3, 6).collect()}
    kth = np.sort(d, axis=1)[:, 2:3]
    assert ties == set(zip(*(v.tolist() for v in np.nonzero(d <= kth))))
    some = points.where("row_id % 7 = 3")
    near = {r.row_id: r.b for r in neighbors.nearest_in(points, some, 6).collect()}
    ids = np.arange(3, n, 7)
    assert near == {i: int(ids[np.argmin(d[i, ids])]) for i in range(n)}


def test_radius_join_in_many_dimensions(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 50)
    x = _clustered()
    points, n = _frame(spark, x), len(x)
    d = blocks.distances(x, x)
    np.fill_diagonal(d, np.inf)
    for eps in (0.0, 1.5, 4.0):
        seen = spark.sparkContext.accumulator(0)
        got = {(r.a, r.b) for r in neighbors.within(points, eps, 6, seen).collect()}
        assert got == set(zip(*(v.tolist() for v in np.nonzero(d <= eps))))
        assert seen.value < n * n / 3
    assert neighbors.within(points.where("false"), 1.0, 6).count() == neighbors.knn(points.where("false"), 2, 6).count() == 0


def test_forest_cuts_are_density_clusters(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 25)
    rng = random.Random(4)
    x = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(50)] + [(rng.gauss(15, 1), rng.gauss(0, 1)) for _ in range(40)] + [(30.0, 30.0)] * 5 + [(60.0 + i, 0.0) for i in range(6)]
    points, n = _frame(spark, x), len(x)
    d = blocks.distances(np.array(x), np.array(x))
    near = kept(neighbors.knn(points, 3, 2))  # short lists: many rows have to search
    tree = density.forest(points, near, [1, 3, 4], 2)
    grid = [(g, e, k) for g, (k, e) in enumerate((k, e) for k in (1, 3, 4) for e in (0.0, 0.4, 1.0, 1.5, 14.0, 31.0, 40.0, 1000.0))]
    got = {(r.grid, r.row_id): r.cluster for r in density.clusters(points, near, tree, spark.createDataFrame(grid, "grid long, eps double, least int")).collect()}
    for g, eps, least in grid:
        core = [i for i in range(n) if (d[i] <= eps).sum() >= least]
        label = {i: i for i in core}
        while True:
            new = {i: min(label[j] for j in core if d[i, j] <= eps) for i in core}
            if new == label:
                break
            label = new
        want = {i: label.get(i, min((label[j] for j in core if d[i, j] <= eps), default=None)) for i in range(n)}
        assert {i: got[g, i] for i in range(n)} == want, (eps, least)


def test_numbers_and_running_sums(spark):
    rng = random.Random(5)
    rows = [(i, float(rng.randrange(50)), rng.randrange(5)) for i in range(700)]
    df = spark.createDataFrame(rows, "i long, v double, w long").repartition(7)
    place = {r.i: r.n for r in prefix.numbered(df, ["v", "i"], "n").collect()}
    assert place == {i: k for k, (i, *_) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1)}
    for r in prefix.running(df, "v", ["w"]).collect():
        assert r.sum_w == sum(w for _, v, w in rows if v <= r.v)
    assert prefix.running(df.where("false"), "v", ["w"]).count() == prefix.numbered(df.where("false"), ["i"], "n").count() == 0


def test_roc_of_any_number_of_multipliers(spark):
    x = _clustered(60, 2, 4)
    points = _frame(spark, x)
    t = grids.task(points, points.where("row_id % 7 = 0"), 2)
    clusters = points.select(F.lit(0).alias("grid"), "row_id", (F.col("row_id") % 4).alias("cluster"), "x")
    ks = [0.01 + 0.07 * i for i in range(200)]
    got = sorted((r.k, r.fpr, r.tpr) for r in grids.roc(t, clusters, ks).collect())
    flags = {r.row_id: r.flags for r in rd.flagged_by(kept(rd.measure(clusters, 2)), ks).collect()}
    for i, (k, fpr, tpr) in enumerate(got):
        found = [r for r, f in flags.items() if i >= len(ks) - f]
        assert (k, tpr, fpr) == (pytest.approx(ks[i]), pytest.approx(sum(r % 7 == 0 for r in found) / t.m), pytest.approx(sum(r % 7 != 0 for r in found) / (t.n - t.m)))


def test_hulls_merge(spark):
    rng = random.Random(6)
    values = [(i, float(rng.randrange(40)), float(rng.randrange(40))) for i in range(300)]
    (hull,) = ([(r.distortion, r.entropy, r.clustering_id) for r in rd.lower_hull(spark.createDataFrame(values, "clustering_id long, distortion double, entropy double").repartition(9)).orderBy("curve_pos").collect()],)
    least = {}
    for i, d, h in values:
        least[d] = min(least.get(d, (math.inf, 0)), (h, i))
    p = sorted((d, h, i) for d, (h, i) in least.items())
    on = [q for q in p if not any(a[0] < q[0] < b[0] and (q[1] - a[1]) * (b[0] - a[0]) >= (b[1] - a[1]) * (q[0] - a[0]) for a in p for b in p)]
    assert hull == [q for k, q in enumerate(on) if not k or q[1] < on[k - 1][1]]
    many = spark.range(100_000).select(F.col("id").alias("clustering_id"), (F.col("id") * 0.37 % 997).alias("distortion"), (F.col("id") * 0.73 % 499).alias("entropy"))
    assert 1 <= rd.lower_hull(many).count() < 100
    assert rd.lower_hull(many.where("false")).count() == 0


@pytest.mark.parametrize("ranges", [1, 16])
def test_readers_by_ranges(spark, tmp_path, ranges):
    """Row numbers don't depend on how many ranges of bytes a file is read by."""
    values = [(i * 1.5, -i) for i in range(400)]
    values[30:35] = [values[30]] * 5  # repeated rows
    (tmp_path / "d").mkdir()
    for k, name in enumerate(("b.txt", "a.txt", "c.txt")):
        part = values[[1, 0, 2][k] * 100 : [1, 0, 2][k] * 100 + (100 if k < 2 else 200)]
        (tmp_path / "d" / name).write_text("".join(f"{a} {b}\n" + "\n" * (i % 3) for i, (a, b) in enumerate(part)) + "\n \n")
    head = "% comment\n@RELATION 'odd one'\n\n@attribute 'first value' real\n@ATTRIBUTE \"it's, second\" numeric\n@ATTRIBUTE id real\n@ATTRIBUTE outlier {'no','yes'}\n\n@DATA\n"
    (tmp_path / "e.arff").write_text(head + "".join(f"{a}, '{b}',{i},'{'yes' if i % 9 == 0 else 'no'}'\n" + "% between\n\n" * (i % 2) for i, (a, b) in enumerate(values)) + "?,1,400,no\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        if ranges > 1:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str((tmp_path / "e.arff").stat().st_size // ranges))
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            assert sources.lines(spark, str(tmp_path / "e.arff")).select("start").distinct().count() >= ranges
        rows = sorted((r.row_id, tuple(r.x)) for r in sources.separated(spark, str(tmp_path / "d"), 2).collect())
        assert rows == [(i, (a, float(b))) for i, (a, b) in enumerate(values, 1)]
        found = sources.arff(spark, str(tmp_path / "e.arff")).orderBy("row_id").collect()
        assert [(r.row_id, tuple(r.x), r.src_id, r.is_outlier) for r in found[:-1]] == [(i + 1, (a, float(b)), float(i), i % 9 == 0) for i, (a, b) in enumerate(values)]
        assert found[-1].x == [None, 1.0] and found[-1].row_id == 401
        assert sources.arff(spark, str(tmp_path / "e.arff"), "positional").first().x[1] is not None
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_transfers_end_where_none_helps(spark):
    """Sums of squares are not above Lloyd's, and no single row's change of cluster lessens them: recomputed by brute force."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(m, 1.5, (25, 2)) for m in ((0, 0), (5, 0), (2, 5))])
    points = _frame(spark, x)
    init = points.where("row_id < 5").select((F.col("row_id") + 1).alias("center"), F.col("x").alias("c"))
    centers = detectors.started(init, {0: 5, 2: 3, 4: 2})
    cost = lambda rows: {g: sum(r.d**2 for r in rows if r.grid == g) for g in (0, 2, 4)}
    before, rows = cost(detectors.lloyd_all(points, centers, 2).collect()), detectors.hartigan_all(points, centers, 2, 2).collect()
    after = cost(rows)
    for g in (0, 2, 4):
        assert after[g] <= before[g] + 1e-9
        own = {r.row_id: r.cluster for r in rows if r.grid == g}
        assert len(own) == len(x)
        sse = lambda labels: sum(((x[[i for i in labels if labels[i] == c]] - x[[i for i in labels if labels[i] == c]].mean(axis=0)) ** 2).sum() for c in set(labels.values()))
        assert sse(own) == pytest.approx(after[g])
        for i in range(0, len(x), 4):
            for c in set(own.values()) - {own[i]}:
                assert sse({**own, i: c}) >= after[g] - 1e-7


def test_means_meet_rows_where_they_lie(spark):
    """Few means, whose size is known, are broadcast: no row is shuffled to meet its cluster's mean."""
    rows = spark.range(2000).select(F.lit(1).alias("clustering_id"), F.col("id").alias("row_id"), (F.col("id") % 3).alias("cluster"), F.array(F.col("id").cast("double")).alias("x"))
    plan = rd.represent(rows, 1)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_starts_are_drawn_in_one_pass(spark):
    """Each start's rows are those that sorting all rows by the start's hash gives, over several partitions and with fewer rows than asked."""
    points = _frame(spark, np.random.default_rng(3).normal(size=(300, 2))).repartition(7)
    for some, k in ((points, 6), (points.where("row_id < 4"), 6), (points.where("false"), 6)):
        got = detectors.drawn(some, k, 3, 2)
        for s in range(3):
            order = ["row_id"] if s == 0 else [F.xxhash64("row_id", F.lit(s)), "row_id"]
            assert got[s].tolist() == [r.x for r in some.orderBy(*order).limit(k).collect()]


def test_grids_of_centers_do_not_disturb_each_other(spark):
    """Grids that stand still early are left out of later rounds; each ends as it does alone, also where rows of a batch are taken in parts."""
    points = _frame(spark, np.random.default_rng(5).normal(size=(200, 2)))
    starts = detectors.drawn(points, 4, 4, 2)
    centers = {g: (np.arange(2 + g % 3), starts[g][: 2 + g % 3]) for g in range(4)}
    together = detectors.advanced(points, centers, 2)
    for g in centers:
        x, c = np.array([r.x for r in points.orderBy("row_id").collect()]), centers[g][1]
        for _ in range(100):
            own = np.linalg.norm(x[:, None] - c[None], axis=2).argmin(axis=1)
            c = np.array([x[own == k].mean(axis=0) for k in range(len(c)) if (own == k).any()])
        assert together[g][1] == pytest.approx(c)


def test_evaluation_is_one_table(spark):
    """Every winner is the greatest of its grid; the ablation holds each clustering under each perturbation."""
    data = {}
    for name, seed in (("a", 3), ("b", 5)):
        points = _frame(spark, _clustered(24, 2, 3, seed))
        data[name] = grids.task(points, points.where("row_id % 6 = 0"), 2)
    some = {n: grids.SEARCHERS[n] for n in ("kmeans_mm", "dbscan_noise", "lof", "lps")}
    every = kept(grids.graded(data, some))
    found = {(r.dataset, r.detector): r for r in grids.competition(data, some).collect()}
    assert set(found) == {(d, s) for d in data for s in some}
    for key, r in found.items():
        rows = [x for x in every.collect() if (x.dataset, x.detector) == key]
        assert [r[m] for m in grids.METRICS] == pytest.approx([max(x[m] for x in rows) for m in grids.METRICS])
    t = data["a"]
    ks = {f"kmeans_{k}": lambda t, k=k: grids.cp_kmeans(t, [4, 2], kind=k) for k in grids.KINDS}
    rows = kept(rd.measure(grids._with_rows(grids.task(t.points, t.truth, 2), grids.kmeans(t, [4, 2])), 2))
    graded = grids.graded({"a": t._replace(shared={})}, ks)
    assert {r.detector for r in graded.collect()} == set(ks) and graded.count() == 8 and rows.count() == 48
    assert set(grids.ABLATION) == {f"{c}_{k}" for c in ("kmeans", "hac", "dbscan") for k in grids.KINDS} and len(grids.SEARCHERS) == 17


def test_linkage_by_phases(spark, monkeypatch):
    """The same heights as one merge after another, when clusters are never listed with all others before the end."""
    monkeypatch.setattr(linkage, "SMALL", 6)
    monkeypatch.setattr(linkage, "NEAR", 3)
    monkeypatch.setattr(blocks, "ROWS", 20)
    x = np.concatenate([_clustered(60, 2, 5), [[3.0, 3.0]] * 4])
    d = blocks.distances(x, x)
    np.fill_diagonal(d, np.inf)
    want = []
    for _ in range(len(x) - 1):
        i, j = sorted(divmod(int(d.argmin()), len(x)))
        want.append(d[i, j])
        d[i] = d[:, i] = np.maximum(d[i], d[j])
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
    got = linkage.merges(_frame(spark, x)).orderBy("step").collect()
    assert [r.step for r in got] == list(range(1, len(x))) and [r.d for r in got] == want
    assert linkage.merges(_frame(spark, x).where("false")).count() == 0
