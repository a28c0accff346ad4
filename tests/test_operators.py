"""Golden values of a ten-point example and invariants of the operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from outrate.operators import detectors, metrics, neighbors
from outrate.operators import ratedistortion as rd
from outrate.sources.points import arff

POINTS = [(0, 0), (1, 0), (0, 1), (1, 1), (0.5, 0.5), (4, 4), (10, 10), (11, 10), (10, 11), (20, 0)]
LABELS = [1] * 6 + [2] * 3 + [3]


@pytest.fixture(scope="module")
def toy(spark):
    return spark.createDataFrame([(i, c, [float(v) for v in p]) for i, (p, c) in enumerate(zip(POINTS, LABELS, strict=True), 1)], "row_id long, cluster long, x array<double>")


def ids(df):
    return sorted(r.row_id for r in df.collect())


def test_rate_and_distortion(toy):
    (r,) = rd.rd_points(rd.cluster_stats(rd.distances(rd.represent(rd.single(toy), 2), 2))).collect()
    assert r.entropy == pytest.approx(1.295461844238322) and r.distortion == pytest.approx(10.734847265266216)


@pytest.mark.parametrize(("kind", "moved", "out"), [("minmin", 7, [1, 2, 3, 5, 6, 8, 9, 10]), ("minmax", 8, [1, 6, 10]), ("maxmin", 4, list(range(1, 11))), ("maxmax", 6, [10])])
def test_perturbed_purge(toy, kind, moved, out):
    measured = rd.distances(rd.represent(rd.single(toy), 2), 2)
    assert ids(rd.perturb(measured.select("row_id", "cluster", "d"), kind).where("cluster = 4")) == [moved]
    assert ids(rd.purge(rd.with_perturbed(toy, kind, 2), 2)) == out


def test_parametric_purge(toy):
    found = rd.purge_parametric(rd.single(toy), 2, [1.0, 2.0, 3.0])
    assert [ids(found.where(F.col("k") == k)) for k in (1, 2, 3)] == [[10], [6, 10], [1, 6, 10]]


def test_metrics(spark):
    rows = [(i in (1, 6, 10), i in (6, 7, 10)) for i in range(1, 11)]
    (m,) = metrics.metrics(spark.createDataFrame(rows, "predicted boolean, actual boolean")).collect()
    assert m.precision == m.recall == pytest.approx(2 / 3) and m.mcc == pytest.approx(0.5238095238) and m.fpr == pytest.approx(1 / 7)


def test_neighbours_agree(toy):
    near = {(r.a, r.b) for r in neighbors.within(toy, 1.5, 2).collect()}
    every = {(r.a, r.b) for r in neighbors.pairs(toy, 2).where("d <= 1.5").collect()}
    assert near == every | {(b, a) for a, b in every}
    assert all(r.d <= 1.5 for r in neighbors.knn(toy.where("row_id <= 5"), 1, 2).collect())


def test_density(toy):
    assert ids(detectors.dbscan_noise(toy, 1.5, 3, 2)) == [6, 10]
    labels = {r.row_id: r.cluster for r in detectors.dbscan(toy, 1.5, 3, 2).collect()}
    assert labels == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: None, 7: 7, 8: 7, 9: 7, 10: None}
    assert {r.row_id: r.cluster for r in detectors.hac(toy.select("row_id", "x"), 3).collect()}[10] == 3


def test_hac_has_no_limit_of_rows(spark):
    rng = random.Random(3)
    x = [(rng.random(), rng.random()) for _ in range(30)]
    x += x[:3]
    groups = [[i] for i in range(len(x))]
    far = lambda p, q: max(math.dist(x[i], x[j]) for i in p for j in q)
    while len(groups) > 6:
        _, i, j = min((far(p, q), i, j) for j, q in enumerate(groups) for i, p in enumerate(groups[:j]))
        groups[i] += groups.pop(j)
    want = {i: n for n, g in enumerate(sorted(groups, key=min), 1) for i in g}
    points = spark.createDataFrame([(i, list(p)) for i, p in enumerate(x)], "row_id long, x array<double>")
    assert {r.row_id: r.cluster for r in detectors.hac(points, 6).collect()} == want
    assert detectors.hac(points.where("false"), 6).count() == 0


def test_arff(spark, tmp_path):
    path = tmp_path / "a.arff"
    path.write_text("@RELATION a\n\n@ATTRIBUTE id real\n@ATTRIBUTE v real\n@ATTRIBUTE w real\n@ATTRIBUTE outlier {'no','yes'}\n\n@DATA\n1,2.5,3,'no'\n2,4,5,'yes'\n")
    assert [(r.row_id, r.x, r.src_id, r.is_outlier) for r in arff(spark, str(path)).collect()] == [(1, [2.5, 3.0], 1.0, False), (2, [4.0, 5.0], 2.0, True)]
    assert arff(spark, str(path), "positional").first().x == [1.0, 2.5]


def test_empty(spark, toy):
    none = toy.where("false")
    assert not ids(rd.purge(rd.single(none), 2)) and not ids(detectors.dbscan_noise(none, 1.0, 2, 2))
