"""Distortions and perturbations that are given as functions, and the detector that judges rows one after another."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from outrate.functions.vectors import chebyshev, dist, manhattan, squared
from outrate.operators import detectors, grids, ordered
from outrate.operators import ratedistortion as rd
from outrate.operators.state import kept

COST = {dist: lambda a, b: math.dist(a, b), manhattan: lambda a, b: sum(abs(x - y) for x, y in zip(a, b)), chebyshev: lambda a, b: max(abs(x - y) for x, y in zip(a, b)), squared: lambda a, b: math.dist(a, b) ** 2}


def _rows(seed, n=60):
    rng = random.Random(seed)
    return [(i, i % 4, [rng.gauss(8 * (i % 4), 1 + i % 3), rng.gauss(0, 2)]) for i in range(n)]


def _measured(rows, labels, cost):
    """(total, entropy, distance of each row, radius for a slope) of one clustering."""
    x = np.array([r[2] for r in rows])
    reps = {c: x[[i for i, y in enumerate(labels) if y == c]].mean(axis=0) for c in set(labels)}
    d = [cost(x[i], reps[c]) for i, c in enumerate(labels)]
    sizes = {c: labels.count(c) for c in reps}
    n = len(rows)
    change = {c: (f * math.log2(f) - (f - 1) * (math.log2(f - 1) if f > 1 else 0)) / n if f > 1 else 0.0 for c, f in sizes.items()}
    return sum(d), math.log2(n) - sum(f * math.log2(f) for f in sizes.values()) / n, d, change


def _purged(rows, first, second, cost):
    a, b = _measured(rows, first, cost), _measured(rows, second, cost)
    low, high, labels = (a, b, second) if a[0] < b[0] else (b, a, first)
    if low[0] == high[0] or low[1] <= high[1]:
        return []
    k = (high[1] - low[1]) / (high[0] - low[0])
    return [rows[i][0] for i, c in enumerate(labels) if round(high[2][i] - high[3][c] / -k, 9) >= 0]


@pytest.mark.parametrize("distortion", [manhattan, chebyshev, squared, dist])
def test_distortions(spark, distortion):
    rows = _rows(1)
    clusters = spark.createDataFrame(rows, "row_id long, cluster long, x array<double>")
    cost, labels = COST[distortion], [r[1] for r in rows]
    total, _, d, change = _measured(rows, labels, cost)
    got = {(r.row_id, r.k) for r in rd.purge_parametric(rd.single(clusters), 2, [2.0, 5.0], distortion).collect()}
    assert got == {(i, k) for i, c in enumerate(labels) for k in (2.0, 5.0) if d[i] >= change[c] / k * total}
    measured = kept(rd.measure(clusters.withColumn("grid", F.lit(3)), 2, distortion))
    for kind in grids.KINDS:
        want = {r.row_id for r in rd.purge(rd.with_perturbed(clusters, kind, 2, distortion), 2, distortion).collect()}
        assert {r.row_id for r in rd.purge_perturbed(measured, kind, 2, distortion).collect()} == want


def test_perturbations_as_functions(spark):
    rows = _rows(2)
    rows[5] = (5, 1, [8.0, 90.0])
    clusters = spark.createDataFrame(rows, "row_id long, cluster long, x array<double>")
    measured = kept(rd.measure(clusters.withColumn("grid", F.lit(7)), 2))
    labels = [r[1] for r in rows]
    d = _measured(rows, labels, COST[dist])[2]
    far = {max((i for i in range(60) if labels[i] == c), key=lambda i: (round(d[i], 9), -i)) for c in range(4)}
    functions = {
        rd.each_farthest: [-1 - i if i in far else c for i, c in enumerate(labels)],
        # one cluster of two: the perturbation has the lower entropy, and is itself what is tested
        lambda m: m.select("grid", "row_id", F.floor(F.col("cluster") / 2).alias("cluster")): [c // 2 for c in labels],
        # the same clustering: a curve of one vertex
        lambda m: m.select("grid", "row_id", F.col("cluster")): labels,
    }
    sizes = []
    for f, second in functions.items():
        want = _purged(rows, labels, second, COST[dist])
        assert sorted(r.row_id for r in rd.purge_perturbed(measured, f, 2).collect()) == want
        sizes.append(len(want))
    assert sizes[0] and sizes[1] and not sizes[2]
    assert rd.purge_perturbed(kept(measured.where("false")), rd.each_farthest, 2).count() == 0
    points = clusters.select("row_id", "x")
    t = grids.task(points, points.where("row_id % 9 = 0"), 2)
    assert grids.cp_kmeans(t, [4, 2], rd.each_farthest, distortion=manhattan).count() == 2


def _scan(x, centers, gamma, delta, rounds):
    """The same row by row."""
    n, z, before = len(x), [list(c) for c in centers], 0.0
    d, out = [math.inf] * n, [False] * n
    for _ in range(rounds):
        for i in range(n):
            inside = [d[j] for j in range(n) if not out[j]]
            limit = gamma * (sum(inside) / len(inside)) if inside else math.inf
            for c in z:
                if (a := math.dist(x[i], c)) < d[i]:
                    d[i], out[i] = a, False
                if d[i] > limit:
                    d[i], out[i] = limit, True
        inside = [x[i] for i in range(n) if not out[i]]
        z = [np.mean(inside, axis=0).tolist() if inside else c for c in z]
        if abs(before - sum(d)) < delta:
            break
        before = sum(d)
    return {i: d[i] for i in range(n) if out[i]}


@pytest.mark.parametrize(("gamma", "rounds"), [(0.9, 1), (0.9, 2), (1.5, 8), (1.05, 4), (0.3, 3)])
def test_rows_judged_in_order(spark, gamma, rounds):
    rng = random.Random(9)
    x = [[rng.gauss(6 * (i % 3), 1), rng.gauss(0, 1)] for i in range(70)] + [[40.0, 40.0]] * 3
    rng.shuffle(x)
    points = spark.createDataFrame([(i, v, "y") for i, v in enumerate(x)], "row_id long, x array<double>, d string").repartition(5)
    got = {r.row_id: r.d for r in ordered.kmor_in_order(points, detectors.first_rows(points, 3), 2, gamma, 1e-6, rounds).collect()}
    want = _scan(x, x[:3], gamma, 1e-6, rounds)
    assert got == pytest.approx(want, abs=1e-9) and (rounds == 1 or got)
    if rounds == 1:
        assert ordered.kmor_in_order(points.where("false"), detectors.first_rows(points, 3), 2, gamma).count() == 0
