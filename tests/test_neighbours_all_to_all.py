"""Where all rows meet all: the same neighbours as brute force, and few rows from a task."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from outrate.functions.decimals import short
from outrate.operators import blocks, neighbors


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in {"ROWS": 16, "COARSE": 32, "LARGE": 64, "FEW": 4, "TASKS": 8, "AT_ONCE": 256, "WHOLE": 10**9}.items():
        monkeypatch.setattr(blocks, name, value)


def brute(x, k=None, eps=math.inf, ties=False):
    d = blocks.distances(x, x)
    np.fill_diagonal(d, np.inf)
    out = {}
    for i, row in enumerate(d):
        order = sorted((v, j) for j, v in enumerate(row.tolist()) if v <= eps and v < math.inf)
        last = order[min(k, len(order)) - 1][0] if k and order else eps
        out[i] = [(j, v) for v, j in order if v <= last] if ties or not k else [(j, v) for v, j in order[:k]]
    return out


@pytest.mark.parametrize("shift", [0.0, 1e7])
def test_all_to_all_is_brute_force(spark, small_blocks, shift):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(150, 5)), np.repeat(rng.normal(size=(2, 5)), 20, axis=0), rng.integers(0, 2, (60, 5))]) + shift
    x = np.concatenate([x, [[1e150, 0, 0, 0, 0], [np.inf, 0, 0, 0, 0]]])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, x array<double>")
    with np.errstate(all="ignore"):
        want = {"least": brute(x, 4), "ties": brute(x, 4, ties=True), "within": brute(x, eps=1.5)}
    found = {"least": neighbors.knn(points, 4, 5), "ties": neighbors.knn_with_ties(points, 4, 5), "within": neighbors.within(points, 1.5, 5)}
    for name, rows in found.items():
        got = {i: [] for i in range(len(x))}
        for r in rows.collect():
            got[r.a].append((r.b, r.d))
        assert {i: sorted(v, key=lambda p: (p[1], p[0])) for i, v in got.items()} == want[name], name


def test_a_task_hands_on_k_rows_for_each_of_its_own(spark, small_blocks):
    n, k = 640, 3
    x = np.random.default_rng(6).normal(size=(n, 5))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, x array<double>")
    shares = math.ceil(8 / math.ceil(n / 64))  # TASKS by blocks of LARGE; blocks of COARSE are 20
    assert blocks.search(points, None, 5, k, neighbors._least(k)).count() <= n * k * shares


def test_small_ks_need_no_table_of_all_distances(spark, monkeypatch):
    from outrate.operators import factors

    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(60, 2)), np.repeat(rng.normal(size=(2, 2)), 9, axis=0), rng.integers(0, 4, (30, 2))])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, x array<double>")
    monkeypatch.setattr(factors, "LISTED", 0)
    want = {(r.k, r.row_id): r.score for r in factors.lof_every(points, [20, 10, 5, 1], 2).collect()}
    monkeypatch.setattr(factors, "LISTED", 64)
    monkeypatch.delattr(factors, "sorted_distances")
    got = {(r.k, r.row_id): r.score for r in factors.lof_every(points, [20, 10, 5, 1], 2).collect()}
    assert got.keys() == want.keys() and len(got) == 4 * len(x)
    np.testing.assert_allclose([got[k] for k in want], list(want.values()), rtol=1e-9)


def test_pairs_of_one_small_file_are_many_tasks(spark, tmp_path):
    spark.range(5000).selectExpr("id * 3 % 5000 AS row_id", "array(CAST(id * id % 997 AS double)) AS x").coalesce(1).write.parquet(f"{tmp_path}/points")
    points = spark.read.parquet(f"{tmp_path}/points")
    found = neighbors.pairs(points, 1)
    x = np.empty(5000)
    for r in points.collect():
        x[r.row_id] = r.x[0]
    sums = found.selectExpr("count(*)", "count(DISTINCT a * 5000L + b)", "count_if(a >= b)", "sum(CAST(d AS long) * (a + 2 * b))").first()
    i, j = np.triu_indices(5000, 1)
    assert tuple(sums) == (len(i), len(i), 0, int((np.abs(x[i] - x[j]) * (i + 2 * j)).sum()))
    assert found.rdd.getNumPartitions() > 1


@pytest.mark.parametrize("ties", [False, True])
def test_single_precision_loses_no_pair(ties):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[50:60] = x[50]  # equal rows: a limit of nothing
    x[300] = x[301] + 1e-9
    d = blocks.distances(x, x)
    np.fill_diagonal(d, np.inf)
    for k, bound in ((3, np.inf), (None, 0.7)):
        found = blocks.Found(np.arange(600), x, k, ties, bound)
        for at in range(0, 600, 150):
            found.meet(np.arange(at, at + 150), x[at : at + 150])
        got = set(zip(found.rows.tolist(), found.others.tolist()))
        kth = np.sort(d, axis=1)[:, 2:3]
        if k is None:
            want = set(zip(*(v.tolist() for v in np.nonzero(d <= bound))))
        elif ties:
            want = set(zip(*(v.tolist() for v in np.nonzero(d <= kth))))
        else:
            want = {(i, int(j)) for i, r in enumerate(np.argsort(d, axis=1, kind="stable")[:, :3]) for j in r}
        assert got == want
        assert found.kind(2.0, found.limit**2) is np.float32 and found.kind(1e9, found.limit**2) is np.float64


def test_blocks_of_pairs_move_packed(spark):
    """A row of a shuffle for each pair of blocks, not one for each row and block; and nulls stay."""
    points = spark.createDataFrame([(i, [float(i) if i else None]) for i in range(300)], "row_id long, x array<double>")
    found = neighbors.pairs(points, 1)
    assert found.count() == 300 * 299 // 2 and found.where("d IS NULL").count() == 299
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(rows") == 2


def test_short_is_round(spark):
    v = [0.1234565, 2.5e-7, 5e-7, 4.9999999e-7, 1.0000005, 1e12 + 0.25, 8388608.123456789, 0.0, -3.25, float("inf"), float("nan"), None, *(np.random.default_rng(1).integers(0, 10**8, 500) / 2e6).tolist()]
    both = spark.createDataFrame([(x,) for x in v], "v double").select(short(F.col("v"), 6).alias("a"), F.round("v", 6).alias("b"))
    assert both.where("NOT a <=> b").count() == 0 and both.count() == len(v)
