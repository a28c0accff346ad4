"""The registered queries of the operators, and the same in SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outrate.functions.decimals import short
from outrate.functions.vectors import change_of_entropy, chebyshev, manhattan
from outrate.operators import detectors, grids, metrics, neighbors, ordered
from outrate.operators import ratedistortion as rd
from outrate.operators.state import kept, scratch
from outrate.sources.points import datasets, disc_noise, separated, sparse_noise, table_points, write_arff, write_separated

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DIMS = 64


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), (F.col("label") + 1).alias("cluster"), F.col("embedding").cast("array<double>").alias("x"))


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return table_points(_read(spark, sf, "part"), "p_partkey", ["p_size", "p_retailprice"], "p_brand")


def _suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return table_points(_read(spark, sf, "supplier"), "s_suppkey", ["s_acctbal"], "s_nationkey")


def _measured(clusters: DataFrame, dims: int) -> DataFrame:
    return rd.distances(rd.represent(rd.single(clusters), dims), dims)


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem's four numbers under four clusterings: by flag, by status, by both, and as one cluster."""
    x = F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    labels = F.array(*[F.struct(F.lit(i).alias("clustering_id"), c.alias("cluster")) for i, c in enumerate((F.col("l_returnflag"), F.col("l_linestatus"), F.concat("l_returnflag", "l_linestatus"), F.lit("all")), 1)])
    return _read(spark, sf, "lineitem").select(key.alias("row_id"), x.alias("x"), F.explode(labels).alias("s")).select("s.clustering_id", "row_id", "s.cluster", "x")


VECTORS = """
 p AS (SELECT vec_id AS row_id, label + 1 AS cluster, embedding FROM embeddings),
 e AS (SELECT row_id, cluster, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM p)"""
PARTS = """
 p AS (SELECT p_partkey AS row_id, dense_rank() OVER (ORDER BY p_brand) AS cluster, p_size::DOUBLE AS s, p_retailprice::DOUBLE AS r FROM part),
 e AS (SELECT row_id, cluster, 1 AS i, s AS v FROM p UNION ALL SELECT row_id, cluster, 2, r FROM p)"""
SUPPLIERS = """
 p AS (SELECT s_suppkey AS row_id, dense_rank() OVER (ORDER BY s_nationkey) AS cluster, s_acctbal::DOUBLE AS r FROM supplier),
 e AS (SELECT row_id, cluster, 1 AS i, r AS v FROM p)"""
CENTERS = """
 c AS (SELECT cluster, i, avg(v) AS m FROM e GROUP BY ALL),
 d AS (SELECT row_id, e.cluster, sqrt(sum((v - m) * (v - m))) AS d FROM e JOIN c USING (cluster, i) GROUP BY ALL),
 f AS (SELECT cluster, count(*) AS f, sum(d) AS ds FROM d GROUP BY ALL),
 t AS (SELECT sum(f) AS n, sum(ds) AS dt, log2(sum(f)) - sum(f * log2(f)) / sum(f) AS h FROM f)"""
CE = "CASE WHEN f > 1 THEN (f * log2(f) - (f - 1) * log2(f - 1)) / n ELSE 0 END"
PAIRS = """
 pr AS (SELECT a.row_id AS a, b.row_id AS b, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS d FROM e a JOIN e b ON a.i = b.i AND a.row_id <> b.row_id GROUP BY ALL)"""
LINES = """
 l AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, l_quantity::DOUBLE AS a, l_extendedprice::DOUBLE AS b, l_discount::DOUBLE AS c, l_tax::DOUBLE AS t, l_returnflag AS rf, l_linestatus AS ls FROM lineitem),
 lc AS (SELECT 1 AS clustering_id, rf AS cluster, * FROM l UNION ALL SELECT 2, ls, * FROM l UNION ALL SELECT 3, rf || ls, * FROM l UNION ALL SELECT 4, 'all', * FROM l),
 m AS (SELECT clustering_id, cluster, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(t) AS mt, count(*) AS f FROM lc GROUP BY ALL),
 d AS (SELECT clustering_id, cluster, row_id, f, sqrt((a - ma) * (a - ma) + (b - mb) * (b - mb) + (c - mc) * (c - mc) + (t - mt) * (t - mt)) AS d FROM lc JOIN m USING (clustering_id, cluster)),
 s AS (SELECT clustering_id, cluster, any_value(f) AS f, sum(d) AS ds FROM d GROUP BY ALL),
 rd AS (SELECT clustering_id, sum(ds) AS dist, greatest(log2(sum(f)) - sum(f * log2(f)) / sum(f), 0) AS h, sum(f) AS n FROM s GROUP BY ALL)"""
HULL = """
 p1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dist ORDER BY h, clustering_id) AS r FROM rd) WHERE r = 1),
 hu AS (SELECT * FROM p1 x WHERE NOT EXISTS (SELECT 1 FROM p1 a, p1 b WHERE a.dist < x.dist AND b.dist > x.dist AND (x.h - a.h) * (b.dist - a.dist) >= (b.h - a.h) * (x.dist - a.dist))),
 dn AS (SELECT * FROM (SELECT *, lag(h) OVER (ORDER BY dist) AS bf FROM hu) WHERE bf IS NULL OR h < bf),
 cu AS (SELECT clustering_id, dist, h, row_number() OVER (ORDER BY dist) AS curve_pos, (h - lag(h) OVER (ORDER BY dist)) / (dist - lag(dist) OVER (ORDER BY dist)) AS k FROM dn),
 bo AS (SELECT curve_pos, s.clustering_id, cluster, CASE WHEN f > 1 THEN (f * log2(f) - (f - 1) * log2(f - 1)) / n ELSE 0 END / -k AS radius
        FROM s JOIN cu USING (clustering_id) CROSS JOIN (SELECT max(n) AS n FROM rd) WHERE curve_pos >= 2)"""


@query(f"WITH {VECTORS} SELECT cluster, count(*) AS n FROM p GROUP BY ALL")
def cluster_sizes(spark, sf):
    return _vectors(spark, sf).groupBy("cluster").agg(F.count("*").alias("n"))


@query(f"WITH {SUPPLIERS} SELECT row_id FROM p WHERE cluster IN (SELECT cluster FROM p GROUP BY cluster HAVING count(*) = 1)")
def singleton_rows(spark, sf):
    return detectors.singletons(_suppliers(spark, sf))


@query(f"WITH {PARTS}, {CENTERS} SELECT cluster, round(max(CASE WHEN i = 1 THEN m END) + 1e-8, 6) AS m1, round(max(CASE WHEN i = 2 THEN m END) + 1e-8, 6) AS m2 FROM c GROUP BY cluster")
def mean_centers(spark, sf):
    reps = rd.represent(rd.single(_parts(spark, sf)), 2).select("cluster", "rep").dropDuplicates(["cluster"])
    return reps.select("cluster", F.round(F.col("rep")[0] + 1e-8, 6).alias("m1"), F.round(F.col("rep")[1] + 1e-8, 6).alias("m2"))


@query(f"WITH {VECTORS}, {CENTERS} SELECT row_id, cluster, round(d, 6) AS d FROM d")
def row_distance(spark, sf):
    return _measured(_vectors(spark, sf), DIMS).select("row_id", "cluster", F.round("d", 6).alias("d"))


@query(f"WITH {VECTORS}, {CENTERS} SELECT cluster, f, round(ds, 6) AS distortion, row_number() OVER (ORDER BY fr) AS place FROM f JOIN (SELECT cluster, min(row_id) AS fr FROM d GROUP BY ALL) USING (cluster)")
def cluster_distortion(spark, sf):
    return rd.cluster_stats(_measured(_vectors(spark, sf), DIMS)).select("cluster", "f", F.round("distortion", 6).alias("distortion"), F.col("place").cast("long").alias("place"))


@query(f"WITH {LINES} SELECT clustering_id, round(dist, 3) AS distortion, round(h, 8) AS entropy FROM rd")
def rd_points(spark, sf):
    return rd.rd_points(rd.cluster_stats(_measured_lines(spark, sf))).select("clustering_id", F.round("distortion", 3).alias("distortion"), F.round("entropy", 8).alias("entropy"))


def _measured_lines(spark, sf):
    return rd.distances(rd.represent(_lines(spark, sf), 4), 4)


@query(f"WITH {VECTORS}, {CENTERS} SELECT cluster, round({CE}, 9) AS change FROM f, t")
def entropy_change(spark, sf):
    stats = rd.cluster_stats(_measured(_vectors(spark, sf), DIMS))
    return stats.select("cluster", F.round(change_of_entropy(F.col("f"), F.col("n")), 9).alias("change"))


@query(f"WITH {LINES}, {HULL} SELECT curve_pos, clustering_id, round(h, 8) AS entropy, round(coalesce(k, lead(k) OVER (ORDER BY dist)), 12) AS slope FROM cu")
def rd_curve(spark, sf):
    curve = rd.slopes(rd.lower_hull(rd.rd_points(rd.cluster_stats(_measured_lines(spark, sf)))))
    return curve.select(F.col("curve_pos").cast("long").alias("curve_pos"), "clustering_id", F.round("entropy", 8).alias("entropy"), F.round("slope", 12).alias("slope"))


#: Twenty clusterings of the parts by bands of their size.
BANDS = f"""
 l AS (SELECT p_partkey AS row_id, p_size::DOUBLE AS a, p_retailprice::DOUBLE AS b, clustering_id, floor((p_size - 1) * clustering_id / 50.0) AS cluster FROM part, (SELECT unnest(range(1, 21)) AS clustering_id)),
 m AS (SELECT clustering_id, cluster, avg(a) AS ma, avg(b) AS mb, count(*) AS f FROM l GROUP BY ALL),
 d AS (SELECT clustering_id, cluster, row_id, f, sqrt((a - ma) * (a - ma) + (b - mb) * (b - mb)) AS d FROM l JOIN m USING (clustering_id, cluster)),
 s AS (SELECT clustering_id, cluster, any_value(f) AS f, sum(d) AS ds FROM d GROUP BY ALL),
 rd AS MATERIALIZED (SELECT clustering_id, sum(ds) AS dist, greatest(log2(sum(f)) - sum(f * log2(f)) / sum(f), 0) AS h, sum(f) AS n FROM s GROUP BY ALL)"""


def _bands(spark, sf):
    p = _read(spark, sf, "part").withColumn("clustering_id", F.explode(F.sequence(F.lit(1), F.lit(20))))
    band = F.floor((F.col("p_size") - 1) * F.col("clustering_id") / 50.0)
    clusters = p.select("clustering_id", F.col("p_partkey").alias("row_id"), band.alias("cluster"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice").cast("double")).alias("x"))
    return kept(rd.rd_points(rd.cluster_stats(rd.distances(rd.represent(clusters, 2), 2))))


def _rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


@query(f"WITH {BANDS}, {HULL} SELECT clustering_id, round(dist, 3) AS distortion, round(h, 8) AS entropy, curve_pos FROM cu")
def lower_hull(spark, sf):
    return _rounded(rd.lower_hull(_bands(spark, sf)), distortion=3, entropy=8).withColumn("curve_pos", F.col("curve_pos").cast("long"))


@query(f"WITH {BANDS} SELECT i, round(min(h), 8) AS h FROM rd, (SELECT unnest(range(ceil(min(dist))::BIGINT, ceil(max(dist))::BIGINT)) AS i FROM rd) WHERE dist <= i GROUP BY i")
def rd_envelope(spark, sf):
    found = _bands(spark, sf)
    at = found.agg(F.explode(F.sequence(F.ceil(F.min("distortion")), F.ceil(F.max("distortion")) - 1)).alias("i"))
    return _rounded(rd.envelope(found.select(F.col("distortion").alias("d"), F.col("entropy").alias("h")), at), h=8)


@query(f"""WITH {BANDS}, {HULL},
 c AS (SELECT dist AS d, h, lead(dist) OVER (ORDER BY dist) AS d2, lead(h) OVER (ORDER BY dist) AS h2, max(dist) OVER () AS hi, min(dist) OVER () AS lo FROM cu),
 x AS (SELECT r AS id, lo + (hi - lo) * r / 60 AS x FROM range(61) AS t(r), (SELECT any_value(lo) AS lo, any_value(hi) AS hi FROM c))
SELECT id, round(x, 3) AS x, round(h + (h2 - h) * (x - d) / (d2 - d), 6) AS h FROM x JOIN c ON x >= d AND (x < d2 OR (d2 = hi AND x >= hi))""")
def rd_interpolate(spark, sf):
    curve = kept(rd.lower_hull(_bands(spark, sf)).select(F.col("distortion").alias("d"), F.col("entropy").alias("h")))
    return _rounded(rd.interpolate(curve, 61).select("id", "x", "h"), x=3, h=6)


@query(f"WITH {BANDS} SELECT clustering_id, round(log2(1000.0 / dist), 9) AS h FROM rd")
def rd_theory(spark, sf):
    return _bands(spark, sf).select("clustering_id", F.round(rd.rate(F.col("distortion")), 9).alias("h"))


def _perturbed_sql(kind: str) -> str:
    size, row = ("DESC" if kind[:3] == "max" else "ASC"), ("DESC" if kind[3:] == "max" else "ASC")
    some = "" if kind[:3] == "max" else "WHERE f > 1"
    return f"""
 tg AS (SELECT cluster FROM f {some} ORDER BY f {size}, cluster LIMIT 1),
 mv AS (SELECT row_id FROM d WHERE cluster = (SELECT cluster FROM tg) ORDER BY round(d, 9) {row}, row_id LIMIT 1),
 nl AS (SELECT row_id, CASE WHEN row_id = (SELECT row_id FROM mv) THEN (SELECT max(cluster) + 1 FROM d) ELSE cluster END AS cluster FROM d)"""


def _purge_sql(kind: str) -> str:
    return f"""WITH {VECTORS}, {CENTERS}, {_perturbed_sql(kind)},
 e2 AS (SELECT e.row_id, nl.cluster, i, v FROM e JOIN nl USING (row_id)),
 c2 AS (SELECT cluster, i, avg(v) AS m FROM e2 GROUP BY ALL),
 d2 AS (SELECT row_id, e2.cluster, sqrt(sum((v - m) * (v - m))) AS d FROM e2 JOIN c2 USING (cluster, i) GROUP BY ALL),
 f2 AS (SELECT cluster, count(*) AS f, sum(d) AS ds FROM d2 GROUP BY ALL),
 t2 AS (SELECT sum(ds) AS dt, log2(sum(f)) - sum(f * log2(f)) / sum(f) AS h FROM f2),
 k AS (SELECT (t.h - t2.h) / (t.dt - t2.dt) AS k FROM t, t2 WHERE t2.dt < t.dt AND t2.h > t.h)
SELECT row_id FROM d JOIN f USING (cluster), t, k WHERE d >= {CE} / -k"""


def _register(kind: str) -> None:
    def labels(spark, sf):
        found = rd.perturb(_measured(_vectors(spark, sf), DIMS).select("row_id", "cluster", "d"), kind)
        return found.select("row_id", F.col("cluster").cast("long").alias("cluster"))

    def purge(spark, sf):
        measured = kept(rd.measure(_vectors(spark, sf).withColumn("grid", F.lit(0)), DIMS))
        return rd.purge_perturbed(measured, kind, DIMS).select("row_id")

    QUERIES[f"perturb_{kind}"], SQL[f"perturb_{kind}"] = labels, f"WITH {VECTORS}, {CENTERS}, {_perturbed_sql(kind)} SELECT row_id, cluster::BIGINT AS cluster FROM nl"
    QUERIES[f"purge_{kind}"], SQL[f"purge_{kind}"] = purge, _purge_sql(kind)


for _kind in ("maxmax", "maxmin", "minmax", "minmin"):
    _register(_kind)


@query(f"WITH {LINES}, {HULL} SELECT row_id FROM d JOIN bo USING (clustering_id, cluster) GROUP BY row_id HAVING bool_and(d >= radius)")
def purge_multi(spark, sf):
    return rd.purge(_lines(spark, sf), 4)


@query(f"WITH {LINES}, {HULL} SELECT curve_pos, clustering_id, cluster, round(radius, 4) AS radius FROM bo")
def purge_boundaries(spark, sf):
    stats = rd.cluster_stats(_measured_lines(spark, sf))
    edges = rd.boundaries(stats, rd.lower_hull(rd.rd_points(stats)))
    return edges.select(F.col("curve_pos").cast("long").alias("curve_pos"), "clustering_id", "cluster", F.round("radius", 4).alias("radius"))


@query(f"WITH {LINES}, {HULL} SELECT curve_pos, clustering_id, cluster, round(ma, 6) AS c1, round(mb, 4) AS c2, round(radius, 4) AS radius FROM bo JOIN m USING (clustering_id, cluster) WHERE radius > 0")
def purge_zones(spark, sf):
    z = rd.zones(_lines(spark, sf), 4)
    return z.select(F.col("curve_pos").cast("long").alias("curve_pos"), "clustering_id", "cluster", F.round(F.col("rep")[0], 6).alias("c1"), F.round(F.col("rep")[1], 4).alias("c2"), F.round("radius", 4).alias("radius"))


_KS = [3.0, 5.0, 7.0, 9.0, 12.0]


@query(f"WITH {VECTORS}, {CENTERS} SELECT row_id, k FROM d JOIN f USING (cluster), t, (SELECT unnest({_KS})::DOUBLE AS k) WHERE d >= {CE} / k * dt")
def purge_param(spark, sf):
    return rd.purge_parametric(rd.single(_vectors(spark, sf)), DIMS, _KS)


@query(f"WITH {PARTS}, {CENTERS} SELECT row_id, k FROM d JOIN f USING (cluster), t, (SELECT unnest({_KS})::DOUBLE AS k) WHERE d >= {CE} / k * dt")
def purge_param_parts(spark, sf):
    return rd.purge_parametric(rd.single(_parts(spark, sf)), 2, _KS)


#: Clusters and what they cost by the sum of absolute differences instead of Euclid's distance.
_ABSOLUTE = CENTERS.replace("sqrt(sum((v - m) * (v - m)))", "sum(abs(v - m))")


@query(f"WITH {PARTS}, {_ABSOLUTE} SELECT row_id, k FROM d JOIN f USING (cluster), t, (SELECT unnest({_KS})::DOUBLE AS k) WHERE d >= {CE} / k * dt")
def purge_param_manhattan(spark, sf):
    return rd.purge_parametric(rd.single(_parts(spark, sf)), 2, _KS, manhattan)


_LARGEST = LINES.replace("sqrt((a - ma) * (a - ma) + (b - mb) * (b - mb) + (c - mc) * (c - mc) + (t - mt) * (t - mt))", "greatest(abs(a - ma), abs(b - mb), abs(c - mc), abs(t - mt))")


@query(f"WITH {_LARGEST}, {HULL} SELECT row_id FROM d JOIN bo USING (clustering_id, cluster) GROUP BY row_id HAVING bool_and(d >= radius)")
def purge_multi_chebyshev(spark, sf):
    return rd.purge(_lines(spark, sf), 4, chebyshev)


_EACH = "nl AS (SELECT row_id, CASE WHEN f > 1 AND row_number() OVER (PARTITION BY cluster ORDER BY round(d, 9) DESC, row_id) = 1 THEN -1 - row_id ELSE cluster END AS cluster FROM d JOIN f USING (cluster))"


@query(_purge_sql("maxmax").replace(_perturbed_sql("maxmax"), _EACH))
def purge_each_farthest(spark, sf):
    measured = kept(rd.measure(_vectors(spark, sf).withColumn("grid", F.lit(0)), DIMS))
    return rd.purge_perturbed(measured, rd.each_farthest, DIMS).select("row_id")


def _absolute_perturbed(sql: str) -> str:
    return sql.replace("sqrt(sum((v - m) * (v - m)))", "sum(abs(v - m))")


@query(_absolute_perturbed(_purge_sql("maxmax")))
def purge_maxmax_manhattan(spark, sf):
    measured = kept(rd.measure(_vectors(spark, sf).withColumn("grid", F.lit(0)), DIMS, manhattan))
    return rd.purge_perturbed(measured, "maxmax", DIMS, manhattan).select("row_id")


@query(f"WITH {PARTS}, mx AS (SELECT max(abs(v)) AS m FROM e) SELECT row_id, round(s / m, 9) AS x1, round(r / m, 9) AS x2 FROM p, mx")
def maxabs_scale(spark, sf):
    p = _parts(spark, sf)
    m = p.agg(F.max(F.greatest(F.abs(F.col("x")[0]), F.abs(F.col("x")[1]))).alias("m"))
    return p.crossJoin(F.broadcast(m)).select("row_id", F.round(F.col("x")[0] / F.col("m"), 9).alias("x1"), F.round(F.col("x")[1] / F.col("m"), 9).alias("x2"))


@query(f"WITH {PARTS}, z AS (SELECT avg(s) AS ms, stddev_samp(s) AS ss, avg(r) AS mr, stddev_samp(r) AS sr FROM p) SELECT row_id, round((s - ms) / ss, 8) AS x1, round((r - mr) / sr, 8) AS x2 FROM p, z")
def zscore(spark, sf):
    p = _parts(spark, sf).select("row_id", F.col("x")[0].alias("s"), F.col("x")[1].alias("r"))
    z = p.agg(F.avg("s").alias("ms"), F.stddev_samp("s").alias("ss"), F.avg("r").alias("mr"), F.stddev_samp("r").alias("sr"))
    return p.crossJoin(F.broadcast(z)).select("row_id", F.round((F.col("s") - F.col("ms")) / F.col("ss"), 8).alias("x1"), F.round((F.col("r") - F.col("mr")) / F.col("sr"), 8).alias("x2"))


@query(f"WITH {SUPPLIERS}, {PAIRS} SELECT a, b, round(d, 6) AS d FROM pr WHERE a < b")
def all_pairs(spark, sf):
    return neighbors.pairs(_suppliers(spark, sf), 1).select("a", "b", short(F.col("d"), 6).alias("d"))


@query(f"WITH {VECTORS}, {PAIRS} SELECT a, b, round(d, 6) AS d, rk FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rk FROM pr) WHERE rk <= 5")
def knn(spark, sf):
    return neighbors.knn(_vectors(spark, sf), 5, DIMS).select("a", "b", F.round("d", 6).alias("d"), F.col("rk").cast("long").alias("rk"))


@query(f"WITH {VECTORS}, {PAIRS} SELECT a AS row_id, round(max(d), 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rk FROM pr) WHERE rk <= 5 GROUP BY a")
def knn_dist(spark, sf):
    return neighbors.knn(_vectors(spark, sf), 5, DIMS).groupBy(F.col("a").alias("row_id")).agg(F.round(F.max("d"), 6).alias("d"))


@query(f"WITH {PARTS} SELECT a.row_id AS a, b.row_id AS b, round(sqrt((a.s - b.s) * (a.s - b.s) + (a.r - b.r) * (a.r - b.r)), 6) AS d FROM p a JOIN p b ON a.row_id <> b.row_id AND sqrt((a.s - b.s) * (a.s - b.s) + (a.r - b.r) * (a.r - b.r)) <= 1.25")
def eps_join(spark, sf):
    return detectors.within_equal(_parts(spark, sf), 1.25, 2, 6).select("a", "b", "d")


@query(f"WITH {PARTS}, {CENTERS}, q AS (SELECT p.row_id, a.cluster AS center, sqrt((s - a.m) * (s - a.m) + (r - b.m) * (r - b.m)) AS d FROM p, c a JOIN c b ON a.cluster = b.cluster AND a.i = 1 AND b.i = 2) SELECT row_id, center, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY round(d, 9), center) AS k FROM q) WHERE k = 1")
def nearest_center(spark, sf):
    p = _parts(spark, sf)
    centers = rd.represent(rd.single(p), 2).select(F.col("cluster").alias("center"), F.col("rep").alias("c")).dropDuplicates(["center"])
    return neighbors.nearest(p.select("row_id", "x"), centers, 2).select("row_id", F.col("center").cast("long").alias("center"), F.round("d", 6).alias("d"))


@query(f"WITH {VECTORS}, {PAIRS} SELECT a AS row_id, arg_min(b, d) AS b, round(min(d), 6) AS d FROM pr JOIN p pa ON pa.row_id = a JOIN p pb ON pb.row_id = b WHERE pb.cluster <= 3 GROUP BY a")
def nearest_large(spark, sf):
    v = _vectors(spark, sf)
    return neighbors.nearest_in(v, v.where("cluster <= 3"), DIMS).select("row_id", "b", F.round("d", 6).alias("d"))


@query("SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def semi_outliers(spark, sf):
    labels = _read(spark, sf, "labels")
    return labels.where("toxic = 1").join(labels.where("quality = 0").select("doc_id"), "doc_id", "left_semi").select("doc_id")


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def anti_inliers(spark, sf):
    labels = _read(spark, sf, "labels")
    return labels.join(labels.where("toxic = 1").select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query(f"WITH {VECTORS}, {CENTERS} SELECT row_id, round(d, 6) AS score FROM d ORDER BY round(d, 9) DESC, row_id DESC LIMIT 25")
def topm_scores(spark, sf):
    return _measured(_vectors(spark, sf), DIMS).orderBy(F.round("d", 9).desc_nulls_first(), F.desc("row_id")).limit(25).select("row_id", F.round("d", 6).alias("score"))


_METRICS = """ m AS (SELECT count(*) FILTER (p AND a)::DOUBLE AS tp, count(*) FILTER (p AND NOT a)::DOUBLE AS fp, count(*) FILTER (NOT p AND a)::DOUBLE AS fn, count(*) FILTER (NOT p AND NOT a)::DOUBLE AS tn FROM (SELECT toxic = 1 AS p, quality = 0 AS a FROM labels))"""


@query(f"WITH {_METRICS} SELECT tp, fp, fn, tn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f_score, round((tp * tn - fp * fn) / (sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)), 9) AS mcc, round(fp / (fp + tn), 9) AS fpr, round(tp / (tp + fn), 9) AS tpr FROM m")
def eval_metrics(spark, sf):
    out = metrics.metrics(_read(spark, sf, "labels").select((F.col("toxic") == 1).alias("predicted"), (F.col("quality") == 0).alias("actual")))
    return out.select("tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f_score", "mcc", "fpr", "tpr")])


def _graded(spark, sf):
    """Flags of the parametric purge for each k, held against an arbitrary truth: every seventh row."""
    v = _vectors(spark, sf)
    found = rd.purge_parametric(rd.single(v), DIMS, _KS).withColumn("hit", F.lit(True))
    grid = v.select("row_id").withColumn("k", F.explode(F.array(*map(F.lit, _KS))))
    return grid.join(found, ["row_id", "k"], "left").select("k", F.coalesce("hit", F.lit(False)).alias("predicted"), (F.col("row_id") % 7 == 0).alias("actual"))


_GRID = f"""WITH {VECTORS}, {CENTERS}, ks AS (SELECT unnest({_KS})::DOUBLE AS k),
 g AS (SELECT k, d >= {CE} / k * dt AS p, row_id % 7 = 0 AS a FROM d JOIN f USING (cluster), t, ks),
 m AS (SELECT k, count(*) FILTER (p AND a)::DOUBLE AS tp, count(*) FILTER (p AND NOT a)::DOUBLE AS fp, count(*) FILTER (NOT p AND a)::DOUBLE AS fn, count(*) FILTER (NOT p AND NOT a)::DOUBLE AS tn FROM g GROUP BY k)"""


@query(_GRID + " SELECT k, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, 9) AS fpr, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS tpr FROM m")
def roc_points(spark, sf):
    return metrics.metrics(_graded(spark, sf), ["k"]).select("k", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query(_GRID + """, s AS (SELECT k, CASE WHEN tp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f_score,
 CASE WHEN tp > 0 AND tn > 0 THEN (tp * tn - fp * fn) / (sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)) ELSE 0 END AS mcc FROM m),
 u AS (SELECT 'precision' AS metric, k, precision AS v FROM s UNION ALL SELECT 'recall', k, recall FROM s UNION ALL SELECT 'f_score', k, f_score FROM s UNION ALL SELECT 'mcc', k, mcc FROM s)
SELECT metric, k, round(v, 9) AS value FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY round(v, 9) DESC, k) AS r FROM u) WHERE r = 1""")
def grid_best(spark, sf):
    scored = metrics.metrics(_graded(spark, sf), ["k"]).withColumn("grid_order", F.col("k"))
    return metrics.best(scored, "k").withColumn("value", F.round("value", 9))


_LOF = f"""WITH {VECTORS}, {PAIRS},
 nb AS (SELECT a, b, d FROM (SELECT *, rank() OVER (PARTITION BY a ORDER BY d) AS rk FROM pr) WHERE rk <= 10),
 kd AS (SELECT a, max(d) AS kd FROM nb GROUP BY a),
 lr AS (SELECT nb.a, count(*) / sum(greatest(d, kd)) AS lrd FROM nb JOIN kd ON kd.a = nb.b GROUP BY nb.a)
SELECT nb.a AS row_id, round(avg(o.lrd) / any_value(s.lrd), 6) AS score FROM nb JOIN lr o ON o.a = nb.b JOIN lr s ON s.a = nb.a GROUP BY nb.a"""


@query(_LOF)
def lof(spark, sf):
    return detectors.lof(_vectors(spark, sf), 10, DIMS).select("row_id", F.round("score", 6).alias("score"))


_NEAR = f"""{PARTS}, nb AS (SELECT a.row_id AS a, b.row_id AS b FROM p a JOIN p b ON a.row_id <> b.row_id AND abs(a.r - b.r) <= 1.25 AND abs(a.s - b.s) <= 1.25 AND sqrt((a.s - b.s) * (a.s - b.s) + (a.r - b.r) * (a.r - b.r)) <= 1.25),
 co AS (SELECT a FROM nb GROUP BY a HAVING count(*) >= 3)"""


@query(f"WITH {_NEAR} SELECT row_id FROM p WHERE row_id NOT IN (SELECT a FROM co) AND row_id NOT IN (SELECT a FROM nb WHERE b IN (SELECT a FROM co))")
def dbscan_noise(spark, sf):
    return detectors.dbscan_noise(_parts(spark, sf), 1.25, 4, 2)


@query(f"""WITH RECURSIVE {_NEAR}, ce AS (SELECT a, b FROM nb WHERE a IN (FROM co) AND b IN (FROM co)),
 re AS (SELECT a AS root, a AS node FROM co UNION SELECT root, b FROM re JOIN ce ON ce.a = node),
 lb AS (SELECT node, min(root) AS l FROM re GROUP BY node),
 bd AS (SELECT a AS node, min(l) AS l FROM nb JOIN lb ON lb.node = b WHERE a NOT IN (SELECT node FROM lb) GROUP BY a)
SELECT row_id, coalesce(l, -1) AS cluster FROM p LEFT JOIN (FROM lb UNION ALL FROM bd) x ON x.node = row_id""")
def dbscan(spark, sf):
    return detectors.dbscan(_parts(spark, sf), 1.25, 4, 2).select("row_id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


_LARGE = 4
_CBLOF = f"""WITH {PARTS}, {CENTERS}, rk AS (SELECT cluster, f, row_number() OVER (ORDER BY f DESC, cluster) <= {_LARGE} AS big FROM f)"""


@query(_CBLOF + """, q AS (SELECT p.row_id, min(sqrt((s - a.m) * (s - a.m) + (r - b.m) * (r - b.m))) AS far FROM p, c a JOIN c b ON a.cluster = b.cluster AND a.i = 1 AND b.i = 2 JOIN rk ON rk.cluster = a.cluster AND big GROUP BY ALL)
SELECT row_id, round(f * CASE WHEN big THEN d ELSE far END, 4) AS score FROM d JOIN rk USING (cluster) JOIN q USING (row_id)""")
def cblof(spark, sf):
    return detectors.cblof(_parts(spark, sf), 2, _LARGE).select("row_id", F.round("score", 4).alias("score"))


@query(f"""WITH {VECTORS}, {PAIRS}, n1 AS (SELECT a AS row_id, min(d) AS d1 FROM pr GROUP BY a),
 st AS (SELECT cluster, count(*) AS f, avg(d1) AS m, row_number() OVER (ORDER BY count(*) DESC, cluster) <= {_LARGE} AS big FROM p JOIN n1 USING (row_id) GROUP BY cluster),
 sm AS (SELECT a AS row_id, arg_min(sb.m, d) AS mb, min(d) AS d FROM pr JOIN p pa ON pa.row_id = a JOIN st sa ON sa.cluster = pa.cluster AND NOT sa.big JOIN p pb ON pb.row_id = b JOIN st sb ON sb.cluster = pb.cluster AND sb.big GROUP BY a)
SELECT row_id, round(f * CASE WHEN big THEN d1 - m ELSE sm.d - mb END, 5) AS score FROM p JOIN n1 USING (row_id) JOIN st USING (cluster) LEFT JOIN sm USING (row_id)""")
def cblof_knn(spark, sf):
    return detectors.cblof_knn(_vectors(spark, sf), DIMS, _LARGE).select("row_id", F.round("score", 5).alias("score"))


@query(f"""WITH {PARTS}, {CENTERS}, rk AS (SELECT cluster, f, row_number() OVER (ORDER BY f DESC, cluster) AS k FROM f),
 pl AS (SELECT cluster, row_number() OVER (ORDER BY row_id) AS place FROM p),
 u AS (SELECT DISTINCT pl.cluster FROM pl JOIN rk ON rk.cluster = place AND k <= {_LARGE}),
 q AS (SELECT p.row_id, min(sqrt((s - a.m) * (s - a.m) + (r - b.m) * (r - b.m))) AS far FROM p, c a JOIN c b ON a.cluster = b.cluster AND a.i = 1 AND b.i = 2 JOIN u ON u.cluster = a.cluster GROUP BY ALL)
SELECT row_id, round(sz.f * CASE WHEN rk.k <= {_LARGE} THEN x.d ELSE far END, 4) AS score FROM d x JOIN rk ON rk.cluster = x.cluster JOIN rk sz ON sz.k = x.cluster JOIN q USING (row_id)""")
def cblof_reference(spark, sf):
    return detectors.cblof(_parts(spark, sf), 2, _LARGE, "reference").select("row_id", F.round("score", 4).alias("score"))


@query(f"""WITH {VECTORS}, {PAIRS}, n1 AS (SELECT a AS row_id, min(d) AS d1 FROM pr GROUP BY a),
 st AS (SELECT cluster, count(*) AS f, avg(d1) AS m, row_number() OVER (ORDER BY count(*) DESC, cluster) AS k, row_number() OVER (ORDER BY min(row_id)) AS seen FROM p JOIN n1 USING (row_id) GROUP BY cluster),
 pl AS (SELECT row_id, row_number() OVER (ORDER BY row_id) AS place FROM p),
 sm AS (SELECT a AS row_id, arg_min(b, (d, b)) AS b, arg_min(sb.f, (d, b)) AS fb, min(d) AS d FROM pr JOIN p pa ON pa.row_id = a JOIN st sa ON sa.cluster = pa.cluster AND sa.k > {_LARGE} JOIN p pb ON pb.row_id = b JOIN st sb ON sb.cluster = pb.cluster AND sb.k <= {_LARGE} GROUP BY a)
SELECT p.row_id, round(sz.f * CASE WHEN st.k <= {_LARGE} THEN d1 - own.m / st.f ELSE sm.d - other.m / fb END, 5) AS score FROM p JOIN n1 USING (row_id) JOIN st USING (cluster) LEFT JOIN st sz ON sz.k = p.cluster LEFT JOIN st own ON own.seen = p.cluster
 LEFT JOIN sm USING (row_id) LEFT JOIN pl ON pl.row_id = sm.b LEFT JOIN st other ON other.seen = pl.place""")
def cblof_knn_reference(spark, sf):
    return detectors.cblof_knn(_vectors(spark, sf), DIMS, _LARGE, "reference").select("row_id", F.round("score", 5).alias("score"))


def _assign(centers: str, name: str) -> str:
    return f""" {name} AS MATERIALIZED (SELECT row_id, s, r, arg_min(c, (round(d, 9), c)) AS c, min(d) AS d FROM (SELECT p.row_id, p.s, p.r, c, sqrt((p.s - x) * (p.s - x) + (p.r - y) * (p.r - y)) AS d FROM p, {centers}) GROUP BY ALL)"""


_START = f"WITH {PARTS}, c0 AS (SELECT row_number() OVER (ORDER BY row_id) AS c, s AS x, r AS y FROM p QUALIFY c <= 5), "
#: Rounds in SQL, as many as the query's at most: larger tables take more than a few dozen to stand still.
_ROUNDS = detectors.ROUNDS


def _lloyd_sql() -> str:
    parts = []
    for k in range(_ROUNDS):
        parts += [_assign(f"c{k}", f"a{k}"), f" c{k + 1} AS MATERIALIZED (SELECT c, avg(s) AS x, avg(r) AS y FROM a{k} GROUP BY c)"]
    return _START + ",".join([*parts, _assign(f"c{_ROUNDS}", "z")])


@query(_lloyd_sql() + " SELECT row_id, c AS cluster FROM z")
def lloyd(spark, sf):
    p = _parts(spark, sf)
    return detectors.lloyd(p.select("row_id", "x"), detectors.first_rows(p, 5), 2).select("row_id", F.col("cluster").cast("long").alias("cluster"))


@query(_lloyd_sql() + " SELECT row_id FROM z WHERE c IN (SELECT c FROM z GROUP BY c HAVING count(*) = 1)")
def kmeans_singletons(spark, sf):
    p = _parts(spark, sf)
    return detectors.singletons(detectors.lloyd(p.select("row_id", "x"), detectors.first_rows(p, 5), 2))


def _without(k: int, rest: str) -> str:
    return f" c{k + 1} AS MATERIALIZED (SELECT c, avg(s) AS x, avg(r) AS y FROM a{k} WHERE {rest} GROUP BY c)"


def _mm_sql(out: int) -> str:
    parts = []
    for k in range(_ROUNDS):
        parts += [_assign(f"c{k}", f"a{k}"), f" o{k} AS MATERIALIZED (SELECT row_id, d FROM a{k} ORDER BY round(d, 9) DESC, row_id LIMIT {out})", _without(k, f"row_id NOT IN (SELECT row_id FROM o{k})")]
    return _START + ",".join(parts) + f" SELECT row_id, round(d, 6) AS d FROM o{_ROUNDS - 1}"


@query(_mm_sql(20))
def kmeans_mm(spark, sf):
    p = _parts(spark, sf)
    return detectors.kmeans_mm(p.select("row_id", "x"), detectors.first_rows(p, 5), 2, 20).select("row_id", F.round("d", 6).alias("d"))


def _mm_reference_sql(out: int) -> str:
    """The rows of the first round after which the moves, added up by coordinate, come to nothing, or of the last round."""
    parts, found, still = [], [], []
    for k in range(_ROUNDS):
        parts += [_assign(f"c{k}", f"a{k}"), f" o{k} AS MATERIALIZED (SELECT row_id, d FROM a{k} ORDER BY round(d, 9) DESC, row_id LIMIT {out})", _without(k, f"row_id NOT IN (SELECT row_id FROM o{k})")]
        found.append(f"SELECT {k} AS k, row_id, d FROM o{k}")
        still.append(f"SELECT {k} AS k, count(*) = (SELECT count(*) FROM c{k}) AND pow(sum(n.x - o.x), 2) + pow(sum(n.y - o.y), 2) < 1e-5 AS still FROM c{k + 1} n JOIN c{k} o USING (c)")
    return _START + ",".join(parts) + f" SELECT row_id, round(d, 6) AS d FROM ({' UNION ALL '.join(found)}) WHERE k = (SELECT coalesce(min(k), {_ROUNDS - 1}) FROM ({' UNION ALL '.join(still)}) WHERE still)"


@query(_mm_reference_sql(20))
def kmeans_mm_reference(spark, sf):
    p = _parts(spark, sf)
    return detectors.kmeans_mm(p.select("row_id", "x"), detectors.first_rows(p, 5), 2, 20, mode="reference").select("row_id", F.round("d", 6).alias("d"))


def _kmor_sql(gamma: float, rounds: int) -> str:
    parts = []
    for k in range(rounds):
        inside = f"WHERE d <= (SELECT l FROM l{k - 1})" if k else ""
        parts += [_assign(f"c{k}", f"a{k}"), f" l{k} AS MATERIALIZED (SELECT {gamma} * avg(d) AS l FROM a{k} {inside})", _without(k, f"d <= (SELECT l FROM l{k})")]
    return _START + ",".join(parts) + f" SELECT row_id, round(d, 6) AS d FROM a{rounds - 1} WHERE d > (SELECT l FROM l{rounds - 1})"


@query(_kmor_sql(1.5, 10))
def kmor(spark, sf):
    p = _parts(spark, sf)
    return detectors.kmor(p.select("row_id", "x"), detectors.first_rows(p, 5), 2, 1.5, 10).select("row_id", F.round("d", 6).alias("d"))


@query()
def kmor_reference(spark, sf):
    p = _parts(spark, sf)
    return ordered.kmor_in_order(p, detectors.first_rows(p, 5), 2, 1.5).select("row_id", F.round("d", 6).alias("d"))


def _ocrd_sql(betas: str, rounds: int = 10) -> str:
    """betas: (g, beta) as SQL; ends with ov (g, beta, row_id)."""
    parts = [f"WITH {SUPPLIERS}, z AS (SELECT row_id, (r - m) / s AS x FROM p, (SELECT avg(r) AS m, stddev_samp(r) AS s FROM p)), s0 AS MATERIALIZED (SELECT g, beta, n, w, 0.5::DOUBLE AS q FROM (SELECT count(*) AS n, avg(x) AS w FROM z), ({betas}))"]
    for k in range(rounds - 1):
        parts.append(f""" r{k} AS (SELECT g, beta, x, n, w, q, 2.0 ** (-beta * abs(x - w)) AS p FROM z, s{k}),
 n{k} AS MATERIALIZED (SELECT g, any_value(beta) AS beta, any_value(n) AS n, any_value(w) AS w0, any_value(q) AS q0, sum(least(1, n * q * p) * x) / any_value(n) AS w, count(*) FILTER (n * q * p >= 1) / any_value(n) + any_value(q) * coalesce(sum(p) FILTER (n * q * p < 1), 0) AS q FROM r{k} GROUP BY g),
 s{k + 1} AS MATERIALIZED (SELECT g, beta, n, CASE WHEN (w - w0) * (w - w0) <= 1e-10 THEN w0 ELSE w END AS w, CASE WHEN (w - w0) * (w - w0) <= 1e-10 THEN q0 ELSE q END AS q FROM n{k})""")
    return ",".join(parts) + f", ov AS (SELECT g, beta, row_id FROM z, s{rounds - 1} WHERE n * q * 2.0 ** (-beta * abs(x - w)) < 1)"


@query(_ocrd_sql("SELECT 0 AS g, 6.0::DOUBLE AS beta") + " SELECT row_id FROM ov")
def ocrd(spark, sf):
    return detectors.ocrd(kept(detectors.scaled(_suppliers(spark, sf), 1)), 1, 6.0)


#: Complete linkage of points on a line, where only neighbours can be next: one merge a round, all cuts as cu (theta, row_id, cluster).
_TREE = f"""WITH RECURSIVE {SUPPLIERS}, so AS (SELECT row_id, r, row_number() OVER (ORDER BY r, row_id) AS o FROM p), ve AS MATERIALIZED (SELECT list(r ORDER BY o) AS v FROM so),
 st AS (SELECT 0 AS step, list(struct_pack(a := row_id, i := o, j := o) ORDER BY o) AS cl FROM so UNION ALL
  SELECT step + 1, list_concat(list_concat(cl[:x.i - 1], [struct_pack(a := x.a, i := cl[x.i].i, j := cl[x.i + 1].j)]), cl[x.i + 2:])
  FROM (SELECT step, cl, list_sort(list_transform(range(1, len(cl)), lambda k: struct_pack(d := sqrt((v[cl[k + 1].j] - v[cl[k].i]) * (v[cl[k + 1].j] - v[cl[k].i])), a := least(cl[k].a, cl[k + 1].a), b := greatest(cl[k].a, cl[k + 1].a), i := k)))[1] AS x FROM st, ve WHERE len(cl) > 1)),
 cu AS MATERIALIZED (SELECT theta, row_id, r, c.a AS cluster FROM (SELECT len(cl) AS theta, unnest(cl) AS c FROM st) JOIN so ON o BETWEEN c.i AND c.j),
 z AS (SELECT row_id, r, dense_rank() OVER (ORDER BY cluster) AS c FROM cu WHERE theta = 6)"""


@query(f"{_TREE} SELECT row_id, c AS cluster FROM z")
def hac(spark, sf):
    return detectors.hac(_suppliers(spark, sf).select("row_id", "x"), 6)


@query(f"{_TREE} SELECT row_id FROM z WHERE c IN (SELECT c FROM z GROUP BY c HAVING count(*) = 1)")
def hac_singletons(spark, sf):
    return detectors.singletons(detectors.hac(_suppliers(spark, sf).select("row_id", "x"), 6))


@query()
def lps(spark, sf):
    return detectors.lps(_vectors(spark, sf), 8, 2, DIMS).select("row_id", F.round("score", 6).alias("score"))


@query()
def lps_reference(spark, sf):
    return detectors.lps(_vectors(spark, sf), 8, 2, DIMS, "reference").select("row_id", F.round("score", 6).alias("score"))


@query()
def kmeans_mllib(spark, sf):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = _vectors(spark, sf).select("row_id", array_to_vector("x").alias("features"))
    return KMeans(k=10, seed=815, predictionCol="cluster").fit(v).transform(v).select("row_id", "cluster")


_UNIFORM = "(('0x' || substr(md5(row_id || ':{}'), 1, 12))::BIGINT::DOUBLE + 1) / 281474976710656"


@query(f"""WITH {SUPPLIERS}, t AS (SELECT row_id, 2 * pi() * sqrt(-2 * ln({_UNIFORM.format(1)})) * cos(2 * pi() * {_UNIFORM.format(2)}) AS t, {_UNIFORM.format(3)} AS y FROM p)
SELECT row_id, round(y * cos(t), 6) AS x, round(y * sin(t), 6) AS y FROM t""")
def noise_disc(spark, sf):
    return disc_noise(_suppliers(spark, sf)).select("row_id", F.round(F.col("x")[0], 6).alias("x"), F.round(F.col("x")[1], 6).alias("y"))


@query(f"""WITH {VECTORS}, {PAIRS} SELECT a, b, round(d, 6) AS d FROM pr WHERE d <= 1.1""")
def eps_join_vectors(spark, sf):
    return neighbors.within(_vectors(spark, sf), 1.1, DIMS).select("a", "b", F.round("d", 6).alias("d"))


_LLOYD_ROWS = "SELECT row_id, c AS cluster, 1 AS i, s AS v FROM z UNION ALL SELECT row_id, c, 2, r FROM z"
_TREE_ROWS = "SELECT row_id, c AS cluster, 1 AS i, r AS v FROM z"


def _represented_sql(base: str, rows: str) -> str:
    centers = CENTERS.replace("FROM e ", "FROM el ").replace("e.cluster", "el.cluster").replace("c AS (SELECT", "cc AS (SELECT").replace("JOIN c ", "JOIN cc ")
    return f"{base}, el AS ({rows}),{centers}"


def _cpp_sql(base: str, rows: str) -> str:
    return f"{_represented_sql(base, rows)} SELECT row_id, k FROM d JOIN f USING (cluster), t, (SELECT unnest({_KS})::DOUBLE AS k) WHERE d >= {CE} / k * dt"


def _cp_sql(base: str, rows: str) -> str:
    return f"""{_represented_sql(base, rows)}, {_perturbed_sql('maxmax')},
 e2 AS (SELECT el.row_id, nl.cluster, i, v FROM el JOIN nl USING (row_id)),
 d2 AS (SELECT row_id, e2.cluster, sqrt(sum((v - m) * (v - m))) AS d FROM e2 JOIN (SELECT cluster, i, avg(v) AS m FROM e2 GROUP BY ALL) USING (cluster, i) GROUP BY ALL),
 f2 AS (SELECT cluster, count(*) AS f, sum(d) AS ds FROM d2 GROUP BY ALL),
 t2 AS (SELECT sum(ds) AS dt, log2(sum(f)) - sum(f * log2(f)) / sum(f) AS h FROM f2),
 k AS (SELECT (t.h - t2.h) / (t.dt - t2.dt) AS k FROM t, t2 WHERE t2.dt < t.dt AND t2.h > t.h)
SELECT row_id FROM d JOIN f USING (cluster), t, k WHERE d >= {CE} / -k"""


@query(_cpp_sql(_lloyd_sql(), _LLOYD_ROWS))
def cpp_lloyd(spark, sf):
    p = _parts(spark, sf)
    labels = detectors.lloyd(p.select("row_id", "x"), detectors.first_rows(p, 5), 2)
    return rd.purge_parametric(rd.single(labels.join(p.select("row_id", "x"), "row_id")), 2, _KS)


@query(_cp_sql(_lloyd_sql(), _LLOYD_ROWS))
def cp_lloyd(spark, sf):
    p = _parts(spark, sf).select("row_id", "x")
    labels = detectors.lloyd_all(p, detectors.started(detectors.first_rows(p, 5)), 2).select("grid", "row_id", "cluster")
    return rd.purge_perturbed(kept(rd.measure(labels.join(p, "row_id"), 2)), "maxmax", 2).select("row_id")


@query(_cp_sql(_TREE, _TREE_ROWS))
def cp_hac(spark, sf):
    s = _suppliers(spark, sf).select("row_id", "x")
    labels = detectors.hac(s, 6).withColumn("grid", F.lit(0))
    return rd.purge_perturbed(kept(rd.measure(labels.join(s, "row_id"), 1)), "maxmax", 1).select("row_id")


@query(_cpp_sql(_TREE, _TREE_ROWS))
def cpp_hac(spark, sf):
    s = _suppliers(spark, sf).select("row_id", "x")
    return rd.purge_parametric(rd.single(detectors.hac(s, 6).join(s, "row_id")), 1, _KS)


_DENSE = f"""WITH RECURSIVE {_NEAR}, ce AS (SELECT a, b FROM nb WHERE a IN (FROM co) AND b IN (FROM co)),
 re AS (SELECT a AS root, a AS node FROM co UNION SELECT root, b FROM re JOIN ce ON ce.a = node),
 lb AS (SELECT node, min(root) AS l FROM re GROUP BY node),
 bd AS (SELECT a AS node, min(l) AS l FROM nb JOIN lb ON lb.node = b WHERE a NOT IN (SELECT node FROM lb) GROUP BY a),
 la AS MATERIALIZED (SELECT row_id, coalesce(l, (SELECT max(l) FROM lb) + 1 - (SELECT min(row_id) FROM p) + row_id) AS cluster FROM p LEFT JOIN (FROM lb UNION ALL FROM bd) x ON x.node = row_id),
 nd AS (SELECT a, b, sqrt((x.s - y.s) * (x.s - y.s) + (x.r - y.r) * (x.r - y.r)) AS d FROM nb JOIN p x ON x.row_id = a JOIN p y ON y.row_id = b),
 rp AS (SELECT a AS row_id, b, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM nd JOIN la x ON x.row_id = a JOIN la y ON y.row_id = b WHERE x.cluster = y.cluster),
 d AS MATERIALIZED (SELECT row_id, cluster, coalesce(b1, row_id) AS rep, coalesce(d1, 0) AS d, coalesce(d2, 0) AS sec FROM la LEFT JOIN (SELECT row_id, max(b) FILTER (k = 1) AS b1, max(d) FILTER (k = 1) AS d1, max(d) FILTER (k = 2) AS d2 FROM rp GROUP BY row_id) USING (row_id)),
 f AS (SELECT cluster, count(*) AS f, sum(d) AS ds FROM d GROUP BY ALL),
 t AS (SELECT sum(f) AS n, sum(ds) AS dt, log2(sum(f)) - sum(f * log2(f)) / sum(f) AS h FROM f)"""


def _density(spark, sf):
    """The parts' density clusters, represented by neighbours, as grid 0."""
    return kept(detectors.dbscan_represented(_parts(spark, sf).select("row_id", "x"), 1.25, 4, 2))


@query(f"{_DENSE} SELECT row_id, rep, round(d, 6) AS d FROM d")
def dbscan_reps(spark, sf):
    return _density(spark, sf).select("row_id", "rep", F.round("d", 6).alias("d"))


@query(f"""{_DENSE}, {_perturbed_sql('maxmax')}, f2 AS (SELECT cluster, count(*) AS f FROM nl GROUP BY ALL),
 t2 AS (SELECT (SELECT sum(CASE WHEN row_id = (SELECT row_id FROM mv) THEN 0 WHEN rep = (SELECT row_id FROM mv) THEN sec ELSE d END) FROM d) AS dt, log2(sum(f)) - sum(f * log2(f)) / sum(f) AS h FROM f2),
 k AS (SELECT (t.h - t2.h) / (t.dt - t2.dt) AS k FROM t, t2 WHERE t2.dt < t.dt AND t2.h > t.h)
SELECT row_id FROM d JOIN f USING (cluster), t, k WHERE round(d - {CE} / -k, 9) >= 0""")
def cp_dbscan(spark, sf):
    return detectors.purge_density(_density(spark, sf), "maxmax").select("row_id")


@query(f"{_DENSE} SELECT row_id, k FROM d JOIN f USING (cluster), t, (SELECT unnest({_KS})::DOUBLE AS k) WHERE d >= {CE} / k * dt")
def cpp_dbscan(spark, sf):
    flags = rd.flagged_by(_density(spark, sf), _KS).where("flags > 0")
    return flags.select("row_id", F.explode(F.slice(F.array(*map(F.lit, _KS)), F.lit(len(_KS) + 1) - F.col("flags"), F.col("flags"))).alias("k"))


# -- grid searches: the winner of each metric, held against an arbitrary truth, every seventh row


def _searched(points: Query, dims: int, name: str, **config) -> Query:
    def run(spark, sf):
        p = points(spark, sf).select("row_id", "x")
        found = grids.winners(grids.SEARCHERS[name](grids.task(p, p.where("row_id % 7 = 0"), dims), **config))
        return found.select("metric", F.round("p1", 6).alias("p1"), F.round("p2", 6).alias("p2"), F.round("value", 9).alias("value"))

    return run


_GRADED = """ m AS (SELECT g, p1, p2, tp::DOUBLE AS tp, (p - tp)::DOUBLE AS fp, (mm - tp)::DOUBLE AS fn, (nn - mm - (p - tp))::DOUBLE AS tn FROM fl, (SELECT count(*) AS nn, count(*) FILTER (row_id % 7 = 0) AS mm FROM p)),
 s AS (SELECT g, p1, p2, CASE WHEN tp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f_score,
 CASE WHEN tp > 0 AND tn > 0 THEN (tp * tn - fp * fn) / (sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)) ELSE 0 END AS mcc FROM m),
 u AS (SELECT 'precision' AS metric, g, p1, p2, precision AS v FROM s UNION ALL SELECT 'recall', g, p1, p2, recall FROM s UNION ALL SELECT 'f_score', g, p1, p2, f_score FROM s UNION ALL SELECT 'mcc', g, p1, p2, mcc FROM s)
SELECT metric, round(p1, 6) AS p1, round(p2, 6) AS p2, round(v, 9) AS value FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY round(v, 9) DESC, g) AS r FROM u) WHERE r = 1"""
_LOF_KS = [20, 10, 5]
_DBSCAN_GRID = f"""WITH {SUPPLIERS}, {PAIRS.replace('pr AS (', 'pr AS MATERIALIZED (')}, kn AS MATERIALIZED (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rk FROM pr),
 ep AS (SELECT row_number() OVER (ORDER BY rk, d) AS g, rk AS least, d AS eps FROM (SELECT DISTINCT rk, d FROM kn WHERE rk BETWEEN 2 AND 11)),
 co AS MATERIALIZED (SELECT g, a FROM ep JOIN kn ON kn.rk = least - 1 AND kn.d <= eps),
 re AS (SELECT g, a FROM co UNION SELECT g, pr.a FROM co JOIN pr ON pr.b = co.a JOIN ep USING (g) WHERE d <= eps),
 fl AS (SELECT g, least::DOUBLE AS p1, eps AS p2, (SELECT count(*) FROM p) - coalesce(c, 0) AS p, (SELECT count(*) FROM p WHERE row_id % 7 = 0) - coalesce(h, 0) AS tp
        FROM ep LEFT JOIN (SELECT g, count(*) AS c, count(*) FILTER (a % 7 = 0) AS h FROM re GROUP BY g) USING (g)),"""
_LOF_GRID = f"""WITH {{points}}, {PAIRS}, ks AS MATERIALIZED ({{ks}}),
 ra AS MATERIALIZED (SELECT a, b, d, rank() OVER (PARTITION BY a ORDER BY d) AS rk FROM pr), nb AS MATERIALIZED (SELECT g, a, b, d FROM ra JOIN ks ON rk <= kk),
 kd AS (SELECT g, a, max(d) AS kd FROM nb GROUP BY ALL), lr AS MATERIALIZED (SELECT nb.g, nb.a, count(*) / sum(greatest(d, kd)) AS lrd FROM nb JOIN kd ON kd.a = nb.b AND kd.g = nb.g GROUP BY ALL),
 sc AS (SELECT nb.g, nb.a, round(avg(o.lrd) / any_value(s.lrd), 9) AS score FROM nb JOIN lr o ON o.a = nb.b AND o.g = nb.g JOIN lr s ON s.a = nb.a AND s.g = nb.g GROUP BY ALL),
 tp AS (SELECT g, a FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, a DESC) AS r FROM sc) WHERE r <= (SELECT count(*) FROM p WHERE row_id % 7 = 0)),
 fl AS (SELECT g, kk::DOUBLE AS p1, NULL::DOUBLE AS p2, count(*) AS p, count(*) FILTER (a % 7 = 0) AS tp FROM tp JOIN ks USING (g) GROUP BY ALL),"""

for _name, _config in {
    "ocrd": {}, "kmeans_singletons": {"starts": 100}, "kmeans_mm": {}, "kmor": {}, "cblof_kmeans": {"starts": 100}, "cp_kmeans": {"starts": 100}, "cpp_kmeans": {"starts": 100},
    "hac_singletons": {}, "cblof_hac": {}, "cp_hac": {}, "cpp_hac": {}, "dbscan_noise": {}, "cblof_dbscan": {}, "cp_dbscan": {}, "cpp_dbscan": {}, "lof": {},
}.items():
    QUERIES[f"grid_{_name}"] = _searched(_suppliers, 1, _name, **_config)
QUERIES["grid_lps"] = _searched(_vectors, DIMS, "lps")
QUERIES["grid_lof_vectors"], SQL["grid_lof_vectors"] = _searched(_vectors, DIMS, "lof", ks=_LOF_KS), _LOF_GRID.format(points=VECTORS, ks=f"SELECT unnest({_LOF_KS}) AS kk, unnest([0, 1, 2]) AS g") + _GRADED
SQL["grid_lof"] = _LOF_GRID.format(points=SUPPLIERS, ks="SELECT n - 1 - i AS kk, i AS g FROM (SELECT count(*) AS n FROM p), unnest(range(n - 1)) AS r(i)") + _GRADED
SQL["grid_dbscan_noise"] = _DBSCAN_GRID + _GRADED
SQL["cpp_hac_roc"] = f"""{_TREE}, cs AS MATERIALIZED (SELECT cluster, count(*) AS f, avg(r) AS c FROM cu WHERE theta = 5 GROUP BY ALL), cd AS (SELECT row_id, f, abs(r - c) AS d FROM cu JOIN cs USING (cluster) WHERE theta = 5),
 tt AS (SELECT count(*) AS n, sum(d) AS dt, count(*) FILTER (row_id % 7 = 0) AS m FROM cd), kc AS MATERIALIZED (SELECT row_id, CASE WHEN f = 1 OR dt = 0 THEN 0 WHEN d > 0 THEN ({CE}) * dt / d END AS kc, m, n FROM cd, tt),
 mu AS (SELECT 0.1::DOUBLE + (100 - 0.1::DOUBLE) * i / 2999 AS k FROM unnest(range(3000)) AS r(i))
SELECT round(k, 6) AS k, round(count(*) FILTER (kc <= k AND row_id % 7 <> 0) / any_value(n - m), 9) AS fpr, round(count(*) FILTER (kc <= k AND row_id % 7 = 0) / any_value(m), 9) AS tpr FROM mu, kc GROUP BY k"""


def _roc(spark, sf):
    p = _suppliers(spark, sf).select("row_id", "x")
    return _rounded(grids.cpp_hac_roc(grids.task(p, p.where("row_id % 7 = 0"), 1)), k=6, fpr=9, tpr=9)


QUERIES["cpp_hac_roc"] = _roc
#: Density clusters of points on a line, where cores are one cluster as long as none of the gaps between them is wider than eps.
_DENSE_GRID = f"""WITH {SUPPLIERS}, {PAIRS.replace('pr AS (', 'pr AS MATERIALIZED (')}, kn AS MATERIALIZED (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rk FROM pr), nn AS (SELECT count(*) AS n FROM p),
 ep AS MATERIALIZED (SELECT row_number() OVER (ORDER BY rk, d) - 1 AS g, rk AS least, d AS eps FROM (SELECT DISTINCT rk, d FROM kn WHERE rk BETWEEN 2 AND 11)),
 co AS MATERIALIZED (SELECT g, a AS row_id, r, eps FROM ep JOIN kn ON kn.rk = least - 1 AND kn.d <= eps JOIN p ON row_id = a),
 gp AS (SELECT *, (r - lag(r) OVER (PARTITION BY g ORDER BY r, row_id) <= eps)::INT AS near FROM co),
 rn AS (SELECT *, sum(1 - coalesce(near, 0)) OVER (PARTITION BY g ORDER BY r, row_id) AS run FROM gp),
 lb AS MATERIALIZED (SELECT g, row_id, min(row_id) OVER (PARTITION BY g, run) AS l FROM rn),
 bd AS (SELECT lb.g, pr.a AS row_id, min(l) AS l FROM lb JOIN pr ON pr.b = lb.row_id JOIN ep ON ep.g = lb.g AND pr.d <= eps ANTI JOIN co ON co.g = lb.g AND co.row_id = pr.a GROUP BY ALL),
 ml AS (SELECT ep.g, coalesce(max(l), 0) + 1 - (SELECT min(row_id) FROM p) AS behind FROM ep LEFT JOIN lb USING (g) GROUP BY ep.g),
 la AS MATERIALIZED (SELECT ml.g, p.row_id, coalesce(x.l, behind + p.row_id) AS cluster FROM ml CROSS JOIN p LEFT JOIN (FROM lb UNION ALL FROM bd) x ON x.g = ml.g AND x.row_id = p.row_id),
 cz AS MATERIALIZED (SELECT g, cluster, count(*) AS f FROM la GROUP BY ALL),
 rp AS (SELECT x.g, a AS row_id, b, d, row_number() OVER (PARTITION BY x.g, a ORDER BY d, b) AS k FROM pr JOIN la x ON x.row_id = a JOIN cz ON cz.g = x.g AND cz.cluster = x.cluster AND f > 1 JOIN la y ON y.row_id = b AND y.g = x.g AND y.cluster = x.cluster JOIN ep ON ep.g = x.g AND d <= eps),
 dd AS MATERIALIZED (SELECT la.g, la.row_id, la.cluster, f, coalesce(b1, la.row_id) AS rep, coalesce(d1, 0) AS d, coalesce(d2, 0) AS sec FROM la JOIN cz USING (g, cluster)
  LEFT JOIN (SELECT g, row_id, max(b) FILTER (k = 1) AS b1, max(d) FILTER (k = 1) AS d1, max(d) FILTER (k = 2) AS d2 FROM rp GROUP BY ALL) USING (g, row_id)),
 dt AS MATERIALIZED (SELECT g, sum(d) AS dt, n FROM dd, nn GROUP BY g, n),"""
_FLAGGED = "count(row_id) AS p, count(row_id) FILTER (row_id % 7 = 0) AS tp"
SQL["grid_cblof_dbscan"] = f"""{_DENSE_GRID} lg AS (SELECT g, least(count(*) - 1, 5) AS large FROM cz GROUP BY g),
 cm AS (SELECT la.g, la.cluster, count(*) AS f, avg(d) AS m FROM la JOIN kn ON a = row_id AND rk = 1 GROUP BY la.g, la.cluster),
 st AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY f DESC, cluster) AS place FROM cm),
 rw AS MATERIALIZED (SELECT la.g, row_id, la.cluster, f, m, place <= large AS big, d AS d1 FROM la JOIN st USING (g, cluster) JOIN lg USING (g) JOIN kn ON a = row_id AND rk = 1),
 sc AS (SELECT g, row_id, f * (d1 - m) AS score FROM rw WHERE big UNION ALL
  SELECT x.g, x.row_id, any_value(x.f) * arg_min(pr.d - y.m, struct_pack(d := pr.d, b := pr.b)) FROM rw x JOIN pr ON pr.a = x.row_id JOIN rw y ON y.row_id = pr.b AND y.g = x.g AND y.big WHERE NOT x.big GROUP BY x.g, x.row_id),
 tp AS (SELECT g, row_id FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(score, 9) DESC, row_id DESC) AS k FROM sc) WHERE k <= (SELECT count(*) FROM p WHERE row_id % 7 = 0)),
 fl AS (SELECT ep.g, least::DOUBLE AS p1, eps AS p2, {_FLAGGED} FROM ep LEFT JOIN tp USING (g) GROUP BY ALL),""" + _GRADED
SQL["grid_cp_dbscan"] = f"""{_DENSE_GRID} mv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY f DESC, cluster, round(d, 9) DESC, row_id) AS k FROM dd) WHERE k = 1 AND f > 1),
 ch AS (SELECT mv.g, any_value(mv.d) - coalesce(sum(o.sec - o.d), 0) AS less, any_value(mv.f) AS f FROM mv LEFT JOIN dd o ON o.g = mv.g AND o.rep = mv.row_id AND o.row_id <> mv.row_id GROUP BY mv.g),
 sl AS (SELECT g, n, (f * log2(f) - (f - 1) * log2(f - 1)) / n / less AS k FROM ch JOIN dt USING (g) WHERE less > 0),
 hi AS (SELECT g, row_id FROM dd JOIN sl USING (g) WHERE round(d - {CE} / k, 9) >= 0),
 fl AS (SELECT ep.g, least::DOUBLE AS p1, eps AS p2, {_FLAGGED} FROM ep LEFT JOIN hi USING (g) GROUP BY ALL),""" + _GRADED
SQL["grid_cpp_dbscan"] = f"""{_DENSE_GRID} mu AS (SELECT i, 0.1::DOUBLE + (10 - 0.1::DOUBLE) * i / 29 AS k FROM unnest(range(30)) AS r(i)),
 fl AS (SELECT g * 30 + i AS g, eps AS p1, k AS p2, count(*) FILTER (d >= {CE} / k * dt) AS p, count(*) FILTER (row_id % 7 = 0 AND d >= {CE} / k * dt) AS tp FROM dd JOIN dt USING (g) JOIN ep USING (g), mu GROUP BY ALL),""" + _GRADED
_BETAS = "SELECT i AS g, 0.1::DOUBLE + (10 - 0.1::DOUBLE) * i / (n - 1) AS beta FROM (SELECT count(*) AS n FROM p), unnest(range(n)) AS r(i)"
SQL["grid_ocrd"] = f"""{_ocrd_sql(_BETAS)}, fl AS (SELECT s0.g, s0.beta AS p1, NULL::DOUBLE AS p2, count(row_id) AS p, count(*) FILTER (row_id % 7 = 0) AS tp FROM s0 LEFT JOIN ov USING (g) GROUP BY ALL),""" + _GRADED
_GRID_KS = "SELECT 10 - k AS i, k FROM unnest(range(2, 11)) AS r(k)"


def _grid_near(n: int) -> str:
    return f" a{n} AS MATERIALIZED (SELECT g, row_id, r, c, d FROM (SELECT *, row_number() OVER (PARTITION BY g, row_id ORDER BY round(d, 9), c) AS rk FROM (SELECT g, row_id, r, c, abs(r - x) AS d FROM p, c{n})) WHERE rk = 1)"


def _grid_start(grid: str) -> str:
    return f"WITH {SUPPLIERS}, gr AS ({grid}), c0 AS MATERIALIZED (SELECT g, c, r AS x FROM gr, (SELECT row_number() OVER (ORDER BY row_id) AS c, r FROM p) WHERE c <= k)"


def _grid_mm_sql() -> str:
    parts = [_grid_start(f"SELECT i AS g, k FROM ({_GRID_KS})")]
    for n in range(_ROUNDS):
        parts += [_grid_near(n), f" o{n} AS MATERIALIZED (SELECT g, row_id, r, c, d, row_number() OVER (PARTITION BY g ORDER BY round(d, 9) DESC, row_id) <= (SELECT count(*) FROM p WHERE row_id % 7 = 0) AS far FROM a{n})"]
        parts.append(f" c{n + 1} AS MATERIALIZED (SELECT g, c, avg(r) AS x FROM o{n} WHERE NOT far GROUP BY g, c)")
    return ",".join(parts) + f", fl AS (SELECT g, k::DOUBLE AS p1, NULL::DOUBLE AS p2, count(*) AS p, count(*) FILTER (row_id % 7 = 0) AS tp FROM o{_ROUNDS - 1} JOIN gr USING (g) WHERE far GROUP BY ALL)," + _GRADED


def _grid_kmor_sql(rounds: int = 10) -> str:
    parts = [_grid_start(f"SELECT 30 * x.i + y.i AS g, k, 0.1::DOUBLE + (10 - 0.1::DOUBLE) * y.i / 29 AS gamma FROM ({_GRID_KS}) AS x, unnest(range(30)) AS y(i)")]
    for n in range(rounds):
        inside = f"FILTER (d <= l{n - 1}.l)" if n else ""
        before = f"JOIN l{n - 1} USING (g)" if n else ""
        parts += [_grid_near(n), f" l{n} AS MATERIALIZED (SELECT g, any_value(gamma) * coalesce(avg(d) {inside}, 0) AS l FROM a{n} JOIN gr USING (g) {before} GROUP BY g)"]
        parts.append(f" w{n} AS MATERIALIZED (SELECT g, c, avg(r) AS x FROM a{n} JOIN l{n} USING (g) WHERE d <= l GROUP BY g, c)")
        parts.append(f" c{n + 1} AS MATERIALIZED (FROM w{n} UNION ALL SELECT g, c, x FROM c{n} WHERE g NOT IN (SELECT g FROM w{n}))")
    last = rounds - 1
    return ",".join(parts) + f", fl AS (SELECT g, k::DOUBLE AS p1, gamma AS p2, count(*) FILTER (d > l) AS p, count(*) FILTER (d > l AND row_id % 7 = 0) AS tp FROM a{last} JOIN l{last} USING (g) JOIN gr USING (g) GROUP BY ALL)," + _GRADED


SQL["grid_kmeans_mm"], SQL["grid_kmor"] = _grid_mm_sql(), _grid_kmor_sql()
_SIZES = "cs AS MATERIALIZED (SELECT theta, cluster, count(*) AS f, avg(r) AS c FROM cu GROUP BY ALL)"
_CUTS = f"{_SIZES}, cd AS MATERIALIZED (SELECT theta, cluster, row_id, r, f, c, abs(r - c) AS d FROM cu JOIN cs USING (theta, cluster)), ct AS (SELECT theta, count(*) AS n, sum(d) AS dt, log2(count(*)) - sum(log2(f)) / count(*) AS h FROM cd GROUP BY theta)"
SQL["grid_hac_singletons"] = f"""{_TREE}, {_SIZES}, fl AS (SELECT (SELECT count(*) FROM p) - theta AS g, theta::DOUBLE AS p1, NULL::DOUBLE AS p2, count(*) FILTER (f = 1) AS p, count(*) FILTER (f = 1 AND cluster % 7 = 0) AS tp FROM cs GROUP BY theta),""" + _GRADED
SQL["grid_cblof_hac"] = f"""{_TREE}, {_CUTS}, bg AS (SELECT theta, cluster, c FROM (SELECT *, row_number() OVER (PARTITION BY theta ORDER BY f DESC, cluster) AS k FROM cs) WHERE k <= least(theta - 1, 5)),
 sc AS (SELECT cd.theta, row_id, any_value(f) * coalesce(min(abs(r - bg.c)) FILTER (bg.cluster = cd.cluster), min(abs(r - bg.c))) AS score FROM cd JOIN bg ON bg.theta = cd.theta GROUP BY cd.theta, row_id),
 tp AS (SELECT theta, row_id FROM (SELECT *, row_number() OVER (PARTITION BY theta ORDER BY score DESC, row_id DESC) AS k FROM sc) WHERE k <= (SELECT count(*) FROM p WHERE row_id % 7 = 0)),
 fl AS (SELECT theta AS g, theta::DOUBLE AS p1, NULL::DOUBLE AS p2, count(*) AS p, count(*) FILTER (row_id % 7 = 0) AS tp FROM tp WHERE theta BETWEEN 3 AND (SELECT count(*) - 1 FROM p) GROUP BY theta),""" + _GRADED
SQL["grid_cpp_hac"] = f"""{_TREE}, {_CUTS}, mu AS (SELECT i, 0.1::DOUBLE + (10 - 0.1::DOUBLE) * i / 29 AS k FROM unnest(range(30)) AS r(i)),
 fl AS (SELECT ((SELECT count(*) FROM p) - 1 - theta) * 30 + i AS g, theta::DOUBLE AS p1, k AS p2, count(*) FILTER (d >= {CE} / k * dt) AS p, count(*) FILTER (row_id % 7 = 0 AND d >= {CE} / k * dt) AS tp FROM cd JOIN ct USING (theta), mu WHERE theta < n GROUP BY ALL),""" + _GRADED
SQL["grid_cp_hac"] = f"""{_TREE}, {_CUTS}, mv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY theta ORDER BY f DESC, cluster, round(d, 9) DESC, row_id) AS k FROM cd) WHERE k = 1 AND f > 1),
 c2 AS (SELECT mv.theta, mv.cluster, mv.row_id AS moved, avg(cd.r) AS c FROM mv JOIN cd ON cd.theta = mv.theta AND cd.cluster = mv.cluster AND cd.row_id <> mv.row_id GROUP BY ALL),
 nw AS (SELECT theta, sum(CASE WHEN row_id = moved THEN 0 WHEN cd.cluster = c2.cluster THEN abs(r - c2.c) ELSE d END) AS dt, log2(count(*)) - sum(CASE WHEN row_id = moved THEN 0 WHEN cd.cluster = c2.cluster THEN log2(f - 1) ELSE log2(f) END) / count(*) AS h FROM cd JOIN c2 USING (theta) GROUP BY theta),
 sl AS (SELECT theta, (ct.h - nw.h) / (ct.dt - nw.dt) AS k FROM ct JOIN nw USING (theta) WHERE nw.dt < ct.dt AND nw.h > ct.h),
 hi AS (SELECT cd.theta, row_id FROM cd JOIN ct USING (theta) JOIN sl USING (theta) WHERE round(d - {CE} / -k, 9) >= 0),
 fl AS (SELECT n - 1 - ct.theta AS g, ct.theta::DOUBLE AS p1, NULL::DOUBLE AS p2, count(row_id) AS p, count(*) FILTER (row_id % 7 = 0) AS tp FROM ct LEFT JOIN hi USING (theta) WHERE ct.theta < n GROUP BY ALL),""" + _GRADED


def _evaluated(searchers: dict) -> Query:
    def run(spark, sf):
        s = _suppliers(spark, sf).select("row_id", "x")
        found = grids.competition({"suppliers": grids.task(s, s.where("row_id % 7 = 0"), 1)}, searchers).drop("seconds")  # these differ from run to run
        return _rounded(found, **dict.fromkeys(grids.METRICS, 9))

    return run


QUERIES["competition"] = _evaluated(grids.SEARCHERS)
QUERIES["perturbation_ablation"] = _evaluated(grids.ABLATION)


# -- files


@query("SELECT p_partkey + 1 AS row_id, p_size::DOUBLE AS x1, p_retailprice::DOUBLE AS x2, p_partkey::DOUBLE AS src_id, p_partkey % 7 = 0 AS is_outlier, 'parts' AS dataset FROM part")
def arff_parts(spark, sf):
    """The parts as an ARFF file, read again through the registry of datasets; row numbers follow the file's order, which is that of keys."""
    p = _parts(spark, sf).withColumn("is_outlier", F.col("row_id") % 7 == 0)
    path = scratch(p)
    write_arff(p, path, ["size", "price"])
    return datasets(spark, {"parts": path}).select("row_id", F.col("x")[0].alias("x1"), F.col("x")[1].alias("x2"), "src_id", "is_outlier", "dataset")


def _separated(sep: str) -> Query:
    def run(spark, sf):
        p = _parts(spark, sf)
        path = scratch(p)
        write_separated(p, path, sep)
        return separated(spark, path, 2, sep).select("row_id", F.col("x")[0].alias("x1"), F.col("x")[1].alias("x2"))

    return run


for _name, _sep in (("text_parts", " "), ("csv_parts", ",")):
    QUERIES[_name], SQL[_name] = _separated(_sep), "SELECT p_partkey + 1 AS row_id, p_size::DOUBLE AS x1, p_retailprice::DOUBLE AS x2 FROM part"


@query("""SELECT row_number() OVER (ORDER BY s_suppkey, i) AS row_id, s_acctbal::DOUBLE AS x1, s_suppkey::DOUBLE AS x2 FROM supplier, unnest(range(1 + (s_suppkey % 3 = 0)::INT)) AS r(i)""")
def coco_points(spark, sf):
    """Suppliers as lines of two numbers, every third one twice and with a blank line after it, read again: blank lines have no number, repeated rows have."""
    s = _read(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("key"), F.concat_ws(" ", F.col("s_acctbal").cast("double").cast("string"), F.col("s_suppkey").cast("double").cast("string")).alias("line"))
    extra = s.where("key % 3 = 0").select("key", F.explode(F.array(F.struct(F.lit(1).alias("i"), F.col("line").alias("value")), F.struct(F.lit(2).alias("i"), F.lit("  ").alias("value")))).alias("e")).select("key", "e.i", "e.value")
    path = scratch(s)
    s.select("key", F.lit(0).alias("i"), F.col("line").alias("value")).union(extra).repartitionByRange(5, "key", "i").sortWithinPartitions("key", "i").select("value").write.text(path)
    return separated(spark, path, 2).select("row_id", F.col("x")[0].alias("x1"), F.col("x")[1].alias("x2"))


@query()
def noise_sparse(spark, sf):
    return sparse_noise(_suppliers(spark, sf).select("row_id", F.array((F.col("x")[0] / 200).alias("a"), F.lit(50.0)).alias("x"))).select("row_id", F.round(F.col("x")[0], 6).alias("x"), F.round(F.col("x")[1], 6).alias("y"))
