"""Rows of a stream are flagged as those of a batch are."""

import random

from pyspark.sql import functions as F

from outrate.operators import ratedistortion as rd
from outrate.operators.state import kept
from outrate.streaming import frozen


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, i % 3, [rng.gauss(9 * (i % 3), 1), rng.gauss(0, 1)]) for i in range(300)]
    clusters = kept(spark.createDataFrame(rows, "row_id long, cluster long, x array<double>"))
    ks = [2.0, 5.0, 9.0]
    bounds = kept(frozen.boundaries(clusters, 2, ks))
    new = kept(spark.createDataFrame([(1000 + i, [rng.uniform(-5, 25), rng.uniform(-6, 6)]) for i in range(200)], "row_id long, x array<double>"))
    new.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(new.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    query = frozen.flagged(stream, bounds, 2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, frozen.flagged(new, bounds, 2).collect())) and len({k for *_, k in got}) == 3
    own = {(r.row_id, r.k) for r in frozen.flagged(clusters.select("row_id", "x"), bounds, 2).collect()}
    near = {r.row_id for r in clusters.join(frozen.flagged(clusters.select("row_id", "x"), bounds.withColumn("radius", F.lit(0.0)), 2), "row_id").where("center = cluster").collect()}
    batch = {(r.row_id, r.k) for r in rd.purge_parametric(rd.single(clusters), 2, ks).collect()}
    assert {x for x in own if x[0] in near} == {x for x in batch if x[0] in near} and len(near) > 250
