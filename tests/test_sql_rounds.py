"""K-means that needs more than a few dozen rounds: the SQL goes on as long as the query does."""

import duckdb
import pytest

from outrate.plans import queries


@pytest.mark.parametrize("name", ["lloyd", "cpp_lloyd", "kmeans_mm_reference"])
def test_slow_starts(spark, tmp_path, name):
    rows = [(i, f"Brand#{i % 3}", 1 + i % 2, float(i) + i % 7 / 8) for i in range(1500)]  # the first rows lie at one end
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS FROM '{tmp_path}/part.parquet/*.parquet'")
    want = sorted(con.execute(queries.SQL[name]).fetchall())
    assert sorted(map(tuple, queries.QUERIES[name](spark, str(tmp_path)).collect())) == want
    assert want
