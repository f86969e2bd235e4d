"""The approximate index against the exact one."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF0001, SF001
from yearlink.operators.ann import build_ivf, search_ivf
from yearlink.plans.search import flat_index_search
from yearlink.sources import fixtures as fx


@pytest.mark.parametrize("sf", [SF0001, SF001])
def test_recall_against_the_exact_search(spark, tmp_path, sf):
    vectors = fx.vec(spark, sf)
    # queries near vectors and the benchmark's own
    near = vectors.where("id % 10 = 0").select((F.col("id") + 1_000_000).alias("query_id"), F.transform("embedding", lambda x, i: (x + 0.01 * (i % 3)).cast("float")).alias("embedding"))
    queries = fx.queries_v(spark, sf).select("query_id", "embedding").union(near)
    build_ivf(vectors, str(tmp_path / "i"))
    lists = spark.read.parquet(str(tmp_path / "i" / "lists"))
    assert lists.count() == vectors.count() == lists.select("id").distinct().count()
    want = flat_index_search(queries, vectors, 10)
    got = search_ivf(spark, queries, str(tmp_path / "i"), 10)
    hits = want.join(got, ["query_id", "id"]).count()
    recall = hits / want.count()
    print("recall", recall, "lists", lists.select("list").distinct().count())
    assert recall >= 0.9
    # what it finds has the exact score
    assert want.alias("w").join(got.alias("g"), ["query_id", "id"]).where(F.col("w.score") != F.col("g.score")).count() == 0


def test_odd_vectors(spark, tmp_path):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, 0.0]), (4, [1.0, 0.0]), (5, [-1.0, 0.5])], "id long, embedding array<float>")
    q = spark.createDataFrame([(9, [2.0, 0.0]), (10, [0.0, 0.0])], "query_id long, embedding array<float>")
    build_ivf(v, str(tmp_path / "i"), lists=2)
    got = {(r.query_id, r.id): r.score for r in search_ivf(spark, q, str(tmp_path / "i"), 3, probes=2).collect()}
    assert got[9, 3] == got[9, 4] == 1.0 and len([1 for k in got if k[0] == 9]) == 3
    build_ivf(v.limit(0), str(tmp_path / "e"))
    assert search_ivf(spark, q, str(tmp_path / "e"), 3).collect() == []
