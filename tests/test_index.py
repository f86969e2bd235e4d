"""The stored search index and the chain paths."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF0001
from yearlink.plans.chain import chain_by_description
from yearlink.plans.index import build_index, open_index, search_index, verify_index
from yearlink.plans.search import search
from yearlink.sources import fixtures as fx

ODD = [
    (1, "red apple", "a", [1.0, 0.0]),
    (2, "", "b", [0.0, 0.0]),
    (3, None, None, [0.6, 0.8]),
    (4, "Green  Apple", "a", [0.8, 0.6]),
]
SCHEMA = "item_id long, description string, note string, embedding array<float>"


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_index_gives_the_rows_of_the_plain_search(spark, tmp_path):
    for name, corpus, queries in (
        ("a", fx.catalog(spark, SF0001), fx.queries_v(spark, SF0001)),
        ("b", spark.createDataFrame(ODD, SCHEMA), spark.createDataFrame([(7, "apple", [1.0, 0.2]), (8, "", [0.0, 0.0])], "query_id long, text string, embedding array<float>")),
    ):
        path = str(tmp_path / name)
        build_index(corpus, path)
        index = open_index(spark, path, check=True)
        assert index.info["n_items"] == corpus.count()
        for how in ({}, {"rerank": False}, {"empty": "skip", "top_k": 2}):
            assert _rows(search_index(queries, index, **how)) == _rows(search(queries, corpus, **how))


def test_search_of_an_index_computes_no_norms_or_tokens_of_the_corpus(spark, tmp_path):
    path = str(tmp_path / "i")
    build_index(fx.catalog(spark, SF0001), path)
    index = open_index(spark, path)
    assert "norm" in index.vectors.columns and "_ctok" in index.texts.columns
    plan = index.vectors.select("_cid", "embedding", "norm")._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan


def test_check_fails_on_a_tampered_index(spark, tmp_path):
    corpus = spark.createDataFrame(ODD, SCHEMA)
    path = str(tmp_path / "i")
    build_index(corpus, path)
    good = verify_index(spark, path).first()
    assert good["same_ids"] and good["same_vectors"] and good["same_texts"] and good["n_items"] == good["n_items_info"] == 4
    info = spark.createDataFrame(spark.read.parquet(f"{path}/info").collect(), spark.read.parquet(f"{path}/info").schema)
    info.withColumn("n_items", F.lit(5).cast("long")).write.mode("overwrite").parquet(f"{path}/info")
    with pytest.raises(ValueError):
        open_index(spark, path, check=True)
    info.write.mode("overwrite").parquet(f"{path}/info")
    open_index(spark, path, check=True)
    texts = spark.createDataFrame(spark.read.parquet(f"{path}/texts").collect(), spark.read.parquet(f"{path}/texts").schema)
    texts.withColumn("description", F.when(F.col("_cid") == 1, "red pear").otherwise(F.col("description"))).write.mode("overwrite").parquet(f"{path}/texts")
    bad = verify_index(spark, path).first()
    assert bad["same_ids"] and bad["same_vectors"] and not bad["same_texts"]
    build_index(corpus.where("item_id < 1"), path)
    assert open_index(spark, path, check=True).info["n_items"] == 0


def test_paths_are_the_hops_in_order(spark):
    e = [
        (1, 2000, 2005, "a", "b", "x", "y", 0.9), (2, 2005, 2010, "b", None, "y", "z", 0.4), (3, 2005, 2010, "b2", "q", "Y ", "w", 0.3),
        (4, 2010, 2023, "c", "d", "z", "t", None), (5, 2010, 2023, "q", "d2", "v", "t", 0.7), (6, 2000, 2005, "m", "n", "o", "nowhere", 0.5),
    ]
    edges = spark.createDataFrame(e, "row_id long, year_n int, year_n1 int, code_n string, code_n1 string, description_n string, description_n1 string, combined double")
    got = {r.row_id: r for r in chain_by_description(edges, with_path=True).collect()}
    assert [tuple(h) for h in got[1].path] == [(2005, "b", 0.9), (2010, None, 0.4), (2023, "d", None)]
    assert [tuple(h) for h in got[4].path] == [(2023, "d", None)]
    assert got[3].path is None and got[6].path is None
    for r in got.values():
        assert (r.hops or 0) == len(r.path or [])
        if r.path:
            assert r.path[-1].year == 2023 and r.path[-1].code == r.mapped_2023_code
