"""Fallback (J6, J9, B1) and report (A8-A10, A18, Q1) edge cases."""

import pytest
from pyspark.sql import functions as F

from yearlink.operators import fallback as fb
from yearlink.operators import report as rp
from yearlink.plans.search import search


def test_level_routing(spark):
    df = spark.createDataFrame([(y,) for y in (1789, 1929, 1930, 1962, 1963, 1988, 1989)], "year int")
    got = [r[0] for r in df.select(F.size(fb.routed_levels("year"))).collect()]
    assert got == [3, 3, 2, 2, 1, 1, 3]


def test_best_of_levels_rules(spark):
    rows = spark.createDataFrame(
        [(1, 0.5, "n1a", "D1"), (2, 0.7, "n1b", "D2"), (3, None, "n1c", "D3")],
        "row_id long, embedding_similarity double, code_n1 string, description_n1 string",
    )
    m = spark.createDataFrame(
        [
            (1, 2, "02", "ch", 0.8), (1, 4, "0404", "hd", 0.8), (1, 6, "060606", "sub", 0.8),  # tie -> HS2
            (2, 6, "060606", "sub", 0.7),  # equal to existing -> keep
            (3, 4, "0404", "hd", 0.1),  # null existing -> take the level
        ],
        "row_id long, level int, hscode string, description string, similarity double",
    )
    got = {r.row_id: (r.best_match_source, r.best_match_code) for r in fb.best_of_levels(rows, m).collect()}
    assert got == {1: ("HS2", "02"), 2: ("2023_mapping", "n1b"), 3: ("HS4", "0404")}


def test_update_by_key_last_wins_and_nulls(spark):
    main = spark.createDataFrame(
        [(1, 1900, "a"), (2, 1900, "a"), (3, 1900, None), (4, 1901, "a")],
        "row_id long, year_n int, code_n string",
    )
    upd = spark.createDataFrame(
        [(10, 1900, "a", "X", 0.9, "dx", "HS2"), (11, 1900, "a", "Y", 0.8, "dy", "HS4"),
         (12, 1900, None, "Z", 0.7, "dz", "HS6")],
        "row_id long, year_n int, code_n string, best_match_code string, best_match_similarity double, "
        "best_match_description string, best_match_source string",
    )
    base = main
    for c, t in [("best_match_code", "string"), ("best_match_similarity", "double"),
                 ("best_match_description", "string"), ("best_match_source", "string")]:
        base = base.withColumn(c, F.lit(None).cast(t))
    got = {r.row_id: r.best_match_code for r in fb.update_by_key(base, upd).collect()}
    assert got == {1: "Y", 2: "Y", 3: None, 4: None}


MAP_SCHEMA = "year_n int, best_match_similarity double, combined double, embedding_similarity double, best_match_source string"


def test_era_summary_null_counts_in_denominator(spark):
    df = spark.createDataFrame(
        [(1800, 0.4, 0.9, None, "HS2"), (1800, None, 0.3, 0.5, "HS4"), (1801, 0.8, 0.6, 0.7, "2023_mapping")],
        MAP_SCHEMA,
    )
    r = rp.era_summary(df).collect()[0]
    assert r["N items"] == 3
    assert r["Mean best_match"] == pytest.approx(0.6)
    assert r["% with best_match < 0.5"] == pytest.approx(33.3)
    assert r["Mean embedding"] == pytest.approx(0.6)


def test_milestone_missing_year(spark):
    df = spark.createDataFrame([(1930, 0.5, 0.5, 0.5, "HS2"), (1930, 0.7, 0.5, 0.5, "HS2")], MAP_SCHEMA)
    rows = {r["Year"]: r for r in rp.milestone_table(df, spark).collect()}
    assert rows[1930]["Count of Tariff Items"] == 2 and rows[1930]["Mean 2023 Similarity"] == 0.6
    assert rows[1963]["Count of Tariff Items"] == 0 and rows[1963]["Std. Dev."] is None


def test_crosstab_absent_category_and_precedence(spark):
    df = spark.createDataFrame(
        [(1800, 0.3, 0.5, 0.5, "HS2"), (1800, 0.9, 0.5, 0.5, "2023_mapping"), (1950, 0.9, 0.5, 0.5, "2023_mapping")],
        MAP_SCHEMA,
    )
    rows = rp.source_crosstab(df, spark).collect()
    assert [r.era for r in rows] == [e[0] for e in rp.ERAS]
    assert rows[0]["Census Website"] == 50.0 and rows[0]["Direct mapping"] == 50.0
    assert rows[0]["Detailed HS"] is None  # absent from the whole table
    assert rows[1]["Census Website"] == 0.0  # present elsewhere, missing here
    assert rows[2]["Direct mapping"] is None  # era without rows


def test_histogram_max_in_last_bin(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "s double")
    got = {r.bin: r.n for r in rp.similarity_histogram(df, "s").collect()}
    assert got == {1: 1, 26: 1, 50: 1}


def test_search_empty_description_and_large_k(spark):
    corpus = spark.createDataFrame(
        [(1, "red apple", [1.0, 0.0]), (2, "", [0.8, 0.6]), (3, "green pear", [0.0, 1.0])],
        "item_id long, description string, embedding array<float>",
    )
    q = spark.createDataFrame([(7, "red apple", [1.0, 0.0])], "query_id long, text string, embedding array<float>")
    res = {r.item_id: r for r in search(q, corpus, top_k=10).collect()}
    assert len(res) == 3
    assert res[2].combined_similarity == res[2].cosine_similarity == pytest.approx(0.8)
    assert res[1].combined_similarity == pytest.approx(1.0)
    skip = search(q, corpus, top_k=10, empty="skip").collect()
    assert sorted(r.item_id for r in skip) == [1, 3]


def test_exact_median_matches_spark_median(spark):
    from yearlink.operators.quantile import exact_median

    df = spark.range(0, 20001).select(
        (F.col("id") % 3).alias("g"),
        F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.sin(F.col("id")) * 100).alias("v"),
    ).union(spark.createDataFrame([(7, 1.5), (7, 1.5), (7, 1.5), (8, None)], "g long, v double"))
    got = {r.g: r.median for r in exact_median(df, ["g"], "v", bins=8, gather_limit=50).collect()}
    ref = {r.g: r.m for r in df.groupBy("g").agg(F.median("v").alias("m")).collect()}
    assert set(got) == set(ref)
    for k in ref:
        assert (got[k] is None and ref[k] is None) or got[k] == pytest.approx(ref[k], abs=1e-12)


def test_corpus_checks_and_formats(spark):
    import json

    from yearlink.plans.search import assert_corpus, corpus_info, format_results, verify_corpus

    good = spark.createDataFrame([(1, "a b", [1.0, 0.0]), (2, "c", [0.0, 1.0])],
                                 "item_id long, description string, embedding array<float>")
    bad = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [1.0]), (3, "c", None)],
                                "item_id long, description string, embedding array<float>")
    assert corpus_info(good).first()["embedding_dim"] == 2
    r = verify_corpus(bad).first()
    assert (r.n_items, r.n_bad_dim, r.n_missing) == (3, 1, 1)
    assert_corpus(good)
    with pytest.raises(ValueError):
        assert_corpus(bad)
    q = spark.createDataFrame([(7, "a b", [1.0, 0.0])], "query_id long, text string, embedding array<float>")
    res = search(q, good, top_k=2)
    lines = {fmt: [r.line for r in format_results(res, fmt).orderBy("rank").collect()] for fmt in ("json", "csv", "text")}
    assert json.loads(lines["json"][0])["item_id"] == 1
    assert lines["csv"][0].split(",")[0] == "7"
    assert lines["text"][0].startswith("1. [")


def test_exact_median_between_two_clusters(spark):
    """The middle ranks lie in different tight clusters, or are ties."""
    from yearlink.operators.quantile import exact_median

    low, high = [0.1 + i * 1e-6 for i in range(500)], [0.9 + i * 1e-6 for i in range(500)]
    rows = [("two", v) for v in low + high] + [("ties", v) for v in [1.0] * 400 + [2.0] * 400] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.median for r in exact_median(df, ["g"], "v", bins=8, gather_limit=20).collect()}
    assert got == {"two": (low[-1] + high[0]) / 2, "ties": 1.5, "none": None}
