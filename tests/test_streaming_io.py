"""Incremental stream (S10) and the scans / sinks."""

import pytest
from pyspark.sql import functions as F

from yearlink.sources import fixtures as fx
from yearlink.sources import io
from yearlink.streaming.incremental import run_incremental
from tests.conftest import SF0001


def test_incremental_matches_only_new_pairs(spark):
    base = io.scratch_path(spark, "stream")
    items_dir, edges_dir, ckpt = f"{base}/items", f"{base}/edges", f"{base}/ckpt"
    it = fx.items(spark, SF0001).cache()
    years = sorted(r.year for r in it.select("year").distinct().collect())
    first, rest = years[:3], years[3:5]
    it.filter(F.col("year").isin(*first)).write.mode("append").parquet(items_dir)
    run_incremental(spark, items_dir, edges_dir, ckpt, gamma=0.0, with_indel=False)
    done1 = {(r.year_n, r.year_n1) for r in spark.read.parquet(edges_dir).select("year_n", "year_n1").distinct().collect()}
    assert done1 == {(first[0], first[1]), (first[1], first[2])}
    it.filter(F.col("year").isin(*rest)).write.mode("append").parquet(items_dir)
    run_incremental(spark, items_dir, edges_dir, ckpt, gamma=0.0, with_indel=False)
    out = spark.read.parquet(edges_dir)
    pairs = {(r.year_n, r.year_n1) for r in out.select("year_n", "year_n1").distinct().collect()}
    assert pairs == set(zip(years[:5], years[1:5]))
    # no pair was written twice
    assert out.count() == out.select("row_id", "year_n").distinct().count()


def test_csv_roundtrip_and_pair_files(spark):
    it = fx.items(spark, SF0001)
    path = io.scratch_path(spark, "csv")
    wide = it.select(
        *[(F.col("year") if n == "year" else F.col("code") if n == "hs" else F.col("description") if n == "brief_description"
           else F.col("item_id") if n == "index" else F.lit(None).cast(t)).alias(n) for n, t in io.ITEM_CSV_COLUMNS]
    )
    io.sink_snapshot(wide, path, "csv")
    back = io.project_items(io.scan_items(spark, path))
    a = sorted(tuple(r) for r in back.collect())
    every = it.select("item_id", "year", "code", "description").collect()
    # an empty CSV field is a missing value, and items without a text are left out
    b = sorted(tuple(r) for r in every if r.description != "")
    assert a == b and len(b) < len(every)


def test_alignment_flags_one_sided_rows(spark):
    items = spark.createDataFrame([(1, 2000), (2, 2000), (3, 2001)], "item_id long, year int")
    vecs = spark.createDataFrame([(1, 2000), (3, 2001), (4, 2001)], "item_id long, year int")
    got = {r.year: (r.items_without_vector, r.vectors_without_item, r.aligned) for r in io.check_alignment(items, vecs).collect()}
    assert got == {2000: (1, 0, False), 2001: (0, 1, False)}


def _edition(spark, year, ids):
    rows = [(i, year, f"c{i}", f"thing {i % 7} of {year}", [float(i % 5 + 1), float(i % 3), 1.0]) for i in ids]
    return spark.createDataFrame(rows, "item_id long, year int, code string, description string, embedding array<float>")


def _stream_paths(spark):
    base = io.scratch_path(spark, "stream")
    return f"{base}/items", f"{base}/edges", f"{base}/ckpt"


def test_an_edition_that_arrives_in_two_files_is_matched_whole(spark):
    items_dir, edges_dir, ckpt = _stream_paths(spark)
    _edition(spark, 1789, range(10)).write.mode("append").parquet(items_dir)
    _edition(spark, 1792, range(100, 107)).write.mode("append").parquet(items_dir)
    run_incremental(spark, items_dir, edges_dir, ckpt, gamma=0.0, with_indel=False)
    assert spark.read.parquet(edges_dir).count() == 7
    _edition(spark, 1792, range(107, 113)).write.mode("append").parquet(items_dir)
    run_incremental(spark, items_dir, edges_dir, ckpt, gamma=0.0, with_indel=False)
    out = spark.read.parquet(edges_dir)
    assert out.count() == 13 == out.select("item_id_n1").distinct().count()


def test_an_edition_in_between_replaces_the_pair_around_it(spark):
    items_dir, edges_dir, ckpt = _stream_paths(spark)
    for years in ([1789, 1846], [1792]):
        for y in years:
            _edition(spark, y, range(y, y + 5)).write.mode("append").parquet(items_dir)
        run_incremental(spark, items_dir, edges_dir, ckpt, gamma=0.0, with_indel=False)
    pairs = {tuple(r) for r in spark.read.parquet(edges_dir).select("year_n", "year_n1").distinct().collect()}
    assert pairs == {(1789, 1792), (1792, 1846)}


def test_only_a_missing_sink_counts_as_nothing_done(spark):
    assert io.done_pairs(spark, io.scratch_path(spark, "none")).count() == 0
    bad = io.scratch_path(spark, "bad")
    spark.range(3).write.parquet(bad)  # a sink without the year columns
    with pytest.raises(Exception, match="year_n"):
        io.done_pairs(spark, bad).count()


def test_a_cluster_without_a_shared_folder_is_refused(spark):
    from yearlink import session

    assert session.is_local("local") and session.is_local("local[8]")
    assert not session.is_local("local-cluster[2,1,512]") and not session.is_local("spark://host:7077")

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        session.ensure_checkpoint_dir(Session())
