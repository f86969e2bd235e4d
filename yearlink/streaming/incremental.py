"""Incremental matching of newly arriving editions (S10 as a stream).

The reference skips year pairs whose output already exists.  Here new
yearly item files land in a folder; a file-source Structured Streaming query
(``trigger(availableNow=True)``) picks up only files it has not seen (its
checkpoint records them, so a restart neither loses nor repeats a file).
Each micro-batch:

1. the years present in the batch,
2. the adjacent pairs of the full item table that touch those years: all of
   them are matched, also those written before, as either edition has grown,
3. matched against the full item table and written with dynamic partition
   overwrite -- one folder per year pair, so a re-run replaces, never
   duplicates,
4. pairs in the sink that are no longer adjacent (an edition has come in
   between) are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yearlink import schemas
from yearlink.operators.match import adjacent_pairs, match_year_pair
from yearlink.session import checkpoint_table
from yearlink.sources import io

ITEM_VECTOR_SCHEMA = "item_id long, year int, code string, description string, embedding array<float>"


def affected_pairs(all_items: DataFrame, new_years: DataFrame) -> DataFrame:
    """Adjacent pairs of the full table with either year among ``new_years``."""
    pairs = adjacent_pairs(all_items)
    ny = F.broadcast(new_years.select(F.col("year").alias("_y")).distinct())  # years of one batch: a handful
    a = pairs.join(ny, pairs["year_n"] == ny["_y"], "left_semi")
    b = pairs.join(ny, pairs["year_n1"] == ny["_y"], "left_semi")
    return a.unionByName(b).distinct()


def process_batch(spark: SparkSession, batch: DataFrame, items_dir: str, edges_dir: str, **match_kw) -> int:
    """Match the pairs a batch of new items touches; returns pairs written."""
    all_items = spark.read.schema(ITEM_VECTOR_SCHEMA).parquet(items_dir)
    todo = checkpoint_table(affected_pairs(all_items, batch.select("year")))  # tiny; read by the count and the matcher
    n = todo.count()
    if n:
        edges = match_year_pair(all_items, pairs=todo, **match_kw)
        io.sink_pairs(edges.select(*schemas.EDGE_COLUMNS), edges_dir)
    stale = io.done_pairs(spark, edges_dir).join(adjacent_pairs(all_items), ["year_n", "year_n1"], "left_anti")
    for r in stale.collect():  # a handful of editions
        io.drop_pair(spark, edges_dir, r["year_n"], r["year_n1"])
    return n


def run_incremental(
    spark: SparkSession, items_dir: str, edges_dir: str, checkpoint_location: str, **match_kw
) -> None:
    """Process every item file not yet seen, then stop (``availableNow``)."""
    stream = spark.readStream.schema(ITEM_VECTOR_SCHEMA).parquet(items_dir)

    def each(batch: DataFrame, epoch_id: int) -> None:
        process_batch(spark, batch, items_dir, edges_dir, **match_kw)

    q = (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint_location)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
