"""J3 shortcut: queries whose winner is known from equal text and vector.

Where a candidate has the query's text and vector, all three terms of the
blended score are 1 and nothing can beat it; the winner is the smallest such
candidate.  This is a hash join on (group, text, vector), so these queries do
not enter the quadratic stage.  A query only leaves through it when that is
proven exact:

* all candidates of its group with that text have one vector, so no other
  vector that rounds to the same cosine can come first;
* the candidate is inside the cosine top-k: no more than ``top_k`` candidates
  lie in the cells around the query's unit vector that hold everything whose
  cosine rounds to 1.

The candidate side is one row for each distinct text, so the join is
many-to-one and a text that a third of all rows share does not multiply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cosines are ranked to nine decimals.  One that rounds to 1 differs by 5e-10
# at most, so the unit vectors are at most sqrt(2 * 5e-10) = 3.2e-5 apart, less
# than the width of a cell.
_CELL = 1e-4


def _cell(i: int) -> Column:
    x = F.coalesce(F.get("embedding", F.lit(i)).cast("double"), F.lit(0.0))
    return F.floor(x / F.col("norm") / _CELL)


def identical_counterparts(queries: DataFrame, candidates: DataFrame, group: str, text: Column, top_k: int) -> DataFrame:
    """``(q_id, c_id)`` of the queries that are settled.  Both sides need
    ``item_id, tokens, ntok, embedding, norm`` and the columns of ``text``; a
    text without tokens, a zero or missing vector settles nothing."""
    has_vector = (F.col("norm") > 0) & ~F.isnan("norm") & (F.col("norm") < float("inf"))
    vector = F.struct(F.xxhash64("embedding").alias("a"), F.hash("embedding").alias("b"), F.size("embedding").alias("n"))
    cells = [_cell(0).alias("_x"), _cell(1).alias("_y")]
    some = candidates.where(has_vector & (F.col("ntok") > 0))
    same = (
        some.select(group, text.alias("_text"), vector.alias("_v"), "item_id")
        .groupBy(group, "_text")
        .agg(F.min("item_id").alias("c_id"), F.min("_v").alias("_v"), F.max("_v").alias("_w"))
        .where("_v = _w")
        .drop("_w")
    )
    # candidates in a cell and its eight neighbours
    shift = F.explode(F.expr("transform(sequence(0, 8), i -> struct(i % 3 - 1 as dx, i div 3 - 1 as dy))")).alias("_s")
    crowd = candidates.where(has_vector).select(group, *cells).groupBy(group, "_x", "_y").agg(F.count("*").alias("n"))
    crowd = crowd.select(group, "_x", "_y", "n", shift).groupBy(
        group, (F.col("_x") + F.col("_s.dx")).alias("_x"), (F.col("_y") + F.col("_s.dy")).alias("_y")
    ).agg(F.sum("n").alias("n"))
    few = crowd.where(F.col("n") <= top_k).select(group, "_x", "_y")
    q = queries.where(has_vector & (F.col("ntok") > 0)).select(
        F.col("item_id").alias("q_id"), group, text.alias("_text"), vector.alias("_v"), *cells
    )
    return q.join(same, [group, "_text", "_v"]).join(few, [group, "_x", "_y"], "left_semi").select("q_id", "c_id")
