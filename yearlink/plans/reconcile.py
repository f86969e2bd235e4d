"""Reconcile forward and reverse matches of the same year pair.

Documented (not coded) in the reference: match both ways; a closed cycle
(A -> B forward and B -> A reverse) is high confidence; otherwise keep the
higher score and flag the conflict.  One row per older-year item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile(forward: DataFrame, reverse: DataFrame) -> DataFrame:
    """Output per ``(year_n, item_id_n)``: chosen ``item_id_n1`` and
    ``status`` in {mutual, conflict, one_way}, ``conflict`` flag, ``score``
    and ``source`` (forward / reverse / both).

    Rank of links per item: mutual first, then higher score, then forward
    before reverse, then lower target id.  ``conflict`` = the item's links
    point to more than one target.
    """
    cols = ["year_n", "item_id_n", "year_n1", "item_id_n1", "combined"]
    links = forward.select(*cols, F.lit(1).alias("f"), F.lit(0).alias("r")).unionByName(
        reverse.select(*cols, F.lit(0).alias("f"), F.lit(1).alias("r"))
    )
    per_link = links.groupBy("year_n", "item_id_n", "year_n1", "item_id_n1").agg(
        F.max("f").alias("f"), F.max("r").alias("r"), F.max("combined").alias("score")
    )
    per_link = per_link.withColumn("mutual", (F.col("f") == 1) & (F.col("r") == 1))
    # an aggregate with map-side partial max_by, not a window: an item that is
    # the best counterpart of a third of a year never lands in one sort
    order = F.struct(
        "mutual", F.col("score").isNotNull().alias("scored"), "score", "f", (-F.col("item_id_n1")).alias("lower_id")
    )
    best = (
        per_link.groupBy("year_n", "item_id_n")
        .agg(
            F.count(F.lit(1)).alias("n_targets"),
            F.max_by(F.struct("year_n1", "item_id_n1", "mutual", "score", "f"), order).alias("best"),
        )
        .select("year_n", "item_id_n", "n_targets", "best.*")
    )
    return best.select(
        "year_n",
        "item_id_n",
        "year_n1",
        "item_id_n1",
        F.when(F.col("mutual"), "mutual").when(F.col("n_targets") > 1, "conflict").otherwise("one_way").alias("status"),
        (F.col("n_targets") > 1).alias("conflict"),
        F.col("score"),
        F.when(F.col("mutual"), "both").when(F.col("f") == 1, "forward").otherwise("reverse").alias("source"),
    )
