"""Exact per-group row numbers without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def blocked_row_number(df: DataFrame, part_col: str, order_col: str, out_col: str = "rn", block: int = 65536) -> DataFrame:
    """``row_number() over (partition by part order by order_col) - 1`` for a
    unique integer ``order_col``, computed in bounded pieces.

    Rows are cut into value-range blocks of ``block`` ids; a block holds at
    most ``block`` rows however large its group.  Per-block counts (one row
    per block) get cumulative offsets by a window over that small table, and
    the row number inside a block is a window over at most ``block`` rows.
    """
    b = F.floor(F.col(order_col) / block).cast("long")
    x = df.withColumn("_blk", b)
    counts = x.groupBy(part_col, "_blk").agg(F.count(F.lit(1)).alias("_c"))
    wo = Window.partitionBy(part_col).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_c").over(wo), F.lit(0))).drop("_c")
    wi = Window.partitionBy(part_col, "_blk").orderBy(order_col)
    return (
        x.join(offsets, [part_col, "_blk"])
        .withColumn(out_col, F.col("_off") + F.row_number().over(wi) - 1)
        .drop("_blk", "_off")
    )
