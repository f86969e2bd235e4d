"""Coverage diagnostics on chained tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yearlink.functions.text import norm_desc


def unmapped_rows(chained: DataFrame, mapped_col: str = "mapped_2023_code") -> DataFrame:
    """One row: all rows, rows without an anchor mapping."""
    return chained.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(mapped_col).isNull()).alias("n_unmapped"),
    )


def coverage_by_year(chained: DataFrame, mapped_col: str = "mapped_2023_code") -> DataFrame:
    """A1: rows and mapped rows per ``year_n``."""
    return chained.groupBy("year_n").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.col(mapped_col)).alias("n_mapped")
    )


def blank_by_year_top(chained: DataFrame, mapped_col: str = "mapped_2023_code", n: int = 10) -> DataFrame:
    """A2: unmapped rows per year, most first (ties -> earlier year), top n."""
    return (
        chained.filter(F.col(mapped_col).isNull())
        .groupBy("year_n")
        .agg(F.count(F.lit(1)).alias("n_blank"))
        .orderBy(F.desc("n_blank"), F.asc("year_n"))
        .limit(n)
    )


def dup_descriptions(df: DataFrame, year_col: str = "year_n", desc_col: str = "description_n", n: int = 15) -> DataFrame:
    """A3: per year, the number of normalised descriptions occurring more than
    once (HAVING count > 1); sorted by year, first n years."""
    groups = (
        df.select(F.col(year_col).alias("year"), norm_desc(desc_col).alias("d"))
        .groupBy("year", "d")
        .agg(F.count(F.lit(1)).alias("c"))
        .filter(F.col("c") > 1)
    )
    return groups.groupBy("year").agg(F.count(F.lit(1)).alias("n_dup_groups")).orderBy("year").limit(n)
