"""Exact median per group without gathering a group into one task.

Spark's exact ``median``/``percentile`` keeps every value of a group in one
aggregation buffer; with one era holding a third of all rows that buffer is
a third of the table.  Here each group's value range is narrowed by
equal-width histograms (plain grouped counts with map-side partial
aggregation) until the values around the middle ranks are few, and only
those are gathered and sorted.  The result equals the interpolated median.
The two middle ranks have a bracket each: they may lie in different clusters
of values.  Every round drops values from a wide bracket, as its smallest and
largest value fall into different bins, so no more than ``gather_limit``
values of a bracket are ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from yearlink.session import checkpoint_table


def exact_median(df: DataFrame, group_cols: list[str], col: str, out_col: str = "median",
                 bins: int = 1024, gather_limit: int = 200_000) -> DataFrame:
    """Interpolated median of non-NULL ``col`` per group (NULL if none)."""
    g = list(group_cols)
    key = [*g, "_k"]
    allx = df.select(*g, F.col(col).cast("double").alias("_x"))
    x = allx.filter(F.col("_x").isNotNull())
    # a row per group and middle rank: [lo, hi] holds the 0-based rank r, `below`
    # values lie under lo.  Groups without values keep NULL bounds -> NULL median.
    st = allx.groupBy(*g).agg(F.count("_x").alias("_cnt"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    st = checkpoint_table(
        st.withColumn("_k", F.explode(F.array(F.lit(1), F.lit(2)))).select(
            *key, "_lo", "_hi", F.lit(0).cast("long").alias("_below"), "_cnt",
            F.floor((F.col("_cnt") - F.when(F.col("_k") == 1, 1).otherwise(0)) / 2).cast("long").alias("_r"),
        )
    )
    while True:
        wide = st.filter((F.col("_cnt") > gather_limit) & (F.col("_hi") > F.col("_lo")))
        if wide.isEmpty():
            break
        j = x.join(wide.select(*key, "_lo", "_hi"), g).filter(F.col("_x").between(F.col("_lo"), F.col("_hi")))
        b = F.least(F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))
        h = j.groupBy(*key, b.cast("int").alias("_b")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_bmin"), F.max("_x").alias("_bmax")
        )
        w = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        new = (
            h.join(wide.select(*key, "_below", "_r"), key)
            .withColumn("_before", F.col("_below") + F.coalesce(F.sum("_c").over(w), F.lit(0)))
            .filter((F.col("_before") <= F.col("_r")) & (F.col("_r") < F.col("_before") + F.col("_c")))
            .select(*key, F.col("_bmin").alias("_nlo"), F.col("_bmax").alias("_nhi"),
                    F.col("_before").alias("_nbelow"), F.col("_c").alias("_ncnt"))
        )
        st = checkpoint_table(
            st.join(new, key, "left").select(
                *key, F.coalesce("_nlo", "_lo").alias("_lo"), F.coalesce("_nhi", "_hi").alias("_hi"),
                F.coalesce("_nbelow", "_below").alias("_below"), F.coalesce("_ncnt", "_cnt").alias("_cnt"), "_r",
            )
        )
    # gather the few values of each bracket that is not a single value
    narrow = st.filter(F.col("_lo") < F.col("_hi")).select(*key, "_lo", "_hi")
    vals = x.join(narrow, g).filter(F.col("_x").between(F.col("_lo"), F.col("_hi")))
    gathered = vals.groupBy(*key).agg(F.sort_array(F.collect_list("_x")).alias("_v"))
    at = F.element_at("_v", (F.col("_r") - F.col("_below") + 1).cast("int"))
    value = F.when(F.col("_lo") < F.col("_hi"), at).otherwise(F.col("_lo"))
    found = st.join(gathered, key, "left").select(*key, value.alias("_val"))
    v1, v2 = (F.max(F.when(F.col("_k") == k, F.col("_val"))) for k in (1, 2))
    return found.groupBy(*g).agg((v1 + (v2 - v1) * 0.5).alias(out_col))
