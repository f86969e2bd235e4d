"""Fallback against a modern code hierarchy
and its reports (A6, A7, A11, A12).

Weak links (P7) are re-matched against the hierarchy levels their year is
routed to (J6); the best level wins if it beats the existing similarity
(B1); improved rows overwrite every main row with the same (year, code)
(J9, last update wins); the rest keep the existing mapping (B2).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yearlink.functions.vectors import cosine, l2_norm
from yearlink.operators.similarity import cosine_topk

LEVELS = (2, 4, 6)
KEEP_SOURCE = "2023_mapping"


def vector_lookup(rows: DataFrame, vectors: DataFrame, year: Column, code: Column, out_col: str) -> DataFrame:
    """Attach the vector of ``(year, code)``; a repeated code keeps the
    vector of its last row (max ``item_id``); NULL codes and misses -> NULL.
    ``vectors`` needs ``item_id, year, code, embedding``."""
    v = (
        vectors.filter(F.col("code").isNotNull())
        .groupBy(F.col("year").alias("_vy"), F.col("code").alias("_vc"))
        .agg(F.max_by("embedding", "item_id").alias(out_col))
    )
    return rows.join(v, (year == v["_vy"]) & (code == v["_vc"]), "left").drop("_vy", "_vc")


def pairwise_cosine(a, b) -> Column:
    """Row-aligned cosine; NULL when either vector is missing."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).otherwise(cosine(a, b))


def low_similarity(combined="combined", emb_sim="embedding_similarity", t: float = 0.5) -> Column:
    """``combined < t OR embedding_similarity < t``; NULL compares false."""
    c = F.col(combined) if isinstance(combined, str) else combined
    e = F.col(emb_sim) if isinstance(emb_sim, str) else emb_sim
    return F.coalesce(c < t, F.lit(False)) | F.coalesce(e < t, F.lit(False))


def routed_levels(year) -> Column:
    """Hierarchy levels searched for a year: 1963-1988 -> [6];
    1930-1962 -> [4, 6]; any other year -> [2, 4, 6]."""
    y = F.col(year) if isinstance(year, str) else year
    return (
        F.when(y.between(1963, 1988), F.array(F.lit(6)))
        .when(y.between(1930, 1962), F.array(F.lit(4), F.lit(6)))
        .otherwise(F.array(F.lit(2), F.lit(4), F.lit(6)))
    )


def hierarchy_match(rows: DataFrame, hierarchy: DataFrame, id_col: str, vec_col: str, year_col: str,
                    method: str = "block") -> DataFrame:
    """J5 + J6: best hierarchy row per (row, routed level) by cosine; ties ->
    first hierarchy row (``h_id``).  Rows without a vector get no match.

    ``hierarchy`` needs ``h_id, level, hscode, description, embedding``.
    Returns ``row_id, level, hscode, description, similarity``.
    """
    left = rows.filter(F.col(vec_col).isNotNull()).select(
        F.col(id_col).alias("_id"),
        F.explode(routed_levels(year_col)).alias("level"),
        F.col(vec_col).alias("embedding"),
        l2_norm(vec_col).alias("norm"),
    )
    right = hierarchy.select("h_id", F.col("level").cast("int").alias("level"), "embedding",
                             l2_norm("embedding").alias("norm"))
    best = cosine_topk(left, right, ["level"], 1, "_id", "h_id", method=method)
    h = hierarchy.select(F.col("h_id").alias("r_id"), "hscode", "description")
    return best.join(h, "r_id").select(
        F.col("l_id").alias(id_col), "level", "hscode", "description", F.col("cos").alias("similarity")
    )


def best_of_levels(rows: DataFrame, matches: DataFrame, id_col: str = "row_id", keep: str = "next_year") -> DataFrame:
    """B1: pick the best level (NULL = -1; ties -> HS2, HS4, HS6) and use it
    only if it is non-NULL and beats ``embedding_similarity`` (NULL loses);
    otherwise keep the existing mapping under source '2023_mapping'.

    ``keep='next_year'`` copies ``code_n1/description_n1`` (as the reference
    does); ``keep='anchor'`` copies the mapped anchor code/description.
    """
    agg = []
    for lv in LEVELS:
        m = F.col("level") == lv
        agg += [
            F.max(F.when(m, F.col("similarity"))).alias(f"s{lv}"),
            F.max(F.when(m, F.col("hscode"))).alias(f"c{lv}"),
            F.max(F.when(m, F.col("description"))).alias(f"d{lv}"),
        ]
    piv = matches.groupBy(id_col).agg(*agg)
    r = rows.join(piv, id_col, "left")
    ranked = F.greatest(
        *[F.struct(F.coalesce(F.col(f"s{lv}"), F.lit(-1.0)).alias("s"), F.lit(10 - lv).alias("o"), F.lit(lv).alias("lv"))
          for lv in LEVELS]
    )
    r = r.withColumn("_bl", ranked["lv"])
    pick = lambda p: F.when(F.col("_bl") == 2, F.col(f"{p}2")).when(F.col("_bl") == 4, F.col(f"{p}4")).otherwise(F.col(f"{p}6"))
    bs = pick("s")
    use = bs.isNotNull() & (F.col("embedding_similarity").isNull() | (bs > F.col("embedding_similarity")))
    keep_code, keep_desc = (
        ("code_n1", "description_n1") if keep == "next_year" else ("mapped_2023_code", "mapped_2023_description")
    )
    out = r.select(
        *rows.columns,
        F.when(use, pick("c")).otherwise(F.col(keep_code)).alias("best_match_code"),
        F.when(use, bs).otherwise(F.col("embedding_similarity")).alias("best_match_similarity"),
        F.when(use, pick("d")).otherwise(F.col(keep_desc)).alias("best_match_description"),
        F.when(use, F.concat(F.lit("HS"), F.col("_bl").cast("string"))).otherwise(F.lit(KEEP_SOURCE)).alias(
            "best_match_source"
        ),
    )
    return out


BEST_COLS = ["best_match_code", "best_match_similarity", "best_match_description", "best_match_source"]


def update_by_key(main: DataFrame, updates: DataFrame, keys=("year_n", "code_n"), cols=BEST_COLS,
                  order_col: str = "row_id") -> DataFrame:
    """Overwrite ``cols`` on every main row whose key equals an update's
    key; several updates for a key -> the last (max ``order_col``) wins;
    NULL keys never match.  Adds ``_updated`` (bool)."""
    k = list(keys)
    cond = F.lit(True)
    for c in k:
        cond = cond & F.col(c).isNotNull()
    u = (
        updates.filter(cond)
        .groupBy(*k)
        .agg(F.max_by(F.struct(*[F.col(c).alias(f"_u_{c}") for c in cols]), order_col).alias("_u"))
    )
    j = main.join(u, k, "left")
    return j.select(
        *[c for c in main.columns if c not in cols],
        *[F.when(F.col("_u").isNotNull(), F.col(f"_u._u_{c}")).otherwise(F.col(c) if c in main.columns else F.lit(None)).alias(c) for c in cols],
        F.col("_u").isNotNull().alias("_updated"),
    )


def unmatched_updates(main: DataFrame, updates: DataFrame, keys=("year_n", "code_n")) -> DataFrame:
    """J9 warnings: update keys with no main row."""
    return updates.select(*keys).distinct().join(main.select(*keys).distinct(), list(keys), "left_anti")


def default_fill(df: DataFrame, keep: str = "next_year") -> DataFrame:
    """B2: rows without a best match take the kept mapping."""
    keep_code, keep_desc = (
        ("code_n1", "description_n1") if keep == "next_year" else ("mapped_2023_code", "mapped_2023_description")
    )
    empty = F.col("best_match_code").isNull()
    return df.select(
        *[c for c in df.columns if c not in BEST_COLS],
        F.when(empty, F.col(keep_code)).otherwise(F.col("best_match_code")).alias("best_match_code"),
        F.when(empty, F.col("embedding_similarity")).otherwise(F.col("best_match_similarity")).alias(
            "best_match_similarity"
        ),
        F.when(empty, F.col(keep_desc)).otherwise(F.col("best_match_description")).alias("best_match_description"),
        F.when(empty, F.lit(KEEP_SOURCE)).otherwise(F.col("best_match_source")).alias("best_match_source"),
    )


def merge_back(main: DataFrame, processed: DataFrame, keep: str = "next_year") -> DataFrame:
    """B3 = P9 (improved rows only) -> J9 -> B2."""
    improved = processed.filter(F.col("best_match_source") != KEEP_SOURCE)
    base = main
    for c in BEST_COLS:
        if c not in base.columns:
            base = base.withColumn(c, F.lit(None).cast("double" if c == "best_match_similarity" else "string"))
    return default_fill(update_by_key(base, improved), keep)


def kept_descriptions(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """B2, last step, where the kept mapping holds :func:`text_key` in place of
    its description: put the text there.  ``texts`` needs ``key, text``."""
    kept = F.col("best_match_source") == KEEP_SOURCE
    # the others look nothing up: spread over the tasks, not gathered on a few names
    key = F.when(kept, F.col("best_match_description")).otherwise(F.xxhash64(*rows.columns).cast("string"))
    j = rows.join(texts, key == F.col("key"), "left")
    text = F.when(kept, F.col("text")).otherwise(F.col("best_match_description"))
    return j.withColumn("best_match_description", text).drop("key", "text")


def improvement(merged: DataFrame) -> DataFrame:
    """Rows updated, % updated, mean similarity before / after, gain %."""
    return merged.agg(
        F.count_if(F.col("_updated")).alias("n_updated"),
        (F.count_if(F.col("_updated")) * 100.0 / F.count(F.lit(1))).alias("pct_updated"),
        F.avg("embedding_similarity").alias("mean_before"),
        F.avg("best_match_similarity").alias("mean_after"),
        ((F.avg("best_match_similarity") / F.avg("embedding_similarity") - 1) * 100.0).alias("gain_pct"),
    )


def match_stats(matches: DataFrame) -> DataFrame:
    """Non-null count, mean, min, max of the similarity per level."""
    return matches.groupBy("level").agg(
        F.count("similarity").alias("n"),
        F.avg("similarity").alias("mean"),
        F.min("similarity").alias("min"),
        F.max("similarity").alias("max"),
    )


def source_stats(df: DataFrame) -> DataFrame:
    """Count and mean best similarity per source."""
    return df.groupBy("best_match_source").agg(
        F.count(F.lit(1)).alias("n"), F.avg("best_match_similarity").alias("mean_similarity")
    )


def code_description(df: DataFrame, hierarchy: DataFrame, code_col: str, level: int = 2) -> DataFrame:
    """Left lookup of a code's level description (chapter by default).
    The hierarchy key must be unique per level: checked by a distinct count
    in :func:`assert_unique_codes`."""
    h = hierarchy.filter(F.col("level") == level).select(
        F.col("hscode").alias("_hc"), F.col("description").alias(f"hs{level}_description")
    )
    return df.join(h, F.col(code_col) == F.col("_hc"), "left").drop("_hc")


def assert_unique_codes(hierarchy: DataFrame) -> None:
    dup = hierarchy.groupBy("level", "hscode").count().filter("count > 1").limit(1).count()
    if dup:
        raise ValueError("hierarchy has repeated (level, hscode) keys")
