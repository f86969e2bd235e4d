"""Registered queries: fallback stage.

Fixture pipeline: the C2-chained synthetic edges get the vector of their own
(year, code) and of their mapped 2023 code (J4), an embedding similarity
(J10); weak rows (P7) are matched against the hierarchy levels routed by
year (J6, J5), the best level is chosen (B1) and merged back by key
(P9, J9, B2).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from yearlink.functions.text import norm_desc, prefix2, text_key
from yearlink.operators import fallback as fb
from yearlink.operators.report import era_label
from yearlink.plans.chain import chain_by_description
from yearlink.plans.queries_chain import C2_SQL
from yearlink.plans.registry import register, round_doubles
from yearlink.session import parquet_table
from yearlink.sources import fixtures as fx

COS = (
    "round(CASE WHEN sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[])))"
    " * sqrt(list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[]))) > 0"
    " THEN list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
    " / (sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[])))"
    " * sqrt(list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[])))) ELSE 0.0 END, 9)"
)

FB_SQL = (
    C2_SQL
    + ",\n  hierarchy AS ("
    + fx.SQL["hierarchy"]
    + ")"
    + f""",
  vecs AS (SELECT year, code, arg_max(embedding, item_id) AS emb FROM items WHERE code IS NOT NULL GROUP BY year, code),
  m AS (SELECT c.*, v1.emb AS v_n, v2.emb AS v_a FROM chained c
        LEFT JOIN vecs v1 ON v1.year = c.year_n AND v1.code = c.code_n
        LEFT JOIN vecs v2 ON v2.year = 2023 AND v2.code = c.mapped_2023_code),
  m2 AS (SELECT *, CASE WHEN v_n IS NULL OR v_a IS NULL THEN NULL ELSE {COS.format(a='v_n', b='v_a')} END
                   AS embedding_similarity FROM m),
  low AS (SELECT * FROM m2 WHERE coalesce(combined < 0.5, false) OR coalesce(embedding_similarity < 0.5, false)),
  lv AS (SELECT row_id, v_n, unnest(CASE WHEN year_n BETWEEN 1963 AND 1988 THEN [6]
                                         WHEN year_n BETWEEN 1930 AND 1962 THEN [4, 6]
                                         ELSE [2, 4, 6] END) AS level
         FROM low WHERE v_n IS NOT NULL),
  hm AS (SELECT row_id, level, hscode, description, similarity FROM
          (SELECT lv.row_id, lv.level, h.hscode, h.description, {COS.format(a='lv.v_n', b='h.embedding')} AS similarity,
                  row_number() OVER (PARTITION BY lv.row_id, lv.level
                                     ORDER BY {COS.format(a='lv.v_n', b='h.embedding')} DESC, h.item_id) AS k
           FROM lv JOIN hierarchy h ON h.level = lv.level) WHERE k = 1),
  piv AS (SELECT row_id,
            max(CASE WHEN level = 2 THEN similarity END) AS s2, max(CASE WHEN level = 2 THEN hscode END) AS c2,
            max(CASE WHEN level = 2 THEN description END) AS d2,
            max(CASE WHEN level = 4 THEN similarity END) AS s4, max(CASE WHEN level = 4 THEN hscode END) AS c4,
            max(CASE WHEN level = 4 THEN description END) AS d4,
            max(CASE WHEN level = 6 THEN similarity END) AS s6, max(CASE WHEN level = 6 THEN hscode END) AS c6,
            max(CASE WHEN level = 6 THEN description END) AS d6
          FROM hm GROUP BY row_id),
  b0 AS (SELECT low.*, piv.* EXCLUDE (row_id),
                CASE WHEN coalesce(s2, -1) >= coalesce(s4, -1) AND coalesce(s2, -1) >= coalesce(s6, -1) THEN 2
                     WHEN coalesce(s4, -1) >= coalesce(s6, -1) THEN 4 ELSE 6 END AS bl
         FROM low LEFT JOIN piv USING (row_id)),
  b1 AS (SELECT *, CASE bl WHEN 2 THEN s2 WHEN 4 THEN s4 ELSE s6 END AS bs FROM b0),
  best AS (SELECT row_id, year_n, code_n,
             CASE WHEN bs IS NOT NULL AND (embedding_similarity IS NULL OR bs > embedding_similarity) THEN true ELSE false END AS use_,
             CASE WHEN bs IS NOT NULL AND (embedding_similarity IS NULL OR bs > embedding_similarity)
                  THEN (CASE bl WHEN 2 THEN c2 WHEN 4 THEN c4 ELSE c6 END) ELSE code_n1 END AS best_match_code,
             CASE WHEN bs IS NOT NULL AND (embedding_similarity IS NULL OR bs > embedding_similarity)
                  THEN bs ELSE embedding_similarity END AS best_match_similarity,
             CASE WHEN bs IS NOT NULL AND (embedding_similarity IS NULL OR bs > embedding_similarity)
                  THEN (CASE bl WHEN 2 THEN d2 WHEN 4 THEN d4 ELSE d6 END) ELSE description_n1 END AS best_match_description,
             CASE WHEN bs IS NOT NULL AND (embedding_similarity IS NULL OR bs > embedding_similarity)
                  THEN 'HS' || CAST(bl AS VARCHAR) ELSE '2023_mapping' END AS best_match_source
           FROM b1),
  upd AS (SELECT year_n, code_n,
                 arg_max(struct_pack(c := best_match_code, s := best_match_similarity, d := best_match_description,
                                     src := best_match_source), row_id) AS u
          FROM best WHERE best_match_source <> '2023_mapping' AND code_n IS NOT NULL AND year_n IS NOT NULL
          GROUP BY year_n, code_n),
  final AS (SELECT m2.row_id, m2.year_n, m2.code_n, m2.code_n1, m2.embedding_similarity, u IS NOT NULL AS updated,
                   CASE WHEN u IS NOT NULL AND u.c IS NOT NULL THEN u.c ELSE m2.code_n1 END AS best_match_code,
                   CASE WHEN u IS NOT NULL AND u.c IS NOT NULL THEN u.s ELSE m2.embedding_similarity END AS best_match_similarity,
                   CASE WHEN u IS NOT NULL AND u.c IS NOT NULL THEN u.d ELSE m2.description_n1 END AS best_match_description,
                   CASE WHEN u IS NOT NULL AND u.c IS NOT NULL THEN u.src ELSE '2023_mapping' END AS best_match_source
            FROM m2 LEFT JOIN upd USING (year_n, code_n))
"""
)


def _stage(spark, sf):
    """Spark side of the fixture pipeline; returns the intermediate frames.

    Neither texts nor vectors travel along: descriptions are ``text_key``s
    (``texts`` has the texts, see :func:`_with_text`), and the scored rows say
    only whether a vector was found."""
    it = parquet_table(fx.items(spark, sf), "items")  # read eight times below
    texts = it.select(text_key("description").alias("key"), F.col("description").alias("text")).distinct()
    both = F.struct(text_key(norm_desc("description")).alias("node"), text_key("description").alias("text"))
    edges = fx.synthetic_edges(spark, sf, it.select("item_id", "year", "code", both.alias("description")))
    edges = edges.select(
        "row_id", "year_n", "year_n1", "code_n", "code_n1", F.col("description_n.node").alias("description_n"),
        F.col("description_n1.node").alias("description_n1"), F.col("description_n1.text").alias("text_n1"), "combined",
    )
    chained = chain_by_description(parquet_table(edges, "edges"))  # read twice there
    chained = chained.select(
        "row_id", "year_n", "code_n", "code_n1", F.col("text_n1").alias("description_n1"), "combined", "mapped_2023_code"
    )
    m = fb.vector_lookup(chained, it, F.col("year_n"), F.col("code_n"), "v_n")
    m = fb.vector_lookup(m, it, F.lit(2023), F.col("mapped_2023_code"), "v_a")
    m = m.withColumn("embedding_similarity", fb.pairwise_cosine("v_n", "v_a"))
    m = m.withColumn("has_v_n", F.col("v_n").isNotNull()).withColumn("has_v_a", F.col("v_a").isNotNull())
    # read by low, best and final: written once, each reads its own columns
    m2 = parquet_table(m.drop("v_n", "v_a"), "scored")
    low = m2.filter(fb.low_similarity())
    h = fx.hierarchy(spark, sf).withColumnRenamed("item_id", "h_id")
    weak = fb.vector_lookup(low.select("row_id", "year_n", "code_n"), it, F.col("year_n"), F.col("code_n"), "v_n")
    hm = fb.hierarchy_match(weak, h, "row_id", "v_n", "year_n")
    best = fb.best_of_levels(low, hm)
    final = fb.merge_back(m2, best)
    return {"m2": m2, "low": low, "hm": hm, "best": best, "final": final, "hierarchy": h, "texts": texts}


def _with_text(st, name: str):
    return fb.kept_descriptions(st[name], st["texts"])


@register(
    "vector_lookup",
    FB_SQL + "SELECT year_n, count(v_n) AS n_found, count(v_a) AS n_found_anchor FROM m GROUP BY year_n",
)
def q_vector_lookup(spark, sf):
    """Vectors found for (year, code) and (2023, mapped code), per year."""
    m2 = _stage(spark, sf)["m2"]
    return m2.groupBy("year_n").agg(F.count_if("has_v_n").alias("n_found"), F.count_if("has_v_a").alias("n_found_anchor"))


@register("pairwise_cosine", FB_SQL + "SELECT row_id, embedding_similarity FROM m2")
def q_pairwise_cosine(spark, sf):
    """Row-aligned cosine of an item and its mapped 2023 item."""
    return _stage(spark, sf)["m2"].select("row_id", "embedding_similarity")


@register("low_similarity", FB_SQL + "SELECT year_n, count(*) AS n_low FROM low GROUP BY year_n")
def q_low_similarity(spark, sf):
    """Rows with combined < 0.5 or embedding similarity < 0.5, per year."""
    return _stage(spark, sf)["low"].groupBy("year_n").agg(F.count(F.lit(1)).alias("n_low"))


@register(
    "level_routing",
    fx.with_views("items")
    + """SELECT year, CASE WHEN year BETWEEN 1963 AND 1988 THEN '6'
                   WHEN year BETWEEN 1930 AND 1962 THEN '4,6' ELSE '2,4,6' END AS levels
FROM (SELECT DISTINCT year FROM items)""",
)
def q_level_routing(spark, sf):
    """Hierarchy levels searched per year."""
    levels = F.array_join(F.transform(fb.routed_levels("year"), lambda x: x.cast("string")), ",")
    return fx.items(spark, sf).select("year").distinct().select("year", levels.alias("levels"))


@register("hierarchy_match", FB_SQL + "SELECT row_id, level, hscode, similarity FROM hm")
def q_hierarchy_match(spark, sf):
    """Best hierarchy row per weak row and routed level (tiled cosine)."""
    return _stage(spark, sf)["hm"].select("row_id", "level", "hscode", "similarity")


@register(
    "best_of_levels",
    FB_SQL + "SELECT row_id, best_match_code, best_match_similarity, best_match_description, best_match_source FROM best",
)
def q_best_of_levels(spark, sf):
    """B1: best level vs existing mapping for weak rows."""
    return _with_text(_stage(spark, sf), "best").select(
        "row_id", "best_match_code", "best_match_similarity", "best_match_description", "best_match_source"
    )


@register(
    "source_filter",
    FB_SQL + "SELECT row_id, best_match_source FROM best WHERE best_match_source <> '2023_mapping'",
)
def q_source_filter(spark, sf):
    """Processed rows that improved on the existing mapping."""
    return _stage(spark, sf)["best"].filter(F.col("best_match_source") != fb.KEEP_SOURCE).select(
        "row_id", "best_match_source"
    )


@register(
    "update_by_key",
    FB_SQL + "SELECT row_id, updated, best_match_code, best_match_similarity, best_match_source FROM final WHERE updated",
)
def q_update_by_key(spark, sf):
    """Main rows overwritten by an improved row with the same (year, code)."""
    f = _stage(spark, sf)["final"]
    return f.filter("_updated").select(
        "row_id", F.col("_updated").alias("updated"), "best_match_code", "best_match_similarity", "best_match_source"
    )


@register(
    "default_fill",
    FB_SQL
    + """SELECT row_id, best_match_code, best_match_similarity, best_match_description, best_match_source
FROM final WHERE NOT updated""",
)
def q_default_fill(spark, sf):
    """B2: rows that keep the existing mapping, with what they keep."""
    f = _with_text(_stage(spark, sf), "final")
    return f.filter(~F.col("_updated")).select(
        "row_id", "best_match_code", "best_match_similarity", "best_match_description", "best_match_source"
    )


@register(
    "merge_back",
    FB_SQL
    + """SELECT row_id, year_n, code_n, best_match_code, best_match_similarity, best_match_description, best_match_source
FROM final""",
)
def q_merge_back(spark, sf):
    """Full merge of improved rows into the main table."""
    return _with_text(_stage(spark, sf), "final").select(
        "row_id", "year_n", "code_n", "best_match_code", "best_match_similarity", "best_match_description",
        "best_match_source",
    )


@register(
    "improvement",
    FB_SQL
    + """SELECT count(*) FILTER (WHERE updated) AS n_updated,
       round(count(*) FILTER (WHERE updated) * 100.0 / count(*), 6) AS pct_updated,
       round(avg(embedding_similarity), 6) AS mean_before, round(avg(best_match_similarity), 6) AS mean_after,
       round((avg(best_match_similarity) / avg(embedding_similarity) - 1) * 100.0, 6) AS gain_pct
FROM final""",
)
def q_improvement(spark, sf):
    """Update share and mean similarity before/after."""
    return round_doubles(fb.improvement(_stage(spark, sf)["final"]))


@register(
    "match_stats",
    FB_SQL
    + """SELECT level, count(similarity) AS n, round(avg(similarity), 6) AS mean,
       min(similarity) AS min, max(similarity) AS max FROM hm GROUP BY level""",
)
def q_match_stats(spark, sf):
    """Per-level similarity statistics of the hierarchy matches."""
    return round_doubles(fb.match_stats(_stage(spark, sf)["hm"]), 6).select(
        "level", "n", "mean", F.col("min"), F.col("max")
    )


@register(
    "source_stats",
    FB_SQL
    + """SELECT best_match_source, count(*) AS n, round(avg(best_match_similarity), 6) AS mean_similarity
FROM final GROUP BY best_match_source""",
)
def q_source_stats(spark, sf):
    """Count and mean best similarity per source."""
    return round_doubles(fb.source_stats(_stage(spark, sf)["final"]))


ERA_SQL = """CASE WHEN {y} BETWEEN 1789 AND 1929 THEN 'Pre-TSUS (1789-1929)'
     WHEN {y} BETWEEN 1930 AND 1962 THEN 'TSUS (1930-1962)'
     WHEN {y} BETWEEN 1963 AND 1988 THEN 'TSUSA (1963-1988)'
     WHEN {y} BETWEEN 1989 AND 2023 THEN 'HTSUS (1989-2023)' ELSE 'Unknown' END"""


@register(
    "period_report",
    FB_SQL
    + f"""SELECT {ERA_SQL.format(y='year_n')} AS period, count(*) AS n_rows,
       count(*) FILTER (WHERE best_match_source <> '2023_mapping') AS n_remapped,
       round(avg(best_match_similarity), 6) AS mean_similarity
FROM final GROUP BY period""",
)
def q_period_report(spark, sf):
    """Rows, remapped rows and mean similarity per period."""
    f = _stage(spark, sf)["final"]
    return round_doubles(
        f.groupBy(era_label("year_n").alias("period")).agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col("best_match_source") != fb.KEEP_SOURCE).alias("n_remapped"),
            F.avg("best_match_similarity").alias("mean_similarity"),
        )
    )


@register(
    "code_description",
    FB_SQL
    + """SELECT f.row_id, CASE WHEN length(f.best_match_code) >= 2 THEN substr(f.best_match_code, 1, 2) END AS chapter,
       h.description AS hs2_description
FROM final f LEFT JOIN hierarchy h ON h.level = 2
 AND h.hscode = CASE WHEN length(f.best_match_code) >= 2 THEN substr(f.best_match_code, 1, 2) END""",
)
def q_code_description(spark, sf):
    """Chapter (F12 prefix) of the best code, with its description."""
    st = _stage(spark, sf)
    f = st["final"].select("row_id", prefix2("best_match_code").alias("chapter"))
    return fb.code_description(f, st["hierarchy"], "chapter", 2).select("row_id", "chapter", "hs2_description")


@register(
    "unmatched_updates",
    FB_SQL
    + """SELECT u.year_n, count(*) AS n_keys FROM
  (SELECT DISTINCT year_n, code_n FROM best WHERE best_match_source <> '2023_mapping') u
WHERE NOT EXISTS (SELECT 1 FROM m2 WHERE m2.year_n >= 1930 AND m2.year_n = u.year_n AND m2.code_n = u.code_n)
GROUP BY u.year_n""",
)
def q_unmatched_updates(spark, sf):
    """J9 warnings: improved keys with no row in a main table that only
    covers the periods from 1930 on (left anti join), per year."""
    st = _stage(spark, sf)
    improved = st["best"].filter(F.col("best_match_source") != fb.KEEP_SOURCE)
    main = st["m2"].filter(F.col("year_n") >= 1930)
    return fb.unmatched_updates(main, improved).groupBy("year_n").agg(F.count(F.lit(1)).alias("n_keys"))
