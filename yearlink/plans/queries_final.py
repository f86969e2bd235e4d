"""Registered queries: the whole mapping (``final_mapping``) and its era table."""

from __future__ import annotations

from pyspark.sql import functions as F

from yearlink.operators import fallback as fb
from yearlink.operators import report as rp
from yearlink.plans.chain import chain_by_description
from yearlink.plans.final import attach_text_vector, final_mapping, text_vectors
from yearlink.plans.queries_fallback import COS, FB_SQL
from yearlink.plans.queries_match import _match_nolcs_sql
from yearlink.plans.queries_report import ERA_SQL, _lt
from yearlink.plans.registry import register
from yearlink.session import parquet_table
from yearlink.sources import fixtures as fx
from yearlink.sources.fixtures import with_views


def _swap(sql: str, *pairs: tuple[str, str]) -> str:
    for old, new in pairs:
        if old not in sql:
            raise ValueError(f"the fallback SQL has no {old[:60]!r}")
        sql = sql.replace(old, new)
    return sql


def _nf(code: str) -> str:
    return f"CASE WHEN length({code}) > 8 AND {code} LIKE '%.0' THEN substr({code}, 1, length({code}) - 2) ELSE {code} END"


def _cleaned(code: str, year: str) -> str:
    return f"CASE WHEN {year} >= 1989 THEN (CASE WHEN length({_nf(code)}) = 7 THEN '0' || {_nf(code)} ELSE {_nf(code)} END) ELSE {code} END"


def _kept(code: str, year: str) -> str:
    return f"NOT ({year} >= 1989 AND coalesce(length({_nf(code)}), 0) >= 10)"


_EDGES = f"""synthetic_edges AS (
  SELECT * REPLACE ({_cleaned('code_n', 'year_n')} AS code_n, {_cleaned('code_n1', 'year_n1')} AS code_n1)
  FROM ({_match_nolcs_sql("n_to_n1")}) WHERE {_kept('code_n', 'year_n')} AND {_kept('code_n1', 'year_n1')})
"""
_TEXT_VECTORS = (
    """  vecs AS (SELECT year, code, arg_max(embedding, item_id) AS emb FROM items WHERE code IS NOT NULL GROUP BY year, code),
  m AS (SELECT c.*, v1.emb AS v_n, v2.emb AS v_a FROM chained c
        LEFT JOIN vecs v1 ON v1.year = c.year_n AND v1.code = c.code_n
        LEFT JOIN vecs v2 ON v2.year = 2023 AND v2.code = c.mapped_2023_code),""",
    """  vecs AS (SELECT description, arg_min(embedding, item_id) AS emb FROM items WHERE description IS NOT NULL GROUP BY description),
  m AS (SELECT c.*, v1.emb AS v_n, v2.emb AS v_a FROM chained c
        LEFT JOIN vecs v1 ON v1.description = c.description_n
        LEFT JOIN vecs v2 ON v2.description = c.mapped_2023_description),""",
)
BY_TEXT_SQL = _swap(FB_SQL, _TEXT_VECTORS)
FINAL_SQL = _swap(
    BY_TEXT_SQL,
    (with_views("synthetic_edges", recursive=True), with_views("items", recursive=True).rstrip() + ",\n" + _EDGES),
    (
        "low AS (SELECT * FROM m2 WHERE coalesce(combined < 0.5, false) OR coalesce(embedding_similarity < 0.5, false))",
        "low AS (SELECT * FROM m2 WHERE (coalesce(combined < 0.5, false) OR coalesce(embedding_similarity < 0.5, false)) AND year_n < 1989)",
    ),
    ("m2.embedding_similarity, u IS NOT NULL AS updated", "m2.embedding_similarity, m2.combined, u IS NOT NULL AS updated"),
)


@register(
    "pairwise_cosine_text",
    BY_TEXT_SQL + "SELECT row_id, embedding_similarity FROM m2",
)
def q_pairwise_cosine_text(spark, sf):
    """Cosine of the row's own text and its mapped 2023 text, with one
    vector for each different text."""
    it = parquet_table(fx.items(spark, sf), "items")
    v = text_vectors(it)
    m = attach_text_vector(chain_by_description(fx.synthetic_edges(spark, sf, it)), v, "description_n", "v_n")
    m = attach_text_vector(m, v, "mapped_2023_description", "v_a")
    return m.select("row_id", fb.pairwise_cosine("v_n", "v_a").alias("embedding_similarity"))


def _final(spark, sf):
    hierarchy = fx.hierarchy(spark, sf).withColumnRenamed("item_id", "h_id")
    return final_mapping(fx.items(spark, sf), hierarchy, gamma=0.0, with_indel=False)


@register(
    "final_mapping",
    FINAL_SQL
    + """SELECT row_id, year_n, code_n, round(combined, 6) AS combined, embedding_similarity, best_match_code, best_match_similarity,
       best_match_description, best_match_source FROM final""",
)
def q_final_mapping(spark, sf):
    """J3 -> F11 -> C2 -> J10 -> P7/J6/J5 (before 1989) -> B1-B3 in one job
    (gamma = 0, so that SQL can repeat it)."""
    return _final(spark, sf).select(
        "row_id", "year_n", "code_n", F.round("combined", 6).alias("combined"), "embedding_similarity", "best_match_code",
        "best_match_similarity", "best_match_description", "best_match_source",
    )


@register(
    "final_era_summary",
    FINAL_SQL
    + f"""SELECT era AS "Era", count(*) AS "N items",
       round_even(avg(best_match_similarity), 3) AS "Mean best_match",
       round_even(median(best_match_similarity), 3) AS "Median best_match",
       round_even({_lt('best_match_similarity')} * 100, 1) AS "% with best_match < 0.5",
       round_even(avg(combined), 3) AS "Mean Combined",
       round_even(median(combined), 3) AS "Median Combined",
       round_even({_lt('combined')} * 100, 1) AS "% with Combined < 0.5",
       round_even(avg(embedding_similarity), 3) AS "Mean embedding",
       round_even(median(embedding_similarity), 3) AS "Median embedding"
FROM (SELECT *, {ERA_SQL.format(y='year_n')} AS era FROM final) WHERE era <> 'Unknown' GROUP BY era""",
)
def q_final_era_summary(spark, sf):
    """A8 on the final mapping."""
    return rp.era_summary(_final(spark, sf))
