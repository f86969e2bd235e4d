"""Registered queries: matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from yearlink.functions import text as tx
from yearlink.functions.indel import indel
from yearlink.functions.indel_expr import indel_expr
from yearlink.functions.vectors import cosine, top_k_by
from yearlink.operators.match import adjacent_pairs, candidate_cosines, match_year_pair, prepare_items
from yearlink.plans.registry import register, round_doubles
from yearlink.session import parquet_table
from yearlink.sources import fixtures as fx
from yearlink.sources.fixtures import with_views

EDGE_OUT = [
    "row_id", "year_n", "year_n1", "item_id_n", "item_id_n1", "code_n", "code_n1",
    "description_n", "description_n1", "cosine", "jaccard", "levenshtein", "combined",
]

# ---- SQL building blocks (DuckDB) -------------------------------------------
TOKENS_SQL = "list_distinct(list_filter(string_split_regex(lower({x}), '\\s+'), lambda t: t <> ''))"
NORM_SQL = "sqrt(list_dot_product(CAST({v} AS DOUBLE[]), CAST({v} AS DOUBLE[])))"
JAC_SQL = (
    "CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 "
    "ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"
)
COS_SQL = (
    "COALESCE(round(CASE WHEN {na} * {nb} > 0 THEN "
    "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / ({na} * {nb}) END, 9), 0.0)"
)

PREP_SQL = f"""
  p AS (SELECT item_id, year, code, description, embedding,
               {TOKENS_SQL.format(x='description')} AS tokens,
               {NORM_SQL.format(v='embedding')} AS norm
        FROM items WHERE description IS NOT NULL),
  pairs AS (SELECT year_n, year_n1 FROM
              (SELECT year AS year_n, lead(year) OVER (ORDER BY year) AS year_n1
               FROM (SELECT DISTINCT year FROM p)) WHERE year_n1 IS NOT NULL)"""


def _cand_sql(qy: str, cy: str) -> str:
    return f"""
  cand AS (SELECT q.item_id AS q_id, c.item_id AS c_id, q.year AS q_year, c.year AS c_year,
                  q.code AS q_code, c.code AS c_code, q.description AS q_desc, c.description AS c_desc,
                  q.tokens AS q_tok, c.tokens AS c_tok,
                  {COS_SQL.format(a='q.embedding', b='c.embedding', na='q.norm', nb='c.norm')} AS cos
           FROM pairs JOIN p q ON q.year = pairs.{qy} JOIN p c ON c.year = pairs.{cy})"""


def _match_nolcs_sql(direction: str, top_k: int = 500) -> str:
    qy, cy = ("year_n1", "year_n") if direction == "n1_to_n" else ("year_n", "year_n1")
    n, n1 = ("c", "q") if direction == "n1_to_n" else ("q", "c")
    return (
        with_views("items")
        + ","
        + PREP_SQL
        + ","
        + _cand_sql(qy, cy)
        + f""",
  top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY cos DESC, c_id) AS rk FROM cand)
          WHERE rk <= {top_k}),
  sc AS (SELECT *, {JAC_SQL.format(a='q_tok', b='c_tok')} AS jac FROM top),
  sc2 AS (SELECT *, 0.7 * cos + 0.2 * jac + 0.0 * 0.0 AS comb FROM sc),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY comb DESC, cos DESC, c_id) AS rk2
                          FROM sc2) WHERE rk2 = 1)
SELECT q_id AS row_id, {n}_year AS year_n, {n1}_year AS year_n1, {n}_id AS item_id_n, {n1}_id AS item_id_n1,
       {n}_code AS code_n, {n1}_code AS code_n1, {n}_desc AS description_n, {n1}_desc AS description_n1,
       cos AS cosine, jac AS jaccard, CAST(NULL AS DOUBLE) AS levenshtein, comb AS combined
FROM best"""
    )


@register("match_year_pair")
def q_match_year_pair(spark, sf):
    """J3 flagship: reverse direction, alpha/beta/gamma = .7/.2/.1, top 500."""
    return (match_year_pair(fx.items(spark, sf)).select(*EDGE_OUT))


@register("match_year_pair_nolcs", _match_nolcs_sql("n1_to_n"))
def q_match_nolcs(spark, sf):
    """J3 with gamma = 0 (Indel not computed): full SQL oracle."""
    return (match_year_pair(fx.items(spark, sf), gamma=0.0, with_indel=False).select(*EDGE_OUT))


@register("match_forward_nolcs", _match_nolcs_sql("n_to_n1"))
def q_match_forward_nolcs(spark, sf):
    """J3b forward direction (query = year N, candidates = next year)."""
    return (
        match_year_pair(fx.items(spark, sf), direction="n_to_n1", gamma=0.0, with_indel=False).select(*EDGE_OUT)
    )


@register("match_forward")
def q_match_forward(spark, sf):
    """J3b forward direction with the Indel term."""
    return (match_year_pair(fx.items(spark, sf), direction="n_to_n1").select(*EDGE_OUT))


@register("match_uniq_key")
def q_match_uniq_key(spark, sf):
    """Forward, item key = F10 unique key, Indel without the empty guard."""
    return (
        match_year_pair(fx.items(spark, sf), direction="n_to_n1", key="uniq_key", guard=False).select(*EDGE_OUT)
    )


@register("match_top1_nolcs", _match_nolcs_sql("n1_to_n", top_k=1))
def q_match_top1(spark, sf):
    """J3 with top_k = 1: the cosine winner only (differs from top 500)."""
    return (
        match_year_pair(fx.items(spark, sf), gamma=0.0, with_indel=False, top_k=1).select(*EDGE_OUT)
    )


@register(
    "adjacent_pairs",
    with_views("items")
    + """SELECT year_n, year_n1 FROM (SELECT year AS year_n, lead(year) OVER (ORDER BY year) AS year_n1
         FROM (SELECT DISTINCT year FROM items WHERE description IS NOT NULL)) WHERE year_n1 IS NOT NULL""",
)
def q_adjacent_pairs(spark, sf):
    """Next available year for each year."""
    return adjacent_pairs(fx.items(spark, sf))


@register(
    "candidates",
    with_views("items")
    + ","
    + PREP_SQL
    + """
SELECT pairs.year_n, pairs.year_n1, count(*) AS n_pairs
FROM pairs JOIN p q ON q.year = pairs.year_n1 JOIN p c ON c.year = pairs.year_n
GROUP BY pairs.year_n, pairs.year_n1""",
)
def q_candidates(spark, sf):
    """Candidate pairs per year pair.  Counted from per-year sizes (no
    pair is materialised to count them)."""
    p = prepare_items(fx.items(spark, sf))
    # one aggregate feeds both the pair list and the sizes (one scan, the
    # identical exchanges below are reused)
    sizes = p.groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    pairs = adjacent_pairs(sizes)
    return (
        pairs.join(sizes.select(F.col("year").alias("year_n"), F.col("n").alias("a")), "year_n")
        .join(sizes.select(F.col("year").alias("year_n1"), F.col("n").alias("b")), "year_n1")
        .select("year_n", "year_n1", (F.col("a") * F.col("b")).alias("n_pairs"))
    )


@register(
    "topk_cosine",
    with_views("items")
    + ","
    + PREP_SQL
    + ","
    + _cand_sql("year_n1", "year_n")
    + """
SELECT q_id, c_id, cos, CAST(rk AS INTEGER) AS rk FROM
  (SELECT q_id, c_id, cos, row_number() OVER (PARTITION BY q_id ORDER BY cos DESC, c_id) AS rk FROM cand)
WHERE rk <= 5""",
)
def q_topk_cosine(spark, sf):
    """5 best candidates per query by cosine (block path)."""
    p = prepare_items(fx.items(spark, sf))
    c = candidate_cosines(p, adjacent_pairs(p), "n1_to_n", top_k=5)
    return top_k_by(c, ["q_id"], [F.desc("cos"), F.asc("c_id")], 5)


@register(
    "topk_cosine_expr",
    with_views("items")
    + ","
    + PREP_SQL
    + ","
    + _cand_sql("year_n1", "year_n")
    + """
SELECT q_id, c_id, cos, CAST(rk AS INTEGER) AS rk FROM
  (SELECT q_id, c_id, cos, row_number() OVER (PARTITION BY q_id ORDER BY cos DESC, c_id) AS rk FROM cand)
WHERE rk <= 5""",
)
def q_topk_cosine_expr(spark, sf):
    """T2 on the expression path (cosines by Catalyst, no Python worker)."""
    # read by the pair list and both sides, twice each: written once
    p = parquet_table(prepare_items(fx.items(spark, sf)).select("item_id", "year", "embedding", "norm"), "topk-items")
    c = candidate_cosines(p, adjacent_pairs(p), "n1_to_n", top_k=5, method="expr")
    return top_k_by(c, ["q_id"], [F.desc("cos"), F.asc("c_id")], 5)


@register(
    "tokens_jaccard",
    with_views("word_pairs")
    + f"""SELECT pair_id, len({TOKENS_SQL.format(x='a')}) AS n_tokens_a,
       round({JAC_SQL.format(a=TOKENS_SQL.format(x='a'), b=TOKENS_SQL.format(x='b'))}, 6) AS jaccard
FROM word_pairs""",
)
def q_tokens_jaccard(spark, sf):
    """F2 + F3 on word pairs."""
    w = fx.word_pairs(spark, sf)
    return round_doubles(
        w.select(
            "pair_id",
            F.size(tx.tokens("a")).cast("long").alias("n_tokens_a"),
            tx.jaccard(tx.tokens("a"), tx.tokens("b")).alias("jaccard"),
        )
    )


@register(
    "cosine_vectors",
    """SELECT a.vec_id AS id_a, b.vec_id AS id_b,
       round(COALESCE(round(CASE WHEN sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])))
                    * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) > 0
                THEN list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))
                     / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])))
                        * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))
                END, 9), 0.0), 6) AS cos
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def q_cosine_vectors(spark, sf):
    """cosine of each vector with the next one (linear equi-join)."""
    v = fx.vec(spark, sf)
    nxt = v.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("e2"), F.col("id").alias("id_b"))
    return round_doubles(
        v.join(nxt, "id").select(F.col("id").alias("id_a"), "id_b", cosine("embedding", "e2").alias("cos"))
    )


# Indel via LCS in DuckDB: recursive CTE over the characters of a, one DP
# row (a list over b's positions) per step.
INDEL_PAIRS_SQL = (
    with_views("word_pairs", recursive=True)
    + """,
  w AS (SELECT pair_id, lower(trim(a)) AS a, lower(trim(b)) AS b FROM word_pairs),
  dp AS (
    SELECT pair_id, a, b, 0 AS i, list_transform(range(length(b) + 1), lambda j: 0) AS row FROM w
    UNION ALL
    SELECT pair_id, a, b, i + 1,
           list_reduce(
             list_transform(range(1, length(b) + 1), lambda j: j),
             lambda acc, j: list_append(acc,
                 CASE WHEN substr(a, i + 1, 1) = substr(b, j, 1) THEN row[j] + 1
                      ELSE greatest(row[j + 1], acc[j]) END),
             [0])
    FROM dp WHERE i < length(a))
SELECT pair_id,
       round(CASE WHEN a IS NULL OR b IS NULL OR length(a) + length(b) = 0 THEN 1.0
                  ELSE 2.0 * row[length(b) + 1] / (length(a) + length(b)) END, 6) AS indel
FROM dp WHERE i = length(a)"""
)


@register("indel_ratio", INDEL_PAIRS_SQL)
def q_indel_ratio(spark, sf):
    """Normalised Indel similarity of word pairs (Arrow UDF)."""
    w = fx.word_pairs(spark, sf)
    return round_doubles(w.select("pair_id", indel("a", "b", strip=True, guard=True).alias("indel")))


@register("indel_ratio_expr", INDEL_PAIRS_SQL)
def q_indel_ratio_expr(spark, sf):
    """F4 in Catalyst: the same ratios without a Python worker."""
    w = fx.word_pairs(spark, sf)
    return round_doubles(w.select("pair_id", indel_expr("a", "b", strip=True, guard=True).alias("indel")))


@register(
    "combined_score",
    with_views("word_pairs")
    + f""",
  s AS (SELECT pair_id, {JAC_SQL.format(a=TOKENS_SQL.format(x='a'), b=TOKENS_SQL.format(x='b'))} AS jac FROM word_pairs)
SELECT pair_id, round(0.7 * 0.5 + 0.2 * jac + 0.1 * jac, 6) AS combined FROM s""",
)
def q_combined_score(spark, sf):
    """F8: weighted blend (cosine fixed at 0.5, Jaccard used for both other
    terms so the SQL side needs no LCS)."""
    w = fx.word_pairs(spark, sf)
    jac = tx.jaccard(tx.tokens("a"), tx.tokens("b"))
    return round_doubles(w.select("pair_id", tx.combined(F.lit(0.5), jac, jac).alias("combined")))


# ---- flagship oracle: exact pruning + recursive-CTE LCS on the survivors ----
_WS_CHARS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _strip_lower(x: str) -> str:
    return f"lower(trim({x}, {_WS_CHARS}))"


UNIQ_KEY_SQL = (
    "CASE WHEN code IS NOT NULL AND trim(code, {ws}) <> '' THEN trim(code, {ws}) "
    "ELSE CAST(year AS VARCHAR) || '_' || CAST(item_id AS VARCHAR) || '_' || "
    "replace(trim(substr(regexp_replace(lower(description), '[^\\p{{L}}\\p{{N}} ]', '', 'g'), 1, 40), {ws}), ' ', '_') END"
)


def _match_full_sql(direction: str, top_k: int = 500, key: str = "code") -> str:
    qy, cy = ("year_n1", "year_n") if direction == "n1_to_n" else ("year_n", "year_n1")
    n, n1 = ("c", "q") if direction == "n1_to_n" else ("q", "c")
    prep = PREP_SQL
    if key == "uniq_key":
        prep = prep.replace(
            "p AS (SELECT item_id, year, code,", "p AS (SELECT item_id, year, " + UNIQ_KEY_SQL.format(ws=_WS_CHARS) + " AS code,"
        )
    return (
        with_views("items", recursive=True)
        + ","
        + prep
        + ","
        + _cand_sql(qy, cy)
        + f""",
  top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY cos DESC, c_id) AS rk FROM cand)
          WHERE rk <= {top_k}),
  sc AS (SELECT *, {JAC_SQL.format(a='q_tok', b='c_tok')} AS jac,
                {_strip_lower('q_desc')} AS qa, {_strip_lower('c_desc')} AS cb FROM top),
  sc1 AS (SELECT *, 0.7 * cos + 0.2 * jac AS base,
                 CASE WHEN length(qa) + length(cb) = 0 THEN 1.0
                      ELSE least(length(qa), length(cb)) * 2.0 / (length(qa) + length(cb)) END AS ub FROM sc),
  kept AS (SELECT * FROM (SELECT *, max(base) OVER (PARTITION BY q_id) AS best_base FROM sc1)
           WHERE base + 0.1 * ub >= best_base - 1e-12),
  dp AS (
    SELECT q_id, c_id, qa AS a, cb AS b, 0 AS i, list_transform(range(length(cb) + 1), lambda j: 0) AS row FROM kept
    UNION ALL
    SELECT q_id, c_id, a, b, i + 1,
           list_reduce(list_transform(range(1, length(b) + 1), lambda j: j),
             lambda acc, j: list_append(acc,
                 CASE WHEN substr(a, i + 1, 1) = substr(b, j, 1) THEN row[j] + 1
                      ELSE greatest(row[j + 1], acc[j]) END),
             [0])
    FROM dp WHERE i < length(a)),
  lcs AS (SELECT q_id, c_id, row[length(b) + 1] AS l FROM dp WHERE i = length(a)),
  sc2 AS (SELECT k.*, CASE WHEN k.q_desc = '' OR k.c_desc = '' THEN 0.0
                           WHEN length(k.qa) + length(k.cb) = 0 THEN 1.0
                           ELSE 2.0 * lcs.l / (length(k.qa) + length(k.cb)) END AS lev
          FROM kept k JOIN lcs USING (q_id, c_id)),
  sc3 AS (SELECT *, base + 0.1 * lev AS comb FROM sc2),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY comb DESC, cos DESC, c_id) AS rk2
                          FROM sc3) WHERE rk2 = 1)
SELECT q_id AS row_id, {n}_year AS year_n, {n1}_year AS year_n1, {n}_id AS item_id_n, {n1}_id AS item_id_n1,
       {n}_code AS code_n, {n1}_code AS code_n1, {n}_desc AS description_n, {n1}_desc AS description_n1,
       cos AS cosine, jac AS jaccard, lev AS levenshtein, comb AS combined
FROM best"""
    )


from yearlink.plans.registry import ORACLE as _ORACLE  # noqa: E402

# guard=False only differs from the guarded form on empty descriptions (none here)
