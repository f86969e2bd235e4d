"""Registered queries: chaining (C1-C4), reconciliation (J11), coverage (A1-A3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from yearlink.operators.coverage import blank_by_year_top, coverage_by_year, dup_descriptions, unmapped_rows
from yearlink.operators.match import match_year_pair
from yearlink.plans.chain import ambiguous_nodes, chain_by_code, chain_by_description
from yearlink.plans.chain_update import changed_pairs, update_by_code, update_by_description
from yearlink.plans.queries_match import _match_nolcs_sql
from yearlink.plans.reconcile import reconcile
from yearlink.plans.registry import register, round_doubles
from yearlink.session import parquet_table
from yearlink.sources import fixtures as fx
from yearlink.sources.fixtures import with_views

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

# C2 as a recursive walk forward from every edge (the oracle form).
C2_CTE = f""",
  e AS (SELECT *, lower(trim(description_n, {_WS})) AS dn, lower(trim(description_n1, {_WS})) AS dn1
        FROM synthetic_edges),
  outx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY year_n, dn
                                      ORDER BY combined DESC NULLS LAST, row_id DESC) AS r
                          FROM e WHERE dn IS NOT NULL) WHERE r = 1),
  walk AS (
    SELECT row_id, year_n1 AS y, dn1 AS d, code_n1 AS ac, description_n1 AS ad, year_n1 = 2023 AS done, 1 AS hops
    FROM e
    UNION ALL
    SELECT w.row_id, o.year_n1, o.dn1, o.code_n1, o.description_n1, o.year_n1 = 2023, w.hops + 1
    FROM walk w JOIN outx o ON o.year_n = w.y AND o.dn = w.d WHERE NOT w.done),
  chained AS (SELECT e.row_id, e.year_n, e.year_n1, e.code_n, e.code_n1, e.combined,
                     e.description_n, e.description_n1,
                     w.ac AS mapped_2023_code, w.ad AS mapped_2023_description, w.hops
              FROM e LEFT JOIN (SELECT * FROM walk WHERE done) w USING (row_id))"""

C2_SQL = with_views("synthetic_edges", recursive=True) + C2_CTE

C1_SQL = with_views("synthetic_edges", recursive=True) + """,
  rows AS (SELECT row_id, year_n, code_n, year_n1, code_n1, description_n1 FROM synthetic_edges),
  ret AS (SELECT year_n1, code_n1, max(row_id) AS ret FROM rows WHERE code_n1 IS NOT NULL GROUP BY year_n1, code_n1),
  jump AS (SELECT r.row_id AS src, t.ret AS dst FROM rows r JOIN ret t ON r.year_n = t.year_n1 AND r.code_n = t.code_n1),
  reach AS (SELECT row_id AS seed, row_id AS r FROM rows WHERE year_n1 = 2023
            UNION ALL
            SELECT reach.seed, jump.dst FROM reach JOIN jump ON reach.r = jump.src),
  best AS (SELECT r, max(seed) AS seed FROM reach GROUP BY r)
SELECT x.row_id, x.year_n, x.year_n1, x.code_n, x.code_n1,
       s.code_n1 AS mapped_2023_code, s.description_n1 AS mapped_2023_description
FROM rows x LEFT JOIN best b ON b.r = x.row_id LEFT JOIN rows s ON s.row_id = b.seed"""

C_OUT = ["row_id", "year_n", "year_n1", "code_n", "code_n1", "mapped_2023_code", "mapped_2023_description"]


def _c2(spark, sf):
    return chain_by_description(fx.synthetic_edges(spark, sf))


@register(
    "chain_by_description",
    C2_SQL
    + "\nSELECT row_id, year_n, year_n1, code_n, code_n1, mapped_2023_code, mapped_2023_description, hops FROM chained",
)
def q_chain_by_description(spark, sf):
    """C2 (+ C4 hop count): description chain to 2023 by pointer doubling."""
    return _c2(spark, sf).select(*C_OUT, "hops")


@register("chain_by_code", C1_SQL)
def q_chain_by_code(spark, sf):
    """Code chain back from 2023 rows; last row per node; latest seed wins."""
    return chain_by_code(fx.synthetic_edges(spark, sf)).select(*C_OUT)


@register(
    "path",
    C2_SQL + "\nSELECT hops, count(*) AS n_rows FROM chained WHERE hops IS NOT NULL GROUP BY hops",
)
def q_path(spark, sf):
    """C4: distribution of path lengths (hops) to the anchor edition."""
    return _c2(spark, sf).filter(F.col("hops").isNotNull()).groupBy("hops").agg(F.count(F.lit(1)).alias("n_rows"))


@register(
    "chain_path",
    C2_SQL.replace(
        "year_n1 = 2023 AS done, 1 AS hops\n",
        "year_n1 = 2023 AS done, 1 AS hops, [year_n1] AS years, [coalesce(code_n1, '-')] AS codes, combined AS weakest\n",
    ).replace(
        "o.year_n1 = 2023, w.hops + 1\n",
        "o.year_n1 = 2023, w.hops + 1, list_append(w.years, o.year_n1), list_append(w.codes, coalesce(o.code_n1, '-')), "
        "least(w.weakest, o.combined)\n",
    ).replace("w.ad AS mapped_2023_description, w.hops\n", "w.ad AS mapped_2023_description, w.hops, w.years, w.codes, w.weakest\n")
    + """
SELECT row_id, year_n, CAST(hops AS INTEGER) AS hops, array_to_string(years, '>') AS years, array_to_string(codes, '>') AS codes, weakest
FROM chained WHERE hops IS NOT NULL""",
)
def q_chain_path(spark, sf):
    """C4: the path itself: editions and codes passed on the way to 2023, and
    the weakest score on it."""
    c = chain_by_description(fx.synthetic_edges(spark, sf), with_path=True).filter(F.col("hops").isNotNull())
    return c.select(
        "row_id",
        "year_n",
        "hops",
        F.array_join(F.transform("path", lambda h: h["year"].cast("string")), ">").alias("years"),
        F.array_join(F.transform("path", lambda h: F.coalesce(h["code"], F.lit("-"))), ">").alias("codes"),
        F.array_min(F.transform("path", lambda h: h["score"])).alias("weakest"),
    )


def _before_an_edition(spark, sf):
    """Edges of all items, and those made before the middle edition arrived:
    the edition before it then led straight to the one after it."""
    it = parquet_table(fx.items(spark, sf), "items")
    now = parquet_table(fx.synthetic_edges(spark, sf, it), "edges")
    middle = it.select(F.percentile_approx(F.col("year"), 0.5).alias("y"))
    older = it.join(F.broadcast(middle), it["year"] == middle["y"], "left_anti")  # one row
    return now, parquet_table(fx.synthetic_edges(spark, sf, older), "edges-before")


@register(
    "chain_update_by_description",
    C2_SQL
    + "\nSELECT row_id, year_n, year_n1, code_n, code_n1, mapped_2023_code, mapped_2023_description, hops FROM chained",
)
def q_chain_update_by_description(spark, sf):
    """S10 over C2: the chain brought up to date after an edition came in
    between; equal to the full run."""
    now, before = _before_an_edition(spark, sf)
    previous = parquet_table(chain_by_description(before), "chained-before")
    return update_by_description(now, previous, changed_pairs(before, now)).select(*C_OUT, "hops")


@register("chain_update_by_code", C1_SQL)
def q_chain_update_by_code(spark, sf):
    """S10 over C1: the same for the code chain."""
    now, before = _before_an_edition(spark, sf)
    previous = parquet_table(chain_by_code(before, with_seed=True), "chained-before")
    return update_by_code(now, previous, changed_pairs(before, now)).select(*C_OUT)


@register(
    "unmapped_rows",
    C2_SQL + "\nSELECT count(*) AS n_rows, count(*) FILTER (WHERE mapped_2023_code IS NULL) AS n_unmapped FROM chained",
)
def q_unmapped_rows(spark, sf):
    """Rows without a 2023 target."""
    return unmapped_rows(_c2(spark, sf))


@register(
    "coverage_by_year",
    C2_SQL + "\nSELECT year_n, count(*) AS n_rows, count(mapped_2023_code) AS n_mapped FROM chained GROUP BY year_n",
)
def q_coverage_by_year(spark, sf):
    """A1: rows and mapped rows per year."""
    return coverage_by_year(_c2(spark, sf))


@register(
    "blank_by_year_top",
    C2_SQL
    + """
SELECT year_n, count(*) AS n_blank FROM chained WHERE mapped_2023_code IS NULL
GROUP BY year_n ORDER BY n_blank DESC, year_n LIMIT 10""",
)
def q_blank_by_year_top(spark, sf):
    """A2: top 10 years by unmapped rows."""
    return blank_by_year_top(_c2(spark, sf))


@register(
    "dup_descriptions",
    with_views("items")
    + f"""
SELECT year, count(*) AS n_dup_groups FROM
  (SELECT year, lower(trim(description, {_WS})) AS d, count(*) AS c FROM items GROUP BY year, d HAVING count(*) > 1)
GROUP BY year ORDER BY year LIMIT 15""",
)
def q_dup_descriptions(spark, sf):
    """A3: repeated (year, description) groups per year, first 15 years."""
    return dup_descriptions(fx.items(spark, sf), "year", "description")


@register(
    "ambiguous_nodes",
    with_views("synthetic_edges")
    + f"""
SELECT count(*) AS n_nodes FROM
  (SELECT year_n, lower(trim(description_n, {_WS})) AS dn
   FROM synthetic_edges WHERE description_n IS NOT NULL
   GROUP BY year_n, dn HAVING count(DISTINCT lower(trim(description_n1, {_WS}))) > 1)""",
)
def q_ambiguous_nodes(spark, sf):
    """C2 note: number of description nodes with conflicting out-edges."""
    return ambiguous_nodes(fx.synthetic_edges(spark, sf)).agg(F.count(F.lit(1)).alias("n_nodes"))


_REC_SQL = f"""
WITH fwd AS (SELECT * FROM ({_match_nolcs_sql("n_to_n1")})),
     rev AS (SELECT * FROM ({_match_nolcs_sql("n1_to_n")})),
     links AS (SELECT year_n, item_id_n, year_n1, item_id_n1, combined, 1 AS f, 0 AS r FROM fwd
               UNION ALL
               SELECT year_n, item_id_n, year_n1, item_id_n1, combined, 0 AS f, 1 AS r FROM rev),
     pl AS (SELECT year_n, item_id_n, year_n1, item_id_n1, max(f) AS f, max(r) AS r, max(combined) AS score
            FROM links GROUP BY year_n, item_id_n, year_n1, item_id_n1),
     rk AS (SELECT *, (f = 1 AND r = 1) AS mutual,
                   count(*) OVER (PARTITION BY year_n, item_id_n) AS n_targets,
                   row_number() OVER (PARTITION BY year_n, item_id_n
                                      ORDER BY (f = 1 AND r = 1) DESC, score DESC, f DESC, item_id_n1) AS k
            FROM pl)
SELECT year_n, item_id_n, year_n1, item_id_n1,
       CASE WHEN mutual THEN 'mutual' WHEN n_targets > 1 THEN 'conflict' ELSE 'one_way' END AS status,
       n_targets > 1 AS conflict, score,
       CASE WHEN mutual THEN 'both' WHEN f = 1 THEN 'forward' ELSE 'reverse' END AS source
FROM rk WHERE k = 1"""


@register("reconcile", _REC_SQL)
def q_reconcile(spark, sf):
    """Two-way reconciliation of forward and reverse matches (gamma = 0)."""
    it = parquet_table(fx.items(spark, sf), "items")  # shared by both directions
    fwd = match_year_pair(it, direction="n_to_n1", gamma=0.0, with_indel=False)
    rev = match_year_pair(it, direction="n1_to_n", gamma=0.0, with_indel=False)
    return reconcile(fwd, rev)


@register(
    "reconcile_summary",
    _REC_SQL.replace(
        "SELECT year_n, item_id_n, year_n1, item_id_n1,\n       CASE WHEN mutual",
        "SELECT status, count(*) AS n_items, round(avg(score), 6) AS mean_score FROM (\nSELECT year_n, item_id_n, year_n1, item_id_n1,\n       CASE WHEN mutual",
    )
    + ") GROUP BY status",
)
def q_reconcile_summary(spark, sf):
    """J11 summary: items and mean score per status."""
    r = q_reconcile(spark, sf)
    return round_doubles(
        r.groupBy("status").agg(F.count(F.lit(1)).alias("n_items"), F.avg("score").alias("mean_score"))
    )
