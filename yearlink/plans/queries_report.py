"""Registered queries: reports (A4-A10, A13-A19, W1, W2, P3, P8, P10, P11,
J7, F11-F15 on code tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from yearlink.functions import text as tx
from yearlink.operators import report as rp
from yearlink.plans.registry import register, round_doubles
from yearlink.sources import fixtures as fx
from yearlink.sources.fixtures import with_views

ERA_SQL = " ".join(
    ["CASE"] + [f"WHEN {{y}} BETWEEN {lo} AND {hi} THEN '{n}'" for n, lo, hi in rp.ERAS] + ["ELSE 'Unknown' END"]
)
CAT_SQL = (
    "CASE WHEN coalesce({s} < 0.4, false) THEN 'Census Website' "
    "WHEN {src} IN ('HS6', 'HS4', 'HS2') THEN 'Detailed HS' ELSE 'Direct mapping' END"
)
M = with_views("mapping")


def _m(spark, sf):
    return fx.mapping(spark, sf)


@register("mean_by_year", M + "SELECT year_n, round(avg(combined), 6) AS mean_combined FROM mapping GROUP BY year_n")
def q_mean_by_year(spark, sf):
    """A4: mean combined score per year."""
    return round_doubles(rp.mean_by_year(_m(spark, sf)))


@register(
    "yoy_drop",
    M
    + """SELECT year_n, round(mean, 6) AS mean, round(prev, 6) AS prev, round(prev - mean, 6) AS drop FROM
  (SELECT year_n, mean, lag(mean) OVER (ORDER BY year_n) AS prev FROM
     (SELECT year_n, avg(best_match_similarity) AS mean FROM mapping GROUP BY year_n))""",
)
def q_yoy_drop(spark, sf):
    """Year-on-year drop of the mean best similarity."""
    return round_doubles(rp.yoy_drop(_m(spark, sf)))


@register(
    "major_dips",
    M
    + """SELECT year_n, round(mean, 6) AS mean, round(prev, 6) AS prev, round(prev - mean, 6) AS drop FROM
  (SELECT year_n, mean, lag(mean) OVER (ORDER BY year_n) AS prev FROM
     (SELECT year_n, avg(best_match_similarity) AS mean FROM mapping GROUP BY year_n))
WHERE prev - mean > 0.02""",
)
def q_major_dips(spark, sf):
    """Years whose mean dropped by more than 0.02 (0.1 gives no row here)."""
    return round_doubles(rp.major_dips(_m(spark, sf), t=0.02))


@register(
    "filter_year",
    M + "SELECT year_n, count(*) AS n FROM mapping WHERE year_n BETWEEN 1930 AND 1962 GROUP BY year_n",
)
def q_filter_year(spark, sf):
    """Rows of an inclusive year range."""
    return rp.filter_year(_m(spark, sf), 1930, 1962).groupBy("year_n").agg(F.count(F.lit(1)).alias("n"))


@register(
    "low_similarity_share",
    M
    + """SELECT count(*) FILTER (WHERE combined < 0.5) AS n_low,
       round(avg(CASE WHEN coalesce(combined < 0.5, false) THEN 1.0 ELSE 0.0 END), 6) AS share_low FROM mapping""",
)
def q_low_similarity_share(spark, sf):
    """Share of rows with combined < 0.5."""
    return round_doubles(rp.low_similarity_share(_m(spark, sf), "combined"))


@register(
    "low_similarity_rows",
    M + "SELECT row_id, line, combined FROM mapping WHERE combined < 0.5",
)
def q_low_similarity_rows(spark, sf):
    """The rows with combined < 0.5, highest first."""
    return rp.low_similarity_rows(_m(spark, sf), "combined").select("row_id", "line", "combined")


@register(
    "source_category",
    M + f"SELECT {CAT_SQL.format(s='best_match_similarity', src='best_match_source')} AS category, count(*) AS n "
    "FROM mapping GROUP BY category",
)
def q_source_category(spark, sf):
    """P10: rows per source category (precedence: < 0.4 first)."""
    return _m(spark, sf).groupBy(rp.source_category().alias("category")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "era_label",
    M + f"SELECT {ERA_SQL.format(y='year_n')} AS era, count(*) AS n FROM mapping GROUP BY era",
)
def q_era_label(spark, sf):
    """Rows per era."""
    return _m(spark, sf).groupBy(rp.era_label("year_n").alias("era")).agg(F.count(F.lit(1)).alias("n"))


def _lt(x):
    return f"avg(CASE WHEN coalesce({x} < 0.5, false) THEN 1.0 ELSE 0.0 END)"


@register(
    "era_summary",
    M
    + f"""SELECT era AS "Era", count(*) AS "N items",
       round_even(avg(best_match_similarity), 3) AS "Mean best_match",
       round_even(median(best_match_similarity), 3) AS "Median best_match",
       round_even({_lt('best_match_similarity')} * 100, 1) AS "% with best_match < 0.5",
       round_even(avg(combined), 3) AS "Mean Combined",
       round_even(median(combined), 3) AS "Median Combined",
       round_even({_lt('combined')} * 100, 1) AS "% with Combined < 0.5",
       round_even(avg(embedding_similarity), 3) AS "Mean embedding",
       round_even(median(embedding_similarity), 3) AS "Median embedding"
FROM (SELECT *, {ERA_SQL.format(y='year_n')} AS era FROM mapping) WHERE era <> 'Unknown' GROUP BY era""",
)
def q_era_summary(spark, sf):
    """Per-era summary (the reference's era table format)."""
    return rp.era_summary(_m(spark, sf))


@register(
    "milestone_table",
    M
    + f"""SELECT y.Year AS "Year", coalesce(a.n, 0) AS "Count of Tariff Items",
       round_even(a.m, 3) AS "Mean 2023 Similarity", round_even(a.s, 3) AS "Std. Dev."
FROM (VALUES {", ".join(f"({y})" for y in rp.MILESTONE_YEARS)}) y(Year)
LEFT JOIN (SELECT year_n, count(*) AS n, avg(best_match_similarity) AS m, stddev_samp(best_match_similarity) AS s
           FROM mapping GROUP BY year_n) a ON a.year_n = y.Year""",
)
def q_milestone_table(spark, sf):
    """Count / mean / std at the fixed milestone years."""
    return rp.milestone_table(_m(spark, sf), spark)


_CATS = rp.SOURCE_CATEGORIES


@register(
    "source_crosstab",
    M
    + f""",
  d AS (SELECT {ERA_SQL.format(y='year_n')} AS era,
               {CAT_SQL.format(s='best_match_similarity', src='best_match_source')} AS cat FROM mapping),
  c AS (SELECT era, {", ".join(f"count(*) FILTER (WHERE cat = '{c}') AS c{i}" for i, c in enumerate(_CATS))},
               count(*) AS t FROM d GROUP BY era),
  p AS (SELECT {", ".join(f"max(CASE WHEN cat = '{c}' THEN 1 ELSE 0 END) AS p{i}" for i, c in enumerate(_CATS))} FROM d),
  eras AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {i})" for i, (n, _, _) in enumerate(rp.ERAS))}) v(era, o))
SELECT eras.era,
       {", ".join(f'round(CASE WHEN p.p{i} = 1 THEN CASE WHEN c.t > 0 THEN coalesce(c.c{i}, 0) * 100.0 / c.t END END, 6) AS "{c}"' for i, c in enumerate(_CATS))}
FROM eras LEFT JOIN c ON c.era = eras.era CROSS JOIN p""",
)
def q_source_crosstab(spark, sf):
    """A10: era x source category, row-normalised to 100."""
    return round_doubles(rp.source_crosstab(_m(spark, sf), spark))


@register(
    "similarity_histogram",
    M
    + """, s AS (SELECT min(best_match_similarity) AS lo, max(best_match_similarity) AS hi FROM mapping)
SELECT CAST(CASE WHEN hi > lo THEN least(floor((best_match_similarity - lo) / (hi - lo) * 50) + 1, 50) ELSE 1 END
            AS INTEGER) AS bin, count(*) AS n
FROM mapping CROSS JOIN s WHERE best_match_similarity IS NOT NULL GROUP BY bin""",
)
def q_similarity_histogram(spark, sf):
    """50 equal-width bins between min and max."""
    return rp.similarity_histogram(_m(spark, sf), "best_match_similarity", 50)


@register(
    "year_means_selected",
    M
    + """SELECT year_n, round(avg(best_match_similarity), 6) AS mean_similarity FROM mapping
WHERE year_n IN (1789, 1963, 1989) GROUP BY year_n""",
)
def q_year_means_selected(spark, sf):
    """Mean best similarity at 1789, 1963, 1989."""
    return round_doubles(rp.year_means_selected(_m(spark, sf)))


# --------------------------------------------------------------- codes
CLEAN_SQL = (
    with_views("raw_codes")
    + """, c1 AS (SELECT row_id, year, code,
                CASE WHEN length(code) > 8 AND code LIKE '%.0' THEN substr(code, 1, length(code) - 2) ELSE code END AS nf
         FROM raw_codes),
  cleaned AS (SELECT row_id, year,
                     CASE WHEN year >= 1989 THEN (CASE WHEN length(nf) = 7 THEN '0' || nf ELSE nf END) ELSE code END AS code
              FROM c1 WHERE NOT (year >= 1989 AND coalesce(length(nf), 0) >= 10))
"""
)


@register("clean_code", CLEAN_SQL + "SELECT row_id, year, code FROM cleaned")
def q_clean_code(spark, sf):
    """float-damaged codes cleaned from 1989 on; 10+ char codes dropped."""
    return rp.clean_codes(fx.raw_codes(spark, sf), "code", "year").select("row_id", "year", "code")


@register(
    "code_length_counts",
    CLEAN_SQL + "SELECT CAST(length(code) AS INTEGER) AS code_length, count(*) AS n FROM cleaned WHERE year >= 1989 GROUP BY code_length",
)
def q_code_length_counts(spark, sf):
    """A5 + F14: code-length histogram after cleaning, years >= 1989."""
    c = rp.clean_codes(fx.raw_codes(spark, sf), "code", "year")
    return rp.code_length_counts(c).select(F.col("code_length"), F.col("n"))


@register(
    "code_functions",
    CLEAN_SQL
    + """SELECT row_id, CASE WHEN length(code) >= 2 THEN substr(code, 1, 2) END AS prefix2,
       CASE WHEN length(CAST(row_id % 100 AS VARCHAR)) = 1 THEN '0' || CAST(row_id % 100 AS VARCHAR)
            ELSE CAST(row_id % 100 AS VARCHAR) END AS pad2,
       CAST(length(code) AS INTEGER) AS code_length
FROM cleaned""",
)
def q_code_functions(spark, sf):
    """F12 prefix2, F13 pad2, F14 code_length on cleaned codes."""
    c = rp.clean_codes(fx.raw_codes(spark, sf), "code", "year")
    return c.select(
        "row_id",
        tx.prefix2("code").alias("prefix2"),
        tx.pad2((F.col("row_id") % 100).cast("string")).alias("pad2"),
        tx.code_length("code").alias("code_length"),
    )


@register(
    "round_report",
    M
    + """SELECT year_n, round_even(avg(best_match_similarity), 3) AS mean3, round_even(avg(combined) * 100, 1) AS pct1
FROM mapping GROUP BY year_n""",
)
def q_round_report(spark, sf):
    """half-even rounding at 3 and 1 decimals."""
    m = _m(spark, sf).groupBy("year_n").agg(F.avg("best_match_similarity").alias("a"), F.avg("combined").alias("b"))
    return m.select("year_n", tx.round_report("a", 3).alias("mean3"), tx.round_report(F.col("b") * 100, 1).alias("pct1"))


@register(
    "slug_uniq_key",
    with_views("items")
    + r"""SELECT item_id,
       replace(trim(substr(regexp_replace(lower(description), '[^\p{L}\p{N} ]', '', 'g'), 1, 40), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), ' ', '_') AS slug,
       CASE WHEN code IS NOT NULL AND trim(code) <> '' THEN trim(code)
            ELSE CAST(year AS VARCHAR) || '_' || CAST(item_id AS VARCHAR) || '_' ||
                 replace(trim(substr(regexp_replace(lower(description), '[^\p{L}\p{N} ]', '', 'g'), 1, 40), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), ' ', '_')
       END AS uniq_key
FROM items""",
)
def q_slug_uniq_key(spark, sf):
    """F9 slug and F10 unique key."""
    it = fx.items(spark, sf)
    return it.select(
        "item_id",
        tx.slug("description").alias("slug"),
        tx.uniq_key("year", "item_id", "code", "description").alias("uniq_key"),
    )


# ---------------------------------------------------------- predictions
PT = with_views("pred_truth")
PC_SQL = (
    PT
    + """, v AS (SELECT * FROM pred_truth WHERE y_true IS NOT NULL AND y_pred IS NOT NULL),
  t AS (SELECT y_true AS label, count(*) AS support, count(*) FILTER (WHERE y_true = y_pred) AS tp FROM v GROUP BY y_true),
  p AS (SELECT y_pred AS label, count(*) AS n_pred FROM v GROUP BY y_pred),
  j AS (SELECT coalesce(t.label, p.label) AS label, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp,
               coalesce(n_pred, 0) AS n_pred FROM t FULL OUTER JOIN p ON t.label = p.label),
  pc0 AS (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
                   CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM j),
  pc AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
         FROM pc0)
"""
)


@register(
    "confusion_matrix",
    PT
    + """, v AS (SELECT * FROM pred_truth WHERE y_true IS NOT NULL AND y_pred IS NOT NULL),
  l AS (SELECT y_true AS label FROM v UNION SELECT y_pred FROM v)
SELECT a.label AS y_true, b.label AS y_pred, count(v.y_true) AS n
FROM l a CROSS JOIN l b LEFT JOIN v ON v.y_true = a.label AND v.y_pred = b.label GROUP BY a.label, b.label""",
)
def q_confusion_matrix(spark, sf):
    """The confusion matrix over the union of labels, zero cells too."""
    return rp.confusion_matrix(fx.pred_truth(spark, sf))


@register(
    "classification_report",
    PC_SQL
    + """SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM pc
UNION ALL
SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM pc
UNION ALL
SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
       round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM pc""",
)
def q_classification_report(spark, sf):
    """Per-class precision/recall/F1/support with macro and weighted averages."""
    return round_doubles(rp.classification_report(fx.pred_truth(spark, sf)))


@register(
    "weighted_prf",
    PC_SQL
    + """SELECT round(sum(precision * support) / sum(support), 6) AS precision,
       round(sum(recall * support) / sum(support), 6) AS recall,
       round(sum(f1 * support) / sum(support), 6) AS f1, CAST(sum(support) AS BIGINT) AS support FROM pc""",
)
def q_weighted_prf(spark, sf):
    """Weighted precision, recall, F1."""
    return round_doubles(rp.weighted_prf(fx.pred_truth(spark, sf)))


@register(
    "accuracy",
    PT
    + """SELECT count(*) AS n_valid, count(*) FILTER (WHERE y_true = y_pred) AS n_correct,
       round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM pred_truth WHERE y_true IS NOT NULL AND y_pred IS NOT NULL""",
)
def q_accuracy(spark, sf):
    """Accuracy over non-NULL pairs (computed, never hard-coded)."""
    return round_doubles(rp.accuracy(fx.pred_truth(spark, sf)))


TJ_SQL = (
    with_views("synthetic_edges")
    + """, tj AS (SELECT e.row_id, i.item_id,
                 CASE WHEN length(e.code_n1) >= 2 THEN substr(e.code_n1, 1, 2) END AS y_pred,
                 CASE WHEN length(i.code) >= 2 THEN substr(i.code, 1, 2) END AS y_true
          FROM synthetic_edges e JOIN items i ON i.description = e.description_n)
"""
)


def _truth_sides(spark, sf):
    e = fx.synthetic_edges(spark, sf).select(
        "row_id", F.col("description_n").alias("description"), tx.prefix2("code_n1").alias("y_pred")
    )
    t = fx.items(spark, sf).select("item_id", "description", tx.prefix2("code").alias("y_true"))
    return e, t


@register("truth_join", TJ_SQL + "SELECT row_id, item_id, y_pred, y_true FROM tj")
def q_truth_join(spark, sf):
    """Predictions x truth on exact description (many-to-many)."""
    return rp.truth_join(*_truth_sides(spark, sf), "description").select("row_id", "item_id", "y_pred", "y_true")


@register(
    "missing_report",
    TJ_SQL
    + """SELECT count(*) AS n_rows, count(*) FILTER (WHERE y_pred IS NULL) AS null_y_pred,
       count(*) FILTER (WHERE y_true IS NULL) AS null_y_true,
       count(*) FILTER (WHERE y_pred IS NOT NULL AND y_true IS NOT NULL) AS n_valid FROM tj""",
)
def q_missing_report(spark, sf):
    """NULL counts and rows valid for comparison on the truth join."""
    return rp.missing_report(rp.truth_join_counts(*_truth_sides(spark, sf)), ["y_pred", "y_true"], "n")


@register(
    "truth_accuracy",
    TJ_SQL
    + """SELECT count(*) AS n_valid, count(*) FILTER (WHERE y_true = y_pred) AS n_correct,
       round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM tj WHERE y_true IS NOT NULL AND y_pred IS NOT NULL""",
)
def q_truth_accuracy(spark, sf):
    """A16 on the J7 join (2-digit agreement of predicted and true codes)."""
    return round_doubles(rp.accuracy(rp.truth_join_counts(*_truth_sides(spark, sf)), "n"))


@register(
    "sort_year",
    M + "SELECT year_n, count(*) AS n, round(avg(best_match_similarity), 6) AS mean_similarity FROM mapping "
    "GROUP BY year_n ORDER BY year_n",
)
def q_sort_year(spark, sf):
    """Per-year rows in ascending year order (a range-partitioned sort)."""
    m = _m(spark, sf).groupBy("year_n").agg(F.count(F.lit(1)).alias("n"), F.avg("best_match_similarity").alias("mean_similarity"))
    return round_doubles(m.orderBy("year_n"))


@register(
    "concat_periods",
    M
    + """SELECT period, count(*) AS n, count(hs2_sim) AS n_hs2, count(hs4_sim) AS n_hs4, count(hs6_sim) AS n_hs6 FROM (
  SELECT 'early' AS period, best_match_similarity AS hs2_sim, combined AS hs4_sim, embedding_similarity AS hs6_sim
  FROM mapping WHERE year_n < 1930
  UNION ALL BY NAME
  SELECT 'middle' AS period, combined AS hs4_sim, embedding_similarity AS hs6_sim FROM mapping WHERE year_n BETWEEN 1930 AND 1962
  UNION ALL BY NAME
  SELECT 'late' AS period, embedding_similarity AS hs6_sim FROM mapping WHERE year_n BETWEEN 1963 AND 1988
  UNION ALL BY NAME
  SELECT 'current' AS period FROM mapping WHERE year_n >= 1989)
GROUP BY period""",
)
def q_concat_periods(spark, sf):
    """Stack per-period results whose columns differ (missing -> NULL)."""
    m = _m(spark, sf)
    early = m.filter(F.col("year_n") < 1930).select(
        F.lit("early").alias("period"), F.col("best_match_similarity").alias("hs2_sim"),
        F.col("combined").alias("hs4_sim"), F.col("embedding_similarity").alias("hs6_sim"),
    )
    middle = m.filter(F.col("year_n").between(1930, 1962)).select(
        F.lit("middle").alias("period"), F.col("combined").alias("hs4_sim"), F.col("embedding_similarity").alias("hs6_sim")
    )
    late = m.filter(F.col("year_n").between(1963, 1988)).select(
        F.lit("late").alias("period"), F.col("embedding_similarity").alias("hs6_sim")
    )
    current = m.filter(F.col("year_n") >= 1989).select(F.lit("current").alias("period"))
    u = early
    for more in (middle, late, current):
        u = u.unionByName(more, allowMissingColumns=True)
    return u.groupBy("period").agg(
        F.count(F.lit(1)).alias("n"), F.count("hs2_sim").alias("n_hs2"), F.count("hs4_sim").alias("n_hs4"),
        F.count("hs6_sim").alias("n_hs6"),
    )


_WSQ = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@register(
    "norm_desc",
    with_views("items")
    + f"SELECT year, count(DISTINCT description) AS n_raw, count(DISTINCT lower(trim(description, {_WSQ}))) AS n_norm "
    "FROM items GROUP BY year",
)
def q_norm_desc(spark, sf):
    """distinct descriptions per year before and after strip().lower()."""
    it = fx.items(spark, sf)
    return it.groupBy("year").agg(
        F.count_distinct("description").alias("n_raw"), F.count_distinct(tx.norm_desc("description")).alias("n_norm")
    )


@register(
    "l2_normalize",
    """SELECT vec_id AS id,
       round(list_sum(list_transform(
         list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS FLOAT)),
         lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))), 4) AS sq_norm
FROM embeddings""",
)
def q_l2_normalize(spark, sf):
    """unit-normalised vectors (squared norm of the float result)."""
    from yearlink.functions.vectors import l2_normalize

    v = fx.vec(spark, sf).select("id", l2_normalize("embedding").alias("u"))
    return v.select("id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("sq_norm"))


@register(
    "masked_mean_pool",
    """WITH t AS (SELECT label, vec_id, CASE WHEN vec_id % 3 = 0 THEN 0.0 ELSE 1.0 END AS m,
                  unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
     p AS (SELECT label, pos, sum(x * m) / greatest(sum(m), 1e-9) AS v FROM t GROUP BY label, pos)
SELECT label, count(*) AS dim, round(sum(v), 6) AS sum_v, round(max(v), 6) AS max_v FROM p GROUP BY label""",
)
def q_masked_mean_pool(spark, sf):
    """masked mean pooling of token vectors (vectors of one label = the
    tokens of one item; mask = vec_id % 3 != 0), without normalisation."""
    from yearlink.functions.vectors import masked_mean_pool

    tok = fx.table(spark, sf, "embeddings").select(
        "label", "embedding", F.when(F.col("vec_id") % 3 == 0, 0.0).otherwise(1.0).alias("mask")
    )
    pooled = masked_mean_pool(tok, "label", "embedding", "mask", normalize=False)
    e = pooled.select("label", F.explode("embedding").alias("v"))
    return round_doubles(
        e.groupBy("label").agg(F.count(F.lit(1)).alias("dim"), F.sum(F.col("v").cast("double")).alias("sum_v"),
                               F.max(F.col("v").cast("double")).alias("max_v"))
    )
