"""Reports on the final mapping and on predictions (A4-A10, A13-A19, W1, W2,
P3, P8, P10, P11, J7) and code cleaning (F11 as a row operator, A5).

All of these are grouped aggregates: map-side partial aggregation, one
shuffle on the group key, results of at most (groups x measures) rows.  The
only un-partitioned windows run over per-year aggregates (one row per
edition).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from yearlink.functions.text import clean_code, clean_code_keep
from yearlink.operators.quantile import exact_median

# Era names and year ranges (inclusive), in report order.
ERAS = [
    ("Pre-TSUS (1789-1929)", 1789, 1929),
    ("TSUS (1930-1962)", 1930, 1962),
    ("TSUSA (1963-1988)", 1963, 1988),
    ("HTSUS (1989-2023)", 1989, 2023),
]
# Milestone years of the milestone table.
MILESTONE_YEARS = [1930, 1963, 1989, 1996, 2002, 2007, 2012, 2022]
# Source categories in report order.
SOURCE_CATEGORIES = ["Direct mapping", "Detailed HS", "Census Website"]
HS_SOURCES = ["HS6", "HS4", "HS2"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def era_label(year) -> Column:
    """Year -> era name, else 'Unknown'."""
    y = _c(year)
    expr = None
    for name, lo, hi in ERAS:
        expr = F.when(y.between(lo, hi), F.lit(name)) if expr is None else expr.when(y.between(lo, hi), F.lit(name))
    return expr.otherwise(F.lit("Unknown"))


def source_category(sim="best_match_similarity", source="best_match_source") -> Column:
    """P10: '< 0.4' -> Census Website; else HS-level source -> Detailed HS;
    else Direct mapping.  NULL similarity is not low."""
    s, src = _c(sim), _c(source)
    return (
        F.when(F.coalesce(s < 0.4, F.lit(False)), F.lit("Census Website"))
        .when(src.isin(*HS_SOURCES), F.lit("Detailed HS"))
        .otherwise(F.lit("Direct mapping"))
    )


def _lt(x: Column, t: float) -> Column:
    return F.coalesce(x < t, F.lit(False)).cast("double")


def filter_year(df: DataFrame, lo: int, hi: int | None = None, year_col: str = "year_n") -> DataFrame:
    """Rows of one year or an inclusive range (prunes partitions on year)."""
    return df.filter(F.col(year_col).between(lo, hi if hi is not None else lo))


def mean_by_year(df: DataFrame, col: str = "combined") -> DataFrame:
    """A4: mean score per year."""
    return df.groupBy("year_n").agg(F.avg(col).alias(f"mean_{col}"))


def yoy_drop(df: DataFrame, col: str = "best_match_similarity") -> DataFrame:
    """Per-year mean, previous year's mean (``lag``) and ``drop = prev - cur``.
    The window runs over the per-year aggregate (one row per edition)."""
    per_year = df.groupBy("year_n").agg(F.avg(col).alias("mean"))
    w = Window.orderBy("year_n")
    return per_year.withColumn("prev", F.lag("mean").over(w)).withColumn("drop", F.col("prev") - F.col("mean"))


def major_dips(df: DataFrame, col: str = "best_match_similarity", t: float = 0.1) -> DataFrame:
    """Years whose mean dropped by more than ``t`` (first year excluded)."""
    return yoy_drop(df, col).filter(F.col("drop") > t)


def low_similarity_share(df: DataFrame, col: str, t: float = 0.5) -> DataFrame:
    """Rows below ``t`` and their share of all rows (NULL is not low)."""
    return df.agg(
        F.count_if(F.coalesce(F.col(col) < t, F.lit(False))).alias("n_low"),
        F.avg(_lt(F.col(col), t)).alias("share_low"),
    )


def low_similarity_rows(df: DataFrame, col: str, t: float = 0.5) -> DataFrame:
    """The rows below ``t``, highest first (NULL is not low)."""
    return df.filter(F.col(col) < t).orderBy(F.desc(col))


def era_summary(df: DataFrame) -> DataFrame:
    """Per era: N, mean/median best match, % best < .5, mean/median
    combined, % combined < .5, mean/median embedding (non-NULL only).  The %
    denominators count all rows.  Rounded half-even to 3 (1 for %).  Eras
    without rows do not appear; years outside every era are left out."""
    e = df.withColumn("Era", era_label("year_n")).filter(F.col("Era") != "Unknown")
    e = e.select("Era", "best_match_similarity", "combined", "embedding_similarity")
    b, c, m = F.col("best_match_similarity"), F.col("combined"), F.col("embedding_similarity")
    base = e.groupBy("Era").agg(
        F.count(F.lit(1)).alias("N items"),
        F.bround(F.avg(b), 3).alias("Mean best_match"),
        F.bround(F.avg(_lt(b, 0.5)) * 100, 1).alias("% with best_match < 0.5"),
        F.bround(F.avg(c), 3).alias("Mean Combined"),
        F.bround(F.avg(_lt(c, 0.5)) * 100, 1).alias("% with Combined < 0.5"),
        F.bround(F.avg(m), 3).alias("Mean embedding"),
    )
    # exact medians without gathering an era (a third of the table) in one
    # task; the three columns are stacked so that one pass serves all three
    meds = [("best_match_similarity", "Median best_match"), ("combined", "Median Combined"),
            ("embedding_similarity", "Median embedding")]
    stacked = e.select(
        "Era",
        F.explode(F.array(*[F.struct(F.lit(n).alias("_m"), F.col(c).cast("double").alias("_v")) for c, n in meds])).alias("_s"),
    ).select("Era", "_s._m", "_s._v")
    med = exact_median(stacked, ["Era", "_m"], "_v", "_med")
    wide = med.groupBy("Era").agg(
        *[F.max(F.when(F.col("_m") == n, F.bround("_med", 3))).alias(n) for _, n in meds]
    )
    base = base.join(wide, "Era", "left")
    order = ["Era", "N items", "Mean best_match", "Median best_match", "% with best_match < 0.5", "Mean Combined",
             "Median Combined", "% with Combined < 0.5", "Mean embedding", "Median embedding"]
    return base.select(*[F.col(f"`{c}`") for c in order])


def milestone_table(df: DataFrame, spark: SparkSession, years=tuple(MILESTONE_YEARS)) -> DataFrame:
    """For fixed years: count, mean and sample std of the best similarity.
    A year without rows appears with 0 and NULLs.  The year list is a fixed
    handful of rows (broadcast); the aggregate is filtered to those years."""
    ys = F.broadcast(spark.createDataFrame([(int(y),) for y in years], "Year int"))
    agg = (
        df.filter(F.col("year_n").isin(*years))
        .groupBy(F.col("year_n").alias("Year"))
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.avg("best_match_similarity").alias("_m"),
            F.stddev_samp("best_match_similarity").alias("_s"),
        )
    )
    return ys.join(agg, "Year", "left").select(
        "Year",
        F.coalesce(F.col("_n"), F.lit(0)).alias("Count of Tariff Items"),
        F.bround(F.col("_m"), 3).alias("Mean 2023 Similarity"),
        F.bround(F.col("_s"), 3).alias("Std. Dev."),
    )


def source_crosstab(df: DataFrame, spark: SparkSession) -> DataFrame:
    """A10: era x source category, each era row normalised to 100.  Fixed
    row and column order; an era without rows gives NULLs; a category
    absent from the whole table is NULL; otherwise a missing cell is 0."""
    d = df.select(era_label("year_n").alias("era"), source_category().alias("cat"))
    counts = d.groupBy("era").pivot("cat", SOURCE_CATEGORIES).count()
    present = d.agg(*[F.max((F.col("cat") == c).cast("int")).alias(f"_p{i}") for i, c in enumerate(SOURCE_CATEGORIES)])
    eras = F.broadcast(spark.createDataFrame([(n, i) for i, (n, _, _) in enumerate(ERAS)], "era string, _o int"))
    total = sum(F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in SOURCE_CATEGORIES)
    j = eras.join(counts, "era", "left").withColumn("_t", total)
    cols = []
    for i, c in enumerate(SOURCE_CATEGORIES):
        flag = present.select(F.col(f"_p{i}")).scalar()
        cell = F.when(F.col("_t") > 0, F.coalesce(F.col(f"`{c}`"), F.lit(0)) * 100.0 / F.col("_t"))
        cols.append(F.when(flag == 1, cell).alias(c))
    return j.select("era", *cols, "_o").orderBy("_o").drop("_o")


def similarity_histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between min and max; the maximum lands in the
    last bin.  min/max are scalar subqueries (computed once)."""
    lo = df.select(F.min(col)).scalar()
    hi = df.select(F.max(col)).scalar()
    x = F.col(col)
    b = F.when(hi > lo, F.least(F.floor((x - lo) / (hi - lo) * bins) + 1, F.lit(bins))).otherwise(F.lit(1))
    return df.filter(x.isNotNull()).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def year_means_selected(df: DataFrame, years=(1789, 1963, 1989), col: str = "best_match_similarity") -> DataFrame:
    """Mean best similarity at selected years."""
    return df.filter(F.col("year_n").isin(*years)).groupBy("year_n").agg(F.avg(col).alias("mean_similarity"))


# ------------------------------------------------------------ predictions
def truth_join(pred: DataFrame, truth: DataFrame, on: str = "description", most: int = 1 << 20) -> DataFrame:
    """Predictions x ground truth on exact text (inner, many-to-many).  A
    text with more than ``most`` joined rows is dealt to several parts: its
    predictions by their hash, its truth rows to each part, so that no task
    joins it alone.  There are few such texts: one for ``most`` rows out."""
    n_p = pred.groupBy(on).agg(F.count(F.lit(1)).alias("_np"))
    n_t = truth.groupBy(on).agg(F.count(F.lit(1)).alias("_nt"))
    hot = n_p.join(n_t, on).where(F.col("_np") * F.col("_nt") > most)
    hot = F.broadcast(hot.select(on, F.ceil(F.col("_np") * F.col("_nt") / most).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    p = pred.join(hot, on, "left").withColumn("_part", F.pmod(F.xxhash64(*pred.columns), parts).cast("int")).drop("_parts")
    t = truth.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return p.join(t, [on, "_part"]).drop("_part")


def confusion_matrix(pt: DataFrame) -> DataFrame:
    """(y_true, y_pred, n) for every cell over the union of the labels,
    zero cells too.  The grid has one row for each pair of *labels*: the list
    of labels (one array, at most ``classes`` long) is exploded beside each."""
    seen = pt.filter(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull())
    cells = seen.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    labels = cells.select(F.explode(F.array("y_true", "y_pred")).alias("y_true")).distinct()
    every = labels.agg(F.collect_set("y_true").alias("_all")).withColumn("_one", F.lit(1))
    grid = labels.withColumn("_one", F.lit(1)).join(F.broadcast(every), "_one").select("y_true", F.explode("_all").alias("y_pred"))
    return grid.join(cells, ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("n", F.lit(0)).alias("n"))


def _per_class(pt: DataFrame) -> DataFrame:
    v = pt.filter(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull())
    t = v.groupBy(F.col("y_true").alias("label")).agg(
        F.count(F.lit(1)).alias("support"), F.count_if(F.col("y_true") == F.col("y_pred")).alias("tp")
    )
    p = v.groupBy(F.col("y_pred").alias("label")).agg(F.count(F.lit(1)).alias("n_pred"))
    j = t.join(p, "label", "full_outer").select(
        "label",
        F.coalesce("support", F.lit(0)).alias("support"),
        F.coalesce("tp", F.lit(0)).alias("tp"),
        F.coalesce("n_pred", F.lit(0)).alias("n_pred"),
    )
    prec = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    j = j.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return j.withColumn("f1", f1)


def classification_report(pt: DataFrame) -> DataFrame:
    """Per-class precision / recall / F1 / support plus 'macro avg' and
    'weighted avg' rows (zero_division = 0); labels = union of both sides."""
    pc = _per_class(pt)
    rows = pc.select("label", "precision", "recall", "f1", F.col("support").cast("long").alias("support"))
    macro = pc.agg(
        F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"), F.sum("support").cast("long").alias("support"),
    )
    weighted = weighted_prf(pt, pc).select(
        F.lit("weighted avg").alias("label"), "precision", "recall", "f1", "support"
    )
    return rows.unionByName(macro).unionByName(weighted)


def weighted_prf(pt: DataFrame, per_class: DataFrame | None = None) -> DataFrame:
    """Support-weighted precision, recall and F1."""
    pc = per_class if per_class is not None else _per_class(pt)
    s = F.sum("support")
    return pc.agg(
        (F.sum(F.col("precision") * F.col("support")) / s).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / s).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / s).alias("f1"),
        s.cast("long").alias("support"),
    )


def truth_join_counts(pred: DataFrame, truth: DataFrame, on: str = "description") -> DataFrame:
    """J7 for reports: (y_pred, y_true, n) where n is the number of joined
    rows.  Both sides are counted by text and label first, so a text that is
    repeated on both sides meets once, not n x m times."""
    p = pred.filter(F.col(on).isNotNull()).groupBy(on, "y_pred").agg(F.count(F.lit(1)).alias("_np"))
    t = truth.filter(F.col(on).isNotNull()).groupBy(on, "y_true").agg(F.count(F.lit(1)).alias("_nt"))
    return p.join(t, on).select("y_pred", "y_true", (F.col("_np") * F.col("_nt")).alias("n"))


def accuracy(pt: DataFrame, count: str | None = None) -> DataFrame:
    """Share of non-NULL pairs with pred = truth (computed, never fixed).
    ``count`` names a column that says how often a row counts."""
    n = F.col(count) if count else F.lit(1)
    v = pt.filter(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull())
    right = F.when(F.col("y_true") == F.col("y_pred"), n).otherwise(F.lit(0))
    return v.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("n_valid"),
        F.coalesce(F.sum(right), F.lit(0)).alias("n_correct"),
        (F.sum(right) / F.sum(n)).alias("accuracy"),
    )


def missing_report(df: DataFrame, cols: list[str], count: str | None = None) -> DataFrame:
    """NULL count per column and rows valid for comparison.  ``count``
    names a column that says how often a row counts."""
    n = F.col(count) if count else F.lit(1)
    valid = F.lit(True)
    for c in cols:
        valid = valid & F.col(c).isNotNull()
    total = lambda cond: F.coalesce(F.sum(F.when(cond, n).otherwise(F.lit(0))), F.lit(0))
    return df.agg(
        total(F.lit(True)).alias("n_rows"),
        *[total(F.col(c).isNull()).alias(f"null_{c}") for c in cols],
        total(valid).alias("n_valid"),
    )



# --------------------------------------------------------------- cleaning
def clean_codes(df: DataFrame, code_col: str, year_col: str, min_year: int = 1989) -> DataFrame:
    """from ``min_year`` on, strip a float '.0' from codes longer than 8,
    drop rows whose code then has 10+ characters, left-pad 7-char codes with
    '0'.  NULL codes are kept."""
    return df.filter(clean_code_keep(code_col, year_col, min_year)).withColumn(
        code_col, clean_code(code_col, year_col, min_year)
    )


def code_length_counts(df: DataFrame, code_col: str = "code", year_col: str = "year", min_year: int = 1989) -> DataFrame:
    """A5: histogram of code length for years >= ``min_year``."""
    return (
        df.filter(F.col(year_col) >= min_year)
        .groupBy(F.length(code_col).alias("code_length"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
