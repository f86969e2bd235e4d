"""Year-pair matching: J1 adjacent pairs, J2 candidates, J3 best match, F8.

Plan shape (both paths)::

    items --(year sizes)--> block plan (one row per year, broadcast)
    query rows   x  replicated over candidate blocks  \
                                                        > tile (year, qb, cb)
    candidate rows x replicated over query blocks      /
    rows of equal text and vector in a year enter the tiles as one class
    tile -> cosine -> pairs that can win, inside the top-k (similarity.py)
         -> tokens / lengths joined back -> Jaccard -> upper-bound prune
         -> Indel on survivors only -> combined -> row_number() = 1

Tiling bounds the work of one task by ``query_block x candidate_block`` pairs
whatever the size of a year, so a year holding a third of all rows is spread
over many tasks instead of landing on one join key.  The ``block`` path does
the tile as matrix products in an Arrow cogroup; the ``expr`` path
does it with Catalyst expressions (clear, fully planned, slower per pair).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yearlink.functions.indel import indel
from yearlink.functions.indel_expr import indel_expr
from yearlink.functions.text import indel_upper_bound, jaccard, norm_desc, tokens, uniq_key
from yearlink.functions.vectors import l2_norm
from yearlink.operators.exact import identical_counterparts
from yearlink.operators.similarity import cosine_topk
from yearlink.session import parquet_table

DIRECTIONS = ("n1_to_n", "n_to_n1")


def adjacent_pairs(items: DataFrame, year_col: str = "year") -> DataFrame:
    """Each available year with the next available one.

    The input to the window is the distinct year list (one row per edition),
    so the un-partitioned window runs over a handful of rows.
    """
    years = items.select(F.col(year_col).alias("year_n")).distinct()
    w = Window.orderBy("year_n")
    return years.withColumn("year_n1", F.lead("year_n").over(w)).filter(F.col("year_n1").isNotNull())


def prepare_items(items: DataFrame, key: str = "code") -> DataFrame:
    """P1/P2 + precomputed per-item columns (tokens, vector norm, text length).

    ``key='uniq_key'`` replaces the code by F10's unique key (J3c).
    """
    df = items.filter(F.col("description").isNotNull())
    code = uniq_key("year", "item_id", "code", "description") if key == "uniq_key" else F.col("code")
    return df.select(
        F.col("item_id").cast("long").alias("item_id"),
        F.col("year").cast("int").alias("year"),
        code.alias("code"),
        F.col("description"),
        F.col("embedding"),
        tokens("description").alias("tokens"),
        l2_norm("embedding").alias("norm"),
        F.length(norm_desc("description")).alias("nlen"),
    ).withColumn("ntok", F.size("tokens"))


def candidate_cosines(
    prepared: DataFrame,
    pairs: DataFrame,
    direction: str = "n1_to_n",
    top_k: int = 500,
    method: str = "block",
    query_block: int = 1024,
    cand_block: int = 4096,
    prune: dict | None = None,
) -> DataFrame:
    """J2 + T2: ``(q_id, c_id, cos)`` for the top-k candidates of each query
    by cosine (ties -> lower candidate id).  Cosines are quantised.  With a
    ``prune`` spec, top-k rows that cannot win the blended score are dropped
    early (exactly; see :func:`cosine_topk`).

    Queries and candidates are keyed by the query year; the pair list has
    one row per edition (bounded by the calendar) and is broadcast.
    """
    q, c = _sides(prepared, pairs, direction)
    return _topk(q, c, top_k, method, query_block, cand_block, prune).select("q_id", "c_id", "cos")


def _sides(prepared: DataFrame, pairs: DataFrame, direction: str) -> tuple[DataFrame, DataFrame]:
    """Queries and candidates, both keyed by the query's year ``qy``."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    qy, cy = ("year_n1", "year_n") if direction == "n1_to_n" else ("year_n", "year_n1")
    pq = F.broadcast(pairs.select(F.col(qy).alias("year"), F.col(qy).alias("qy")))
    pc = F.broadcast(pairs.select(F.col(cy).alias("year"), F.col(qy).alias("qy")))
    return prepared.join(pq, "year"), prepared.join(pc, "year")


def _class_key() -> Column:
    """Identity of text and vector: rows that share it score alike."""
    vector = F.coalesce(F.col("embedding").cast("string"), F.lit("null"))
    return F.sha2(F.concat(F.length("description").cast("string"), F.lit(":"), "description", vector), 256)


def text_vector_classes(prepared: DataFrame, k: int) -> DataFrame:
    """One row for each distinct (year, text, vector) of :func:`prepare_items`
    rows with ``cls``: a number ``q_cls``, the lowest id and ``ids``, the
    ``k + 1`` lowest, rising (a cut after ``k`` rows asks for no more)."""
    w = Window.partitionBy("year", "cls").orderBy("item_id")
    few = prepared.select("year", "cls", "item_id").withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k + 1)
    ids = few.groupBy("year", "cls").agg(F.array_sort(F.collect_list("item_id")).alias("ids"))
    cols = ["description", "embedding", "tokens", "norm", "nlen", "ntok"]
    one = prepared.groupBy("year", "cls").agg(F.any_value(F.struct(*cols)).alias("_s")).select("year", "cls", "_s.*")
    rows = one.join(ids, ["year", "cls"]).withColumn("item_id", F.get("ids", F.lit(0)))
    # numbered and written once: the number must not change between readers
    return parquet_table(rows.withColumn("q_cls", F.monotonically_increasing_id()), "item-classes")


def _topk(
    q: DataFrame, c: DataFrame, top_k: int, method: str, query_block: int, cand_block: int, prune: dict | None, q_id: str = "item_id"
) -> DataFrame:
    out = cosine_topk(
        q, c, ["qy"], top_k, q_id, "item_id", method=method, left_block=query_block, right_block=cand_block,
        prune=prune,
    )
    return out.select(F.col("l_id").alias("q_id"), F.col("r_id").alias("c_id"), *[x for x in ("cos", "jac", "most") if x in out.columns])


def match_year_pair(
    items: DataFrame,
    direction: str = "n1_to_n",
    key: str = "code",
    alpha: float = 0.7,
    beta: float = 0.2,
    gamma: float = 0.1,
    top_k: int = 500,
    method: str = "block",
    prune: bool = True,
    with_indel: bool = True,
    strip: bool = True,
    guard: bool = True,
    query_block: int = 1024,
    cand_block: int = 4096,
    pairs: DataFrame | None = None,
    materialize: bool = True,
    shortcut: bool = True,
    python: bool = True,
) -> DataFrame:
    """Best counterpart of every query item in the adjacent year.

    ``items`` needs ``item_id, year, code, description, embedding``.
    Direction ``n1_to_n`` (reverse): queries are year N1 items, candidates
    year N; ``n_to_n1`` (forward): the other way round.  Stage 1 keeps the
    ``top_k`` candidates by cosine; stage 2 picks the best combined score,
    ties -> higher cosine -> lower candidate id.  One row per query item that
    has any candidate; no threshold.

    ``prune`` (exact; not applied if beta or gamma is negative) drops
    candidates whose score cannot reach the best ``alpha*cos + beta*jac`` of their query even with a
    perfect Indel ratio, so the Python Indel runs on few pairs.
    ``with_indel=False`` sets the Indel column to NULL (used with gamma=0).
    ``shortcut`` (exact; see :mod:`yearlink.operators.exact`) settles queries
    that have a candidate of equal text and vector by a hash join; only the
    others enter the quadratic stage.
    ``python=False`` computes cosines and Indel ratios in Catalyst: no Python
    worker starts, at a higher price for each pair.
    """
    if not python:
        method = "expr"
    if materialize:
        # tokens and norms are CPU-heavy per byte: spread them over the slots
        items = items.repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), "item_id")
    prepared = prepare_items(items, key)
    spec = None
    # the bounds only hold for weights that are not negative; a top 1 needs none
    if prune and beta >= 0 and gamma >= 0 and method == "block" and top_k > 1:
        spec = {
            "alpha": float(alpha), "beta": float(beta), "gamma": float(gamma) if with_indel else 0.0,
            "tokens": "tokens", "ntok": "ntok", "nlen": "nlen", "ids": "ids",
        }
        prepared = prepared.withColumn("cls", _class_key())
    if materialize:
        # read 4+ times below (sizes, both tile sides, attribute joins):
        # write it once to the shared checkpoint folder, cut the lineage;
        # each reader then scans only its own columns
        prepared = parquet_table(prepared, "prepared-items")
    if pairs is None:
        pairs = adjacent_pairs(prepared)
    q, c = _sides(prepared, pairs, direction)
    settled = None
    lev_counts = with_indel and gamma > 0
    if shortcut and alpha > 0 and beta >= 0 and gamma >= 0 and (beta > 0 or lev_counts):
        # with the Indel term only equal texts reach the full score, without
        # it equal token sets do
        text = (norm_desc("description") if strip else F.lower("description")) if lev_counts else F.array_sort("tokens")
        settled = identical_counterparts(q, c, "qy", text, top_k)
        if materialize:  # read twice: to leave its queries out, and as their result
            settled = parquet_table(settled, "settled")
        q = q.join(settled.select(F.col("q_id").alias("item_id")), "item_id", "left_anti")
    # rows that share text and vector enter the quadratic stage as one: q_id is
    # a class from here on, c_id the lowest item of one
    light = prepared
    if spec is not None:
        light = text_vector_classes(prepared, top_k)
        left = q.select("year", "cls").distinct()
        q, c = _sides(light, pairs, direction)
        q = q.join(left, ["year", "cls"], "left_semi")
    q_id = "item_id" if spec is None else "q_cls"
    cand = _topk(q, c, top_k, method, query_block, cand_block, spec, q_id)

    # 1) token Jaccard and the most the Indel term can add: known from the
    #    tiles, or from tokens and lengths joined to every top-k pair.
    if "jac" not in cand.columns:
        light_c = prepared.select(F.col("item_id").alias("c_id"), F.col("tokens").alias("c_tokens"), F.col("nlen").alias("c_nlen"))
        light_q = prepared.select(F.col("item_id").alias("q_id"), F.col("tokens").alias("q_tokens"), F.col("nlen").alias("q_nlen"))
        cand = (
            cand.join(light_c, "c_id")
            .join(light_q, "q_id")
            .withColumn("jac", jaccard("q_tokens", "c_tokens"))
            .withColumn("most", F.lit(float(gamma)) * indel_upper_bound("q_nlen", "c_nlen"))
            .drop("q_tokens", "c_tokens")
        )
    scored = cand.withColumn("base", F.lit(float(alpha)) * F.col("cos") + F.lit(float(beta)) * F.col("jac"))
    if with_indel:
        # the Indel ratio is CPU-heavy and small in bytes: an explicit count
        # keeps AQE from packing it into a few tasks; the windows reuse it
        n_parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        scored = scored.repartition(n_parts, "q_id")
    byq = Window.partitionBy("q_id")
    if with_indel and gamma > 0 and prune:
        # 2) exact prune: keep pairs whose best possible score reaches the
        #    query's best alpha*cos + beta*jac
        scored = scored.withColumn("_best_base", F.max("base").over(byq)).filter(F.col("base") + F.col("most") >= F.col("_best_base") - 1e-12)
    scored = scored.select("q_id", "c_id", "cos", "jac", "base")
    if with_indel:
        # 3) texts only for the survivors, then the Indel ratio
        text_c = light.select(F.col("item_id").alias("c_id"), F.col("description").alias("c_text"))
        text_q = light.select(F.col(q_id).alias("q_id"), F.col("description").alias("q_text"))
        scored = scored.join(text_c, "c_id").join(text_q, "q_id")
        lev = (indel if python else indel_expr)("q_text", "c_text", strip=strip, guard=guard)
    else:
        lev = F.lit(None).cast("double")
    scored = scored.withColumn("lev", lev).withColumn(
        "comb", F.col("base") + F.lit(float(gamma)) * F.coalesce(F.col("lev"), F.lit(0.0))
    )
    w = Window.partitionBy("q_id").orderBy(F.desc("comb"), F.desc("cos"), F.asc("c_id"))
    best = scored.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") == 1).select(
        "q_id", "c_id", "cos", "jac", "lev", "comb"
    )
    if spec is not None:
        # back to the items of each class; an id that repeats keeps its best
        best = best.join(light.select(F.col("q_cls").alias("q_id"), "year", "cls"), "q_id").drop("q_id")
        best = best.join(prepared.select(F.col("item_id").alias("q_id"), "year", "cls"), ["year", "cls"])
        best = best.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") == 1).select("q_id", "c_id", "cos", "jac", "lev", "comb")
    if settled is not None:
        one = F.lit(1.0)
        base = F.lit(float(alpha)) * one + F.lit(float(beta)) * one
        known = settled.select(
            "q_id", "c_id", one.alias("cos"), one.alias("jac"),
            (one if with_indel else F.lit(None).cast("double")).alias("lev"),
            (base + F.lit(float(gamma)) * (one if with_indel else F.lit(0.0))).alias("comb"),
        )
        best = best.unionByName(known)
    # 4) full attributes for the winners only (one row per query item)
    attrs = ["item_id", "year", "code", "description"]
    qa = prepared.select(F.col("item_id").alias("q_id"), *[F.col(a).alias(f"q_{a}") for a in attrs])
    ca = prepared.select(F.col("item_id").alias("c_id"), *[F.col(a).alias(f"c_{a}") for a in attrs])
    best = best.join(qa, "q_id").join(ca, "c_id")

    side_n, side_n1 = ("c", "q") if direction == "n1_to_n" else ("q", "c")
    return best.select(
        F.col("q_id").alias("row_id"),
        F.col(f"{side_n}_year").alias("year_n"),
        F.col(f"{side_n1}_year").alias("year_n1"),
        F.col(f"{side_n}_item_id").alias("item_id_n"),
        F.col(f"{side_n1}_item_id").alias("item_id_n1"),
        F.col(f"{side_n}_code").alias("code_n"),
        F.col(f"{side_n1}_code").alias("code_n1"),
        F.col(f"{side_n}_description").alias("description_n"),
        F.col(f"{side_n1}_description").alias("description_n1"),
        F.col("cos").alias("cosine"),
        F.col("jac").alias("jaccard"),
        F.col("lev").alias("levenshtein"),
        F.col("comb").alias("combined"),
    )
