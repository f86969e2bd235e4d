"""Top-k similarity search in batch (Q1-Q4) and the search corpus.

A query set is a DataFrame ``(query_id, text, embedding)``; any number of
queries is answered in one job.  Retrieval is the exact tiled cosine top-k
(Q4, inner product on unit vectors); the rerank blends cosine, token Jaccard
and the Indel ratio (lower-cased, not stripped) and keeps ``top_k``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from yearlink.functions.indel import indel
from yearlink.functions.text import jaccard, tokens
from yearlink.functions.vectors import l2_norm, token_vectors
from yearlink.operators.similarity import cosine_topk, cosine_topk_scan


def search(
    queries: DataFrame,
    corpus: DataFrame,
    top_k: int = 5,
    alpha: float = 0.7,
    beta: float = 0.2,
    gamma: float = 0.1,
    rerank: bool = True,
    empty: str = "cosine",
    id_col: str = "item_id",
    desc_col: str = "description",
    method: str = "scan",
) -> DataFrame:
    """Q1/Q2/Q3: ``min(10*top_k, n)`` cosine candidates when reranking (else
    ``top_k``), scored and cut to ``top_k`` per query.

    A candidate with an empty description is not reranked: its combined score
    is its raw cosine (``empty='cosine'``, as read) or it is dropped from the
    candidates (``empty='skip'``).  Ties: combined desc, cosine desc, item id asc.
    Output: ``query_id, rank, combined_similarity, cosine_similarity,
    jaccard_similarity, levenshtein_similarity`` then the corpus columns.
    """
    vectors = corpus.select(F.col(id_col).alias("_cid"), "embedding", l2_norm("embedding").alias("norm"))
    meta_cols = [x for x in corpus.columns if x != "embedding"]
    meta = corpus.select(F.col(id_col).alias("_cid"), tokens(desc_col).alias("_ctok"), *meta_cols)
    return ranked_search(queries, vectors, meta, top_k, alpha, beta, gamma, rerank, empty, desc_col, method)


def ranked_search(
    queries: DataFrame, vectors: DataFrame, meta: DataFrame, top_k: int, alpha: float, beta: float, gamma: float, rerank: bool,
    empty: str, desc_col: str, method: str,
) -> DataFrame:
    """:func:`search` over ``vectors (_cid, embedding, norm)`` and ``meta
    (_cid, _ctok, ...)``: attributes are joined to the candidates only."""
    n_cand = 10 * top_k if rerank else top_k
    q = queries.select(F.lit(0).alias("_k"), "query_id", "embedding", l2_norm("embedding").alias("norm"))
    cv = vectors.select(F.lit(0).alias("_k"), "_cid", "embedding", "norm")
    cand = cosine_topk_scan(q, cv, n_cand, "query_id", "_cid") if method == "scan" else None
    if cand is None:  # too many queries to send along
        cand = cosine_topk(q, cv, ["_k"], n_cand, "query_id", "_cid", method="block" if method == "scan" else method)
    cand = cand.select(F.col("l_id").alias("query_id"), F.col("r_id").alias("_cid"), F.col("cos"))
    qt = queries.select(F.col("query_id").alias("_qid"), F.col("text").alias("_qtext"))
    j = cand.join(qt, cand["query_id"] == qt["_qid"]).join(meta, "_cid")
    has_desc = F.col(desc_col).isNotNull() & (F.col(desc_col) != "")
    if empty == "skip":  # after the retrieval: an empty one has taken its place among the candidates
        j = j.filter(has_desc)
    if rerank:
        jac = F.when(has_desc, jaccard(tokens("_qtext"), F.col("_ctok"))).otherwise(F.lit(0.0))
        lev = F.when(has_desc, indel("_qtext", desc_col, strip=False, guard=False)).otherwise(F.lit(0.0))
        j = j.withColumn("jaccard_similarity", jac).withColumn("levenshtein_similarity", lev)
        comb = F.when(
            has_desc,
            F.lit(float(alpha)) * F.col("cos")
            + F.lit(float(beta)) * F.col("jaccard_similarity")
            + F.lit(float(gamma)) * F.col("levenshtein_similarity"),
        ).otherwise(F.col("cos"))
    else:
        j = j.withColumn("jaccard_similarity", F.lit(0.0)).withColumn("levenshtein_similarity", F.lit(0.0))
        comb = F.col("cos")
    j = j.withColumn("combined_similarity", comb)
    w = Window.partitionBy("query_id").orderBy(F.desc("combined_similarity"), F.desc("cos"), F.asc("_cid"))
    ranked = j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)
    meta_cols = [x for x in meta.columns if x not in ("_cid", "_ctok")]
    return ranked.select(
        "query_id",
        "rank",
        "combined_similarity",
        F.col("cos").alias("cosine_similarity"),
        "jaccard_similarity",
        "levenshtein_similarity",
        *meta_cols,
    )


def flat_index_search(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """Q4: exact inner product on unit vectors (= cosine), top k per query."""
    q = queries.select(F.lit(0).alias("_k"), "query_id", "embedding", l2_norm("embedding").alias("norm"))
    v = vectors.select(F.lit(0).alias("_k"), F.col(id_col), "embedding", l2_norm("embedding").alias("norm"))
    out = cosine_topk(q, v, ["_k"], k, "query_id", id_col)
    w = Window.partitionBy("l_id").orderBy(F.desc("cos"), F.asc("r_id"))
    return out.select(
        F.col("l_id").alias("query_id"), F.col("r_id").alias(id_col), F.col("cos").alias("score"),
        F.row_number().over(w).alias("rank"),
    )


def search_text(queries: DataFrame, corpus: DataFrame, dim: int = 64, desc_col: str = "description", **how) -> DataFrame:
    """Q1 from text: queries ``(query_id, text)`` and corpus texts are encoded
    alike (hashed tokens), then searched."""
    return search(
        token_vectors(queries, "text", "embedding", dim), token_vectors(corpus, desc_col, "embedding", dim), desc_col=desc_col, **how
    )


# ------------------------------------------------------------------ corpus
def prepare_corpus(df: DataFrame, embedding_column: str = "description_embedding", columns_to_keep=None) -> DataFrame:
    """Metadata columns (default: all but the vector) + float vector.
    Written as one parquet table, the columnar layout gives the reference's
    metadata / matrix split for free."""
    keep = columns_to_keep or [c for c in df.columns if c != embedding_column]
    return df.select(*keep, F.col(embedding_column).cast("array<float>").alias("embedding"))


def corpus_info(corpus: DataFrame) -> DataFrame:
    """n_items, embedding_dim (and the metadata column list)."""
    cols = ",".join(c for c in corpus.columns if c != "embedding")
    return corpus.agg(
        F.count(F.lit(1)).alias("n_items"),
        F.max(F.size("embedding")).cast("int").alias("embedding_dim"),
        F.lit(cols).alias("columns"),
    )


def verify_corpus(corpus: DataFrame, expected_items: int | None = None) -> DataFrame:
    """One-row check: items, vectors of the wrong width, missing vectors.
    ``assert_corpus`` raises when anything is off."""
    dim = corpus.select(F.max(F.size("embedding"))).scalar()
    out = corpus.agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(F.col("embedding").isNotNull() & (F.size("embedding") != dim)).alias("n_bad_dim"),
        F.count_if(F.col("embedding").isNull()).alias("n_missing"),
    )
    if expected_items is not None:
        out = out.withColumn("n_count_mismatch", F.abs(F.col("n_items") - F.lit(expected_items)))
    return out


def assert_corpus(corpus: DataFrame) -> None:
    r = verify_corpus(corpus).first()
    if r["n_bad_dim"] or r["n_missing"]:
        raise ValueError(f"corpus check failed: {r.asDict()}")


def format_results(results: DataFrame, fmt: str = "json") -> DataFrame:
    """One text line per result row (JSON record or CSV line)."""
    cols = [c for c in results.columns]
    if fmt == "json":
        return results.select("query_id", "rank", F.to_json(F.struct(*cols)).alias("line"))
    if fmt == "csv":
        return results.select("query_id", "rank", F.to_csv(F.struct(*[F.col(c).cast("string") for c in cols])).alias("line"))
    if fmt == "text":
        return results.select(
            "query_id", "rank",
            F.format_string("%d. [%.4f] %s", F.col("rank"), F.floor(F.round("combined_similarity", 9) * 10000 + 0.5) / 10000.0, F.col("description")).alias("line"),
        )
    raise ValueError("fmt must be json, csv or text")
