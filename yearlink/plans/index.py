"""A stored search index (Q1, S12-S14): built once, checked, opened by path.

Three Parquet tables under one folder:

* ``vectors``: id, vector, norm;
* ``texts``: id, token set and the metadata columns;
* ``info``: one row with the number of items, the vector width, the columns
  and checksums of ids, vectors and texts.

The checksums are sums of row hashes.  They are observed in the pass that
writes, so building takes no second scan.  A search reads the stored norms and
tokens; only the candidates' texts are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from yearlink.functions.text import tokens
from yearlink.functions.vectors import l2_norm
from yearlink.plans.search import ranked_search

_INFO = (
    "n_items long, embedding_dim int, columns string, id_col string, desc_col string, "
    "ids decimal(38,0), vectors decimal(38,0), texts decimal(38,0)"
)


def _sum(*cols) -> Column:
    """Order-free checksum of a table's rows."""
    return F.coalesce(F.sum(F.xxhash64(*cols).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))


def _vector_metrics() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n_items"),
        F.max(F.size("embedding")).cast("int").alias("embedding_dim"),
        _sum("_cid").alias("ids"),
        _sum("_cid", "embedding").alias("vectors"),
    ]


def build_index(corpus: DataFrame, path: str, id_col: str = "item_id", desc_col: str = "description") -> None:
    """Write the index of ``corpus`` (``id_col``, ``embedding``, ``desc_col``
    and any metadata) to the folder ``path``, replacing what is there."""
    spark = corpus.sparkSession
    meta = [c for c in corpus.columns if c != "embedding"]
    vectors = corpus.select(
        F.col(id_col).cast("long").alias("_cid"), F.col("embedding").cast("array<float>").alias("embedding")
    ).withColumn("norm", l2_norm("embedding"))
    texts = corpus.select(F.col(id_col).cast("long").alias("_cid"), tokens(desc_col).alias("_ctok"), *meta)
    seen, read = Observation(), Observation()
    vectors.observe(seen, *_vector_metrics()).write.mode("overwrite").parquet(f"{path}/vectors")
    texts.observe(read, _sum("_cid", desc_col).alias("texts")).write.mode("overwrite").parquet(f"{path}/texts")
    v, t = seen.get, read.get
    row = (v["n_items"], v["embedding_dim"], ",".join(meta), id_col, desc_col, v["ids"], v["vectors"], t["texts"])
    spark.createDataFrame([row], _INFO).coalesce(1).write.mode("overwrite").parquet(f"{path}/info")


@dataclass(frozen=True)
class Index:
    vectors: DataFrame
    texts: DataFrame
    info: dict


def open_index(spark: SparkSession, path: str, check: bool = False) -> Index:
    """The index under ``path``; with ``check`` it is verified first."""
    if check:
        assert_index(spark, path)
    info = spark.read.schema(_INFO).parquet(f"{path}/info").first()
    if info is None:
        raise ValueError(f"no info row under {path}")
    return Index(spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/texts"), info.asDict())


def verify_index(spark: SparkSession, path: str) -> DataFrame:
    """The stored tables against the stored info row, one row."""
    info = spark.read.schema(_INFO).parquet(f"{path}/info")
    one = info.first()
    desc = one["desc_col"] if one else "description"
    vectors = spark.read.parquet(f"{path}/vectors").agg(
        *_vector_metrics(),
        F.count_if(F.size("embedding") != (one["embedding_dim"] if one else None)).alias("n_bad_dim"),
        F.count_if(F.col("embedding").isNull()).alias("n_missing"),
    )
    texts = spark.read.parquet(f"{path}/texts").agg(_sum("_cid").alias("tids"), _sum("_cid", desc).alias("texts"))
    i = info.select(*[F.col(c).alias(f"i_{c}") for c in info.columns])
    all_ = vectors.withColumn("_one", F.lit(1)).join(texts.withColumn("_one", F.lit(1)), "_one").join(i.withColumn("_one", F.lit(1)), "_one", "left")
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    return all_.select(
        "n_items",
        F.col("i_n_items").alias("n_items_info"),
        "embedding_dim",
        "n_bad_dim",
        "n_missing",
        (same("ids", "i_ids") & same("tids", "i_ids") & same("n_items", "i_n_items")).alias("same_ids"),
        same("vectors", "i_vectors").alias("same_vectors"),
        same("texts", "i_texts").alias("same_texts"),
    )


def assert_index(spark: SparkSession, path: str) -> None:
    r = verify_index(spark, path).first()
    if r["n_bad_dim"] or r["n_missing"] or not (r["same_ids"] and r["same_vectors"] and r["same_texts"]):
        raise ValueError(f"index check failed: {r.asDict()}")


def search_index(
    queries: DataFrame, index: Index, top_k: int = 5, alpha: float = 0.7, beta: float = 0.2, gamma: float = 0.1, rerank: bool = True,
    empty: str = "cosine",
) -> DataFrame:
    """:func:`yearlink.plans.search.search` over a stored index."""
    return ranked_search(queries, index.vectors, index.texts, top_k, alpha, beta, gamma, rerank, empty, index.info["desc_col"], "scan")
