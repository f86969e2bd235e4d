"""Vector functions (F5-F7) and the pluggable batch encoder.

Vectors are ``array<float>`` columns.  Dot products accumulate in double.
Scores are quantised to ``SCORE_DIGITS`` decimals before any ranking so that
the expression path, the blocked matrix path and the SQL oracle order ties
identically (float32 inputs carry ~7 significant digits anyway).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yearlink.session import ship_package

SCORE_DIGITS = 9


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    """Inner product of two equal-length vectors, accumulated in double."""
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, v: acc + v)


def l2_norm(a) -> Column:
    """Euclidean norm (double)."""
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def quantise(x) -> Column:
    return F.round(_c(x), SCORE_DIGITS)


def cosine(a, b, norm_a=None, norm_b=None) -> Column:
    """cosine similarity; 0 for a zero/NULL vector or a length mismatch.

    Pass precomputed norms to avoid recomputing them per pair.
    """
    na = _c(norm_a) if norm_a is not None else l2_norm(a)
    nb = _c(norm_b) if norm_b is not None else l2_norm(b)
    den = na * nb
    raw = F.when(den > 0, dot(a, b) / den)
    return F.coalesce(quantise(raw), F.lit(0.0))


def l2_normalize(a) -> Column:
    """unit vector (a zero vector stays zero)."""
    n = l2_norm(a)
    return F.when(n > 0, F.transform(_c(a), lambda x: (x / n).cast("float"))).otherwise(_c(a))


def masked_mean_pool(
    token_vectors: DataFrame,
    id_col: str,
    vec_col: str = "embedding",
    mask_col: str = "mask",
    normalize: bool = True,
) -> DataFrame:
    """``sum(tok*mask) / max(sum(mask), 1e-9)`` per item, optionally unit-normalised.

    One row per (item, token) in, one pooled vector per item out.  The
    per-dimension sums are a plain groupBy (map-side partial aggregation);
    the re-assembled vector per item is bounded by the vector width.
    """
    exploded = token_vectors.select(
        F.col(id_col), F.col(mask_col).cast("double").alias("_m"), F.posexplode(vec_col).alias("_pos", "_x")
    )
    per_dim = exploded.groupBy(id_col, "_pos").agg(
        (F.sum(F.col("_x").cast("double") * F.col("_m")) / F.greatest(F.sum("_m"), F.lit(1e-9))).alias("_v")
    )
    pooled = per_dim.groupBy(id_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_v"))), lambda s: s["_v"].cast("float")).alias(
            vec_col
        )
    )
    if normalize:
        pooled = pooled.withColumn(vec_col, l2_normalize(vec_col))
    return pooled


# ---------------------------------------------------------------- encoders
# An encoder maps an array of texts to a float32 matrix [n, dim].
Encoder = Callable[[np.ndarray], np.ndarray]
# Token vectors [tokens, dim] of distinct tokens, and which of them are known.
Lookup = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def mean_pooled(vectors: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """F7 for a batch: unit-normalised mean of the token vectors of each of
    ``n`` texts; ``rows`` (ascending) says whose token each vector is.  Texts
    of any length lie side by side, so none is padded or cut."""
    out = np.zeros((n, vectors.shape[1]))
    if len(rows):
        start = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        out[rows[start]] = np.add.reduceat(vectors, start, axis=0, dtype=np.float64)
    out /= np.maximum(np.bincount(rows, minlength=n), 1e-9)[:, None]
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    np.divide(out, norms, out=out, where=norms > 0)
    return out.astype(np.float32)


def token_encoder(lookup: Lookup) -> Encoder:
    """Lower-cased tokens of a batch, looked up once each, mean-pooled.  A
    token without a vector is masked; a text without any has a zero vector."""

    def encode(texts: np.ndarray) -> np.ndarray:
        words = pd.Series(texts, dtype=object).str.lower().str.split(r"[ \t\n\f\r]+", regex=True).explode()
        words = words[words.notna() & (words != "")]
        codes, distinct = pd.factorize(words)
        vectors, known = lookup(list(distinct))
        rows, codes = words.index.to_numpy()[known[codes]], codes[known[codes]]
        return mean_pooled(vectors[codes], rows, len(texts))

    return encode


def hashed_token_encoder(dim: int = 64) -> Encoder:
    """Deterministic default encoder, needs no model file: a token's vector is
    one signed slot of its md5, as in :func:`token_vectors`."""

    def lookup(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        h = np.array([int.from_bytes(hashlib.md5(t.encode()).digest()[:4], "big") for t in tokens], np.int64)
        out = np.zeros((len(tokens), dim), np.float32)
        out[np.arange(len(tokens)), h % dim] = np.where(h % (2 * dim) >= dim, 1.0, -1.0)
        return out, np.ones(len(tokens), bool)

    return token_encoder(lookup)


def table_encoder(tokens: list[str], vectors: np.ndarray) -> Encoder:
    """Encoder over a table of static token vectors, such as a model's input
    embeddings loaded from a file; other tokens are masked."""
    index = pd.Index(tokens)

    def lookup(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        at = index.get_indexer(found)
        return vectors[at], at >= 0

    return token_encoder(lookup)


_ENCODERS: dict[str, tuple[Callable[[], Encoder], int]] = {"hashed64": (lambda: hashed_token_encoder(64), 1024)}


def register_encoder(name: str, factory: Callable[[], Encoder], batch_size: int = 1024) -> None:
    """Plug in an encoder.  ``factory`` travels with the task, runs once in
    each Python worker and loads the model there, from a place that workers
    can read; ``batch_size`` texts at most are encoded at once."""
    _ENCODERS[name] = factory, batch_size
    _encoder_udf.cache_clear()


@lru_cache(maxsize=None)
def _encoder_udf(name: str):
    from pyspark.ml.functions import predict_batch_udf

    factory, batch_size = _ENCODERS[name]
    return predict_batch_udf(factory, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)


def embed_texts(df: DataFrame, text_col: str, out_col: str = "embedding", encoder: str = "hashed64") -> DataFrame:
    """Encode each *distinct* text once (rewrite 3), then join back.

    Null text is encoded as '' (P12).  The distinct is a shuffle on the text;
    the encoder is a batch predictor: loaded once a worker, called for
    ``batch_size`` texts at a time.
    """
    ship_package(df.sparkSession)
    key = F.coalesce(F.col(text_col), F.lit(""))
    distinct = df.select(key.alias("_text")).distinct()
    vecs = distinct.select("_text", _encoder_udf(encoder)(F.col("_text")).alias(out_col))
    return df.withColumn("_text", key).join(vecs, "_text", "left").drop("_text")


def token_vectors(df: DataFrame, text_col: str, out_col: str = "embedding", dim: int = 64) -> DataFrame:
    """U1 without Python: signed feature hashing (md5) of the lower-cased
    tokens of each *distinct* text, unit-normalised, joined back.  Text and
    NULL without a token give a zero vector."""
    key = F.coalesce(F.col(text_col), F.lit(""))
    texts = df.select(key.alias("_text")).distinct()
    h = F.conv(F.substring(F.md5("_tok"), 1, 8), 16, 10).cast("long")
    slots = (
        texts.select("_text", F.explode(F.split(F.lower("_text"), r"\s+")).alias("_tok"))
        .filter("_tok <> ''")
        .select("_text", (h % dim).cast("int").alias("_s"), F.when(h % (2 * dim) >= dim, 1.0).otherwise(-1.0).alias("_v"))
        .groupBy("_text", "_s")
        .agg(F.sum("_v").alias("_v"))
    )
    packed = slots.groupBy("_text").agg(
        F.map_from_entries(F.collect_list(F.struct("_s", "_v"))).alias("_m"),  # at most ``dim`` entries
        F.sqrt(F.sum(F.col("_v") * F.col("_v"))).alias("_n"),
    )
    value = lambda s: F.coalesce(F.when(F.col("_n") > 0, F.element_at("_m", s) / F.col("_n")), F.lit(0.0)).cast("float")
    vecs = texts.join(packed, "_text", "left").select(
        "_text", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), value).alias(out_col)
    )
    kept = [c for c in df.columns if c != out_col]
    return df.select(*kept, key.alias("_text")).join(vecs, "_text").select(*kept, out_col)


def top_k_by(df: DataFrame, partition_cols, order_cols, k: int, rank_col: str = "rk") -> DataFrame:
    """Keep the first ``k`` rows per group (plans as WindowGroupLimit)."""
    w = Window.partitionBy(*partition_cols).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)
