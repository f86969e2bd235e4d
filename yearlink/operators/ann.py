"""Q4's approximate option: an inverted file with trained centroids.

Centroids are fitted by spherical k-means on a bounded sample (``SAMPLE``
vectors, the smallest by a hash of their id); every vector is then assigned to
its nearest centroid and stored in that list.  On the sample it is also measured
how many lists a search has to look at for the recall that was asked for (the
sample is thinner than the table, so neighbours lie farther and the number
errs on the safe side).  A search compares a query with these many lists,
those whose centroids are nearest, by the same tiled exact join
as the exact index, keyed by list, so a list that holds a third of all vectors
is cut into tiles.  The exact search stays the default.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yearlink.functions.vectors import l2_norm
from yearlink.operators.similarity import _dense, cosine_topk
from yearlink.session import ship_package

SAMPLE = 20_000  # vectors the centroids are fitted on, at most
MOST_LISTS = 4096  # centroids travel with the tasks


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def fit_centroids(points: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means; a list left empty takes the point worst served."""
    points = _unit(np.asarray(points, np.float64))
    rng = np.random.default_rng(7)
    centre = points[rng.permutation(len(points))[:lists]]
    for _ in range(rounds):
        near = points @ centre.T
        home = near.argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, home, points)
        empty = np.flatnonzero(np.bincount(home, minlength=len(centre)) == 0)
        total[empty] = points[np.argsort(near.max(axis=1), kind="stable")[: len(empty)]]
        centre = _unit(total)
    return centre


def probes_for(points: np.ndarray, centroids: np.ndarray, recall: float, k: int = 10, queries: int = 500) -> int:
    """Lists to look at so that a share ``recall`` of the ``k`` nearest sample
    points of ``queries`` sample points is found."""
    points = _unit(np.asarray(points, np.float64))
    if len(points) < 2:
        return len(centroids)
    home = (points @ centroids.T).argmax(axis=1)
    asked = np.arange(min(queries, len(points)))
    near = points[asked] @ points.T
    near[asked, asked] = -np.inf
    k = min(k, len(points) - 1)
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    order = np.argsort(-(points[asked] @ centroids.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, home[best], axis=1).reshape(-1))
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def _nearest(centroids: np.ndarray, probes: int, vec_at: int):
    """Adds to each row its ``probes`` nearest lists, best first."""

    def fn(batches):
        for b in batches:
            v = _unit(_dense(pa.chunked_array([b.column(vec_at)]), b.num_rows)) if b.num_rows else np.zeros((0, 0))
            d = max(v.shape[1], centroids.shape[1])
            near = np.pad(v, ((0, 0), (0, d - v.shape[1]))) @ np.pad(centroids, ((0, 0), (0, d - centroids.shape[1]))).T
            best = np.argsort(-near, axis=1, kind="stable")[:, :probes].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(best) + 1) * best.shape[1], pa.int32()), pa.array(best.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "lists"])

    return fn


def _with_lists(df: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    ship_package(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField("lists", T.ArrayType(T.IntegerType()))])
    return df.mapInArrow(_nearest(centroids, probes, df.columns.index("embedding")), schema)


def build_ivf(vectors: DataFrame, path: str, id_col: str = "id", lists: int | None = None, recall: float = 0.95) -> None:
    """Write the inverted file of ``(id_col, embedding)`` to ``path``:
    ``centroids`` (with the number of lists to look at for ``recall``) and
    ``lists`` (partitioned by list, every vector in one)."""
    spark = vectors.sparkSession
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col("embedding"))
    n = plain.count()
    lists = lists or max(1, min(MOST_LISTS, SAMPLE // 8, int(math.sqrt(n))))
    few = plain.where("embedding is not null").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    width = max((len(r[1]) for r in few), default=1)
    points = np.zeros((len(few), width))
    for i, r in enumerate(few):
        points[i, : len(r[1])] = r[1]
    centroids = fit_centroids(points, lists) if len(few) else np.zeros((1, width))
    probes = probes_for(points, centroids, recall)
    rows = [(i, [float(x) for x in c], probes) for i, c in enumerate(centroids)]
    spark.createDataFrame(rows, "list int, centroid array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    held = _with_lists(plain, centroids, 1).withColumn("norm", l2_norm("embedding")).withColumn("list", F.element_at("lists", 1)).drop("lists")
    held.repartition("list").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("list").parquet(f"{path}/lists")


def search_ivf(spark: SparkSession, queries: DataFrame, path: str, k: int, probes: int | None = None) -> DataFrame:
    """``query_id, id, score, rank``: the best ``k`` of the ``probes`` nearest
    lists (default: as many as were measured for the recall asked for)."""
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # at most MOST_LISTS
    centroids = np.array([r["centroid"] for r in rows])
    q = _with_lists(queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding"), centroids, min(probes or rows[0]["probes"], len(rows)))
    q = q.select("query_id", "embedding", l2_norm("embedding").alias("norm"), F.explode("lists").alias("list"))
    held = spark.read.schema("id long, embedding array<float>, norm double, list int").parquet(f"{path}/lists")
    found = cosine_topk(q, held, ["list"], k, "query_id", "id")
    w = Window.partitionBy("l_id").orderBy(F.desc("cos"), F.asc("r_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        F.col("l_id").alias("query_id"), F.col("r_id").alias("id"), F.col("cos").alias("score"), "rank"
    )
