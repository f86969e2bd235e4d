"""Operator 2, quality classifier: regularised quadratic discriminant.

Each class is a Gaussian over transformed statistics of the whole text.  Its
covariance is shrunk twice: towards the pooled one, then towards a multiple
of the identity.  A score is the logistic of the difference of the two log
densities, with Mahalanobis distances from the Cholesky factors, which are
computed once and travel to the tasks with the means (a few kB).

Training: the statistics of all documents are written once to the shared
folder.  The moments of each class (sums of x and x x') are summed up inside
the tasks over *all* labelled rows outside the held-out fold, so there is no
sample; the driver sees a few hundred numbers.

Defined cases: an empty or null text has statistics too (all zero) and gets
a score.  A label row with a null quality, or with another value than 0 and
1, teaches nothing; repeated label rows count as often as they are there.
If a class has fewer than two rows, every score is the share of label 1 (0.5
without labels).  Rows with a null doc_id are scored and never teach;
held_out is null for them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yearlink.llm import common as C
from yearlink.llm import docstats as D

POOLED, SPHERE = 0.3, 0.02  # shares of the pooled covariance and of the identity
THRESHOLD = 0.3


def features(texts) -> np.ndarray:
    """Transformed statistics, one row for each text.  Shares are smoothed by
    a small prior, as one digit in a short line says less than a hundred in a
    long text."""
    s = D.Stats(texts)

    def share(part, whole, prior, scale):
        return np.log1p(scale * part / (whole + prior))

    return np.column_stack(
        [
            np.log1p(s.n_words),
            np.log((s.word_chars + 50) / (s.n_words + 10)),
            np.log((s.n_words + 10) / (s.n_lines + 1)),
            share(s.symbols, s.chars, 100, 100),
            share(s.count(D.UPPER), s.chars, 100, 20),
            share(s.count(D.MARK), s.chars, 100, 100),
            share(s.count(D.DIGIT), s.chars, 300, 20),
            share(s.count(D.POINT), s.n_words, 20, 5),
            share(s.n_words - s.distinct_words, s.n_words, 20, 5),
            share(s.same_as_previous, s.n_words, 20, 20),
            share(s.duplicate_lines, s.n_lines, 5, 5),
            np.arcsin(np.sqrt(np.clip((s.count(D.LETTER) + 240) / (s.chars + 300), 0, 1))),
        ]
    )


def _described(batches):
    for b in C.slices(batches, "text"):
        x = features(b.column(1))
        flat = pa.array(x.reshape(-1))
        offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
        yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "x"])


def _matrix(column) -> np.ndarray:
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.empty((0, 0))


def _moments(batches):
    """Per class, of one partition: rows, sum of x, sum of x x'."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        y = b.column(0).to_numpy()
        x = _matrix(b.column(1))
        for k in np.unique(y):
            z = np.column_stack((np.ones((y == k).sum()), x[y == k]))
            sums[int(k)] = sums.get(int(k), 0) + z.T @ z
    if sums:
        yield pa.record_batch(
            [pa.array(list(sums), pa.int32()), pa.array([m.reshape(-1).tolist() for m in sums.values()])],
            names=["quality", "m"],
        )


class Discriminant:
    """Two Gaussians from their moment matrices (rows, sums and products)."""

    def __init__(self, moments: dict[int, np.ndarray], pooled: float = POOLED, sphere: float = SPHERE):
        rows = [moments[k][0, 0] if k in moments else 0.0 for k in (0, 1)]
        self.share = rows[1] / sum(rows) if sum(rows) else 0.5
        self.classes = []
        if min(rows) < 2:
            return
        means = [moments[k][0, 1:] / rows[k] for k in (0, 1)]
        scatter = [moments[k][1:, 1:] - rows[k] * np.outer(means[k], means[k]) for k in (0, 1)]
        every = (scatter[0] + scatter[1]) / (sum(rows) - 2)
        self.scale = np.sqrt(np.maximum(np.diag(every), 1e-8))
        every = every / np.outer(self.scale, self.scale)
        for k in (0, 1):
            own = scatter[k] / (rows[k] - 1) / np.outer(self.scale, self.scale)
            cov = (1 - pooled) * own + pooled * every
            cov = (1 - sphere) * cov + sphere * max(np.trace(cov) / len(cov), 1e-6) * np.eye(len(cov))
            factor = np.linalg.cholesky(cov)
            level = np.log(rows[k] / sum(rows)) - np.log(np.diag(factor)).sum()
            self.classes.append((means[k], np.linalg.inv(factor), level))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), self.share)
        logs = [level - 0.5 * ((((x - mean) / self.scale) @ inverse.T) ** 2).sum(axis=1) for mean, inverse, level in self.classes]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(described: DataFrame, labels: DataFrame, label_id: str, label_col: str) -> Discriminant:
    known = labels.select(F.col(label_id).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("quality"))
    learn = described.where("not held_out").join(known.where("quality in (0, 1)"), "doc_id").select("quality", "x")
    sums: dict[int, np.ndarray] = {}
    for r in learn.mapInArrow(_moments, "quality int, m array<double>").collect():  # two rows for each task at most
        m = np.array(r["m"])
        d = int(round(len(m) ** 0.5))
        sums[r["quality"]] = sums.get(r["quality"], 0) + m.reshape(d, d)
    return Discriminant(sums)


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id: str = "doc_id",
    label_col: str = "quality",
    folds: int = 5,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Per document: doc_id, held_out (crc32 of the id modulo ``folds`` is 0),
    score, predicted (1 if score >= threshold)."""
    C.prepare(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    described = C.shared_table(plain.mapInArrow(_described, "doc_id long, x array<double>"), "quality-statistics")
    described = described.withColumn("held_out", C.crc_mod("doc_id", folds) == 0)
    model = fit(described, labels, label_id, label_col)

    def score(batches):
        for b in batches:
            s = model.score(_matrix(b.column(2))) if b.num_rows else np.empty(0)
            made = [b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))]
            yield pa.record_batch(made, names=["doc_id", "held_out", "score", "predicted"])

    return described.select("doc_id", "held_out", "x").mapInArrow(
        score, "doc_id long, held_out boolean, score double, predicted int"
    )


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that are not rejected, all columns as they were."""
    bad = quality_scores(docs, labels, id_col, text_col, **how).where("predicted = 0 and doc_id is not null")
    return C.without(docs, bad.select("doc_id").distinct(), id_col)
