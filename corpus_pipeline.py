"""The training-data pipeline over ``documents``.

Quality classifier, MinHash near-dedup, substring dedup, benchmark
decontamination, mixing.  Every stage works on all rows its predecessor kept;
its result is written as Parquet in the shared folder and read again by the
next.  All but the last return the columns of ``documents``.  A text that the
substring stage shortened has its new length in n_chars.

Defined results: a null or empty text is scored like any other, equals nothing,
loses nothing and leaks nothing; a row with a null doc_id is never the one that
goes from a group; repeated rows stay or go together up to the mixing, which
deals each row; of equal documents the smallest doc_id stays; an empty table
gives no rows; extra columns, whatever their names, go through all stages but
the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yearlink.llm import decontaminate, minhash_dedup, mixing, quality_classifier, substring_dedup
from yearlink.llm.common import prepare, read, shared_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality_classifier.good_documents(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (shingles of five words,
    similarity of 0.8 or more)."""
    return minhash_dedup.one_of_each_group(docs, shingle=5, threshold=80)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller doc_id has."""
    out = substring_dedup.remove_repeats(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType))
    return out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Uses of the documents, mixed by source."""
    return mixing.mixed(docs)


STAGES = [
    ("quality classifier", quality),
    ("near-dedup", near_dedup),
    ("substring dedup", substring),
    ("decontamination", decontamination),
    ("mixing", mixture),
]
ORACLE_SQL = None  # classifier and near-dedup have no SQL form; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
