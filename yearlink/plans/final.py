"""The whole mapping in one job: match, clean codes, chain, score, repair.

J3 forward edges -> F11 on both codes, each with its own year -> C2 to the
anchor edition -> J10 cosine of the row's own text and its mapped text -> P7
weak rows of the editions before ``before`` -> J5/J6 against the hierarchy ->
B1 best level -> J9/B2/B3 merge by (year, code).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yearlink.operators import fallback as fb
from yearlink.operators.match import match_year_pair
from yearlink.operators.report import clean_codes
from yearlink.plans.chain import chain_by_description
from yearlink.session import parquet_table

EDGE_COLUMNS = [
    "row_id", "year_n", "year_n1", "item_id_n", "item_id_n1", "code_n", "code_n1", "description_n", "description_n1", "combined",
]


def text_vectors(items: DataFrame) -> DataFrame:
    """One vector for each different text (that of its first item)."""
    return (
        items.filter(F.col("description").isNotNull())
        .groupBy(F.col("description").alias("_text"))
        .agg(F.min_by("embedding", "item_id").alias("_vec"))
    )


def attach_text_vector(rows: DataFrame, vectors: DataFrame, text_col: str, out_col: str) -> DataFrame:
    v = vectors.withColumnRenamed("_vec", out_col)
    return rows.join(v, rows[text_col] == v["_text"], "left").drop("_text")


def clean_edges(edges: DataFrame) -> DataFrame:
    """F11 on both codes of an edge, the older with its year and the newer
    with its own."""
    return clean_codes(clean_codes(edges, "code_n", "year_n"), "code_n1", "year_n1")


def repair(chained: DataFrame, vectors: DataFrame, hierarchy: DataFrame, before: int = 1989) -> DataFrame:
    """From chained rows to the final mapping.  The scored rows are written
    once, without vectors; only weak rows get their vector again."""
    m = attach_text_vector(chained, vectors, "description_n", "v_n")
    m = attach_text_vector(m, vectors, "mapped_2023_description", "v_a")
    scored = m.withColumn("embedding_similarity", fb.pairwise_cosine("v_n", "v_a")).drop("v_n", "v_a")
    scored = parquet_table(scored, "scored")
    weak = scored.filter(fb.low_similarity() & (F.col("year_n") < before))
    matches = fb.hierarchy_match(attach_text_vector(weak, vectors, "description_n", "v_n"), hierarchy, "row_id", "v_n", "year_n")
    return fb.merge_back(scored, fb.best_of_levels(weak, matches))


def final_mapping(items: DataFrame, hierarchy: DataFrame, before: int = 1989, **match_kw) -> DataFrame:
    """The final mapping of every item to the anchor edition."""
    items = parquet_table(items, "items")
    edges = match_year_pair(items, direction="n_to_n1", **match_kw).select(*EDGE_COLUMNS)
    return repair(chain_by_description(clean_edges(edges)), text_vectors(items), hierarchy, before)
