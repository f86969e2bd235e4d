"""Canonical table schemas (explicit, never inferred)."""

from pyspark.sql import types as T

VECTOR = T.ArrayType(T.FloatType(), containsNull=False)

ITEMS = T.StructType(
    [
        T.StructField("item_id", T.LongType(), False),
        T.StructField("year", T.IntegerType(), False),
        T.StructField("code", T.StringType(), True),
        T.StructField("description", T.StringType(), True),
    ]
)

VECTORS = T.StructType(
    [
        T.StructField("item_id", T.LongType(), False),
        T.StructField("year", T.IntegerType(), False),
        T.StructField("embedding", VECTOR, True),
    ]
)

HIERARCHY = T.StructType(
    [
        T.StructField("level", T.IntegerType(), False),
        T.StructField("hscode", T.StringType(), False),
        T.StructField("description", T.StringType(), True),
        T.StructField("embedding", VECTOR, True),
    ]
)

# The four score columns every edge carries, in output order.
SCORE_COLUMNS = ["cosine", "jaccard", "levenshtein", "combined"]

EDGE_COLUMNS = [
    "row_id",
    "year_n",
    "year_n1",
    "item_id_n",
    "item_id_n1",
    "code_n",
    "code_n1",
    "description_n",
    "description_n1",
    *SCORE_COLUMNS,
]

EDGES = T.StructType(
    [
        T.StructField("row_id", T.LongType(), False),
        T.StructField("year_n", T.IntegerType(), False),
        T.StructField("year_n1", T.IntegerType(), False),
        T.StructField("item_id_n", T.LongType(), True),
        T.StructField("item_id_n1", T.LongType(), True),
        T.StructField("code_n", T.StringType(), True),
        T.StructField("code_n1", T.StringType(), True),
        T.StructField("description_n", T.StringType(), True),
        T.StructField("description_n1", T.StringType(), True),
        T.StructField("cosine", T.DoubleType(), True),
        T.StructField("jaccard", T.DoubleType(), True),
        T.StructField("levenshtein", T.DoubleType(), True),
        T.StructField("combined", T.DoubleType(), True),
    ]
)

MAPPING_EXTRA = [
    "mapped_2023_code",
    "mapped_2023_description",
    "embedding_similarity",
    "best_match_code",
    "best_match_similarity",
    "best_match_description",
    "best_match_source",
]
