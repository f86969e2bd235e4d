"""Scans and sinks.

Everything reads with an explicit schema (no inference) and writes parquet
or CSV partitioned by the year pair, so restarts and incremental runs work
at the partition level.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yearlink.session import ensure_checkpoint_dir, ship_package
from yearlink.sources.split_csv import scan_split_csv

# Column layout of the yearly item CSV (fixed: the sample file's header).
ITEM_CSV_COLUMNS = [
    ("2025_hs4", T.StringType()), ("year", T.IntegerType()), ("hs", T.StringType()),
    ("brief_description", T.StringType()), ("mfn_ad_val_rate", T.DoubleType()),
    ("mfn_specific_rate", T.DoubleType()), ("unit_1", T.StringType()), ("unit_2", T.StringType()),
    ("quantity_1_code", T.StringType()), ("quantity_2_code", T.StringType()),
    ("description_1", T.StringType()), ("duty_1", T.StringType()), ("description_2", T.StringType()),
    ("duty_2", T.StringType()), ("description_3", T.StringType()), ("duty_3", T.StringType()),
    ("description_4", T.StringType()), ("duty_4", T.StringType()), ("country_1", T.StringType()),
    ("country_2", T.StringType()), ("country_3", T.StringType()), ("country_duty_1", T.StringType()),
    ("country_duty_2", T.StringType()), ("country_duty_3", T.StringType()), ("country_desc", T.StringType()),
    ("country_codes", T.StringType()), ("mfn_other_rate", T.StringType()), ("mfn_rate_type_code", T.StringType()),
    ("index", T.LongType()),
]
ITEM_CSV_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in ITEM_CSV_COLUMNS])


# The CSV dialect, for readers and for ``from_csv``.
DIALECT = {
    "nullValue": "NA", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def _csv(spark: SparkSession, schema: T.StructType, multi_line: bool = True):
    """Reader of the CSV dialect.  With ``multi_line`` a quoted text may hold
    line breaks, but one task reads a whole file; without it a large file is
    split over many tasks."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .options(**DIALECT)
        .option("emptyValue", None)
        .option("multiLine", multi_line)
    )


def scan_items(
    spark: SparkSession, path: str, schema: T.StructType = ITEM_CSV_SCHEMA, multi_line: bool = True, split: bool = False
) -> DataFrame:
    """The all-years item CSV with a declared schema.  For one large file
    pass ``multi_line=False`` if its texts hold no line breaks, or ``split=True``
    if they may (see :mod:`yearlink.sources.split_csv`)."""
    if split:
        return scan_split_csv(spark, path, schema, DIALECT)
    return _csv(spark, schema, multi_line).csv(path)


def scan_items_str(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Same, every column (or the given ones) as string."""
    names = columns or [n for n, _ in ITEM_CSV_COLUMNS]
    return _csv(spark, T.StructType([T.StructField(n, T.StringType(), True) for n in names])).csv(path)


def scan_xlsx(spark: SparkSession, path: str, columns: list[str], sheet: str | None = None) -> DataFrame:
    """Rows of workbooks (a file, folder or pattern), all strings, by the
    names of the first row of ``sheet`` (default: the first sheet).  Spark
    reads the files, on any file system, a task for some workbooks each."""
    from yearlink.sources.xlsx import rows_of_books

    ship_package(spark)
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
    books = spark.read.format("binaryFile").load(path).select("path", "content")
    return books.mapInArrow(rows_of_books(columns, sheet), schema)


def project_items(df: DataFrame) -> DataFrame:
    """P1 + P2: ``year, hs, brief_description`` -> canonical item columns,
    rows with a NULL description dropped; ``index`` becomes ``item_id``."""
    return df.filter(F.col("brief_description").isNotNull()).select(
        F.col("index").cast("long").alias("item_id"),
        F.col("year").cast("int").alias("year"),
        F.col("hs").cast("string").alias("code"),
        F.col("brief_description").cast("string").alias("description"),
    )


def scan_hierarchy(spark: SparkSession, path: str, level: int | None = None) -> DataFrame:
    """S3: hierarchy CSV read as strings, optionally one level."""
    schema = T.StructType([T.StructField(n, T.StringType(), True) for n in ("level", "hscode", "description")])
    df = _csv(spark, schema).csv(path).withColumn("level", F.col("level").cast("int"))
    return df.filter(F.col("level") == level) if level is not None else df


def scan_year_vectors(spark: SparkSession, path: str, years: list[int] | None = None) -> DataFrame:
    """Vectors stored as parquet partitioned by ``year``; the year filter
    prunes partitions.  Rows are keyed by ``item_id`` (never by position)."""
    df = spark.read.parquet(path)
    return df.filter(F.col("year").isin(*years)) if years else df


def check_alignment(items: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per year, items without a vector and vectors without an item
    (full outer join on the key).  A year with any one-sided row is flagged."""
    a = items.select("item_id", F.col("year").alias("iy"), F.lit(1).alias("i"))
    b = vectors.select("item_id", F.col("year").alias("vy"), F.lit(1).alias("v"))
    j = a.join(b, "item_id", "full_outer").select(
        F.coalesce("iy", "vy").alias("year"), F.col("i").isNotNull().alias("has_item"), F.col("v").isNotNull().alias("has_vec")
    )
    return j.groupBy("year").agg(
        F.count_if(F.col("has_item") & ~F.col("has_vec")).alias("items_without_vector"),
        F.count_if(~F.col("has_item") & F.col("has_vec")).alias("vectors_without_item"),
    ).withColumn("aligned", (F.col("items_without_vector") == 0) & (F.col("vectors_without_item") == 0))


def scan_pair_files(
    spark: SparkSession, path: str, schema: T.StructType | None = None, pattern: str = "mapped_*_*.csv", split: bool = False
) -> DataFrame:
    """S6 + U0: read every ``mapped_{a}_{b}.csv`` under a folder at once and
    tag each row with the two years taken from its file path (file name or a
    ``pair=mapped_{a}_{b}`` folder); missing pairs simply do not appear.
    Output: ``from_year, to_year`` + the file's columns (all strings unless a
    schema is given: no inference).  ``split`` (needs a schema) reads large
    files with several tasks each."""
    where = path.rstrip("/") + "/" + pattern
    years = [(1, "from_year"), (2, "to_year")]
    if split:
        if schema is None:
            raise ValueError("split needs a schema")
        df = scan_split_csv(spark, where, schema, {"escape": '"'}, file_column="_file")
        return df.select(*[F.regexp_extract("_file", r"mapped_(\d+)_(\d+)", i).cast("int").alias(y) for i, y in years], *schema.names)
    r = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", False)
    df = r.csv(where)
    name = F.col("_metadata.file_path")
    return df.select(*[F.regexp_extract(name, r"mapped_(\d+)_(\d+)", i).cast("int").alias(y) for i, y in years], *df.columns)


# Published pair files (fixed: names and order of their columns).  Forward files
# label the older item HS_N1, reverse files the newer one.
PUBLISHED_SCORES = ["Cosine_Similarity", "Jaccard_Similarity", "Levenshtein_Similarity", "Combined_Similarity"]
_PUBLISHED_NAMES = ["HS_N1", "Description_N1", "Mapped_HS", "Mapped_Description"]
PUBLISHED = {
    ("year_n", "year_n1"): list(zip(["code_n", "description_n", "code_n1", "description_n1"], _PUBLISHED_NAMES, strict=True)),
    ("year_n1", "year_n"): list(zip(["code_n1", "description_n1", "code_n", "description_n"], _PUBLISHED_NAMES, strict=True)),
}
CANONICAL = [
    "from_year", "to_year", "year_N", "year_N1", "HS_N", "HS_N1", *PUBLISHED_SCORES, "Description_N", "Description_N1",
]


def rename_direction(pairs: DataFrame, direction: str) -> DataFrame:
    """P5: name both items of a published pair by their age (N older, N1
    newer) and give each its year."""
    older = "HS_N1", "Description_N1", "from_year"
    newer = "Mapped_HS", "Mapped_Description", "to_year"
    if direction == "reverse":
        older, newer = newer, older
    elif direction != "forward":
        raise ValueError("direction must be forward or reverse")
    rest = [c for c in pairs.columns if c not in _PUBLISHED_NAMES]
    return pairs.select(
        *rest,
        *[F.col(c).alias(n) for c, n in zip(older, ("HS_N", "Description_N", "year_N"), strict=True)],
        *[F.col(c).alias(n) for c, n in zip(newer, ("HS_N1", "Description_N1", "year_N1"), strict=True)],
    )


def load_pairs(spark: SparkSession, path: str, direction: str, pattern: str = "mapped_*_*.csv") -> DataFrame:
    """S6 + U0 -> P5 -> F11 on both codes, each with its own year -> P6: the
    12 canonical columns of a folder of published pair files."""
    from yearlink.operators.report import clean_codes

    schema = T.StructType(
        [T.StructField(c, T.StringType()) for c in _PUBLISHED_NAMES] + [T.StructField(c, T.DoubleType()) for c in PUBLISHED_SCORES]
    )
    edges = rename_direction(scan_pair_files(spark, path, schema, pattern), direction)
    edges = clean_codes(clean_codes(edges, "HS_N", "year_N"), "HS_N1", "year_N1")
    return edges.select(*CANONICAL)


def scan_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A saved intermediate (parquet)."""
    return spark.read.parquet(path)


def sink_pairs(edges: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per year pair; dynamic partition overwrite replaces only
    the pairs present in ``edges`` (idempotent restart)."""
    (
        edges.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year_n", "year_n1")
        .format(fmt)
        .option("header", True)
        .save(path)
    )


def sink_snapshot(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Save a result table."""
    w = df.write.mode("overwrite").format(fmt).option("header", True)
    if fmt == "csv":
        # keep outer blanks of descriptions: the Indel score strips them itself
        w = w.option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    w.save(path)


def done_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Year pairs already present in a pair sink.  Only a sink that is not
    there yet (or has no file) counts as empty; other errors are errors."""
    try:
        return spark.read.parquet(path).select("year_n", "year_n1").distinct()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], "year_n int, year_n1 int")


def drop_pair(spark: SparkSession, path: str, year_n: int, year_n1: int) -> None:
    """Delete the folder of one year pair from a pair sink."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/year_n={year_n}/year_n1={year_n1}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def resume_pairs(spark: SparkSession, pairs: DataFrame, path: str) -> DataFrame:
    """The pairs still to do = ``pairs`` left-anti the finished ones."""
    return pairs.join(done_pairs(spark, path), ["year_n", "year_n1"], "left_anti")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's (shared) checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/yearlink-io/{name}-{uuid.uuid4().hex}"
