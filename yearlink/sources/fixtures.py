"""Views over the driver's tables (FIXTURES.md section B).

Each view is built from the given parquet tables by Spark, so its size grows
with them.  ``SQL`` holds the same definitions as DuckDB CTE bodies; the
oracle queries in ``__spark_entry__`` are composed from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from yearlink.operators.ranking import blocked_row_number
from yearlink.session import parquet_table

# Fixed values of the B1 view: the 16 editions, both edges of every era plus
# calendar gaps, indexed by p_partkey % 16.
FIXTURE_YEARS = [1789, 1792, 1846, 1861, 1929, 1930, 1932, 1962, 1963, 1975, 1988, 1989, 1990, 2010, 2022, 2023]
# Source labels of the `mapping` view, indexed by l_linenumber % 4.
FIXTURE_SOURCES = ["2023_mapping", "HS6", "HS4", "HS2"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _with_count(df: DataFrame, other: DataFrame, name: str = "_n") -> DataFrame:
    """Attach ``count(*)`` of ``other`` as a column: an equi-join on a constant
    key with the one-row aggregate (broadcast; its size is exactly one row)."""
    cnt = other.agg(F.count(F.lit(1)).alias(name)).withColumn("_one", F.lit(1))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(cnt), "_one").drop("_one")


def _year_case(col: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {y}" for i, y in enumerate(FIXTURE_YEARS))
    return f"CAST(CASE {col} % 16 {whens} END AS INTEGER)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: ``items(item_id, year, code, description, embedding)`` over all
    parts.  The description is the whole brand, type and name of the part and
    the whole first line of a document (a few to thousands of characters);
    parts of equal brand, type and name share line and vector.  One such group
    in 97 has an empty text, one in 89 a zero vector."""
    part = table(spark, sf_dir, "part")
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("line"))
    desc = F.concat_ws(" ", "p_brand", "p_type", "p_name")
    # first key per description: an aggregate joined back (a shuffle on the
    # description), not a window that would sort all rows of a text together
    first = part.groupBy(desc.alias("description")).agg(F.min("p_partkey").alias("first_id"))
    base = part.select(
        F.col("p_partkey").alias("item_id"),
        F.expr(_year_case("p_partkey")).alias("year"),
        F.when(F.col("p_partkey") % 5 == 0, F.lit(None).cast("string"))
        .otherwise(F.lpad((F.col("p_partkey") % 900).cast("string"), 8, "0"))
        .alias("code"),
        desc.alias("description"),
    ).join(first, "description")
    base = _with_count(_with_count(base, emb), docs, "_nd")
    with_line = base.join(docs, F.col("first_id") % F.col("_nd") == F.col("doc_id"), "left")
    text = F.when(F.col("first_id") % 97 == 5, "").otherwise(F.concat_ws(" ", "description", "line"))
    zero = F.transform("embedding", lambda x: F.lit(0.0).cast("float"))
    return with_line.join(emb, F.col("first_id") % F.col("_n") == F.col("vec_id")).select(
        "item_id", "year", "code", text.alias("description"),
        F.when(F.col("first_id") % 89 == 7, zero).otherwise(F.col("embedding")).alias("embedding"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search corpus: as :func:`items`, with the whole brand, type and name
    of the part as description (short by nature) and no zero vectors."""
    part = table(spark, sf_dir, "part")
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    desc = F.concat_ws(" ", "p_brand", "p_type", "p_name")
    first = part.groupBy(desc.alias("description")).agg(F.min("p_partkey").alias("first_id"))
    base = part.select(
        F.col("p_partkey").alias("item_id"),
        F.expr(_year_case("p_partkey")).alias("year"),
        F.when(F.col("p_partkey") % 5 == 0, F.lit(None).cast("string"))
        .otherwise(F.lpad((F.col("p_partkey") % 900).cast("string"), 8, "0"))
        .alias("code"),
        desc.alias("description"),
    ).join(first, "description")
    return _with_count(base, emb).join(emb, F.col("first_id") % F.col("_n") == F.col("vec_id")).select(
        "item_id", "year", "code", "description", "embedding"
    )


def vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec(id, embedding, label)`` over embeddings."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``hierarchy(level, hscode, description, embedding, item_id)``: level 2
    from nation, 4 from supplier, 6 from customer, all rows of each, so the
    levels grow with their tables.  hscode = the key padded to the level."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    levels = [
        (2, "nation", "n_nationkey", F.col("n_name")),
        (4, "supplier", "s_suppkey", F.col("s_name")),
        (6, "customer", "c_custkey", F.concat_ws(" ", "c_mktsegment", "c_name")),
    ]
    rows = None
    for level, name, key, text in levels:
        k = F.col(key).cast("long")
        part = table(spark, sf_dir, name).select(
            F.lit(level).cast("int").alias("level"),
            F.lpad(k.cast("string"), F.greatest(F.lit(level), F.length(k.cast("string"))), "0").alias("hscode"),
            text.alias("description"),
            (k * 10 + level).alias("item_id"),
        )
        rows = part if rows is None else rows.unionByName(part)
    rows = _with_count(rows, emb)
    return rows.join(emb, (F.col("item_id") * 7) % F.col("_n") == F.col("vec_id")).select(
        "level", "hscode", "description", "embedding", "item_id"
    )


def synthetic_edges(spark: SparkSession, sf_dir: str, it: DataFrame | None = None) -> DataFrame:
    """``edges`` independent of J3: node (year, r), r = rank of the item in its
    year; target r1 = (r*7+3) % size of the next year.  Codes and texts are the
    items' own, so repeated texts make the description graph non-functional.
    The item table is read four times below: it is materialised once."""
    it = it if it is not None else parquet_table(items(spark, sf_dir), "items")
    ranked = blocked_row_number(it, "year", "item_id", "r")
    years = it.select("year").distinct()
    nxt = years.withColumn("year_n1", F.lead("year").over(Window.orderBy("year"))).filter(F.col("year_n1").isNotNull())
    sizes = it.groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    src = ranked.join(nxt, "year").join(
        sizes.withColumnRenamed("year", "year_n1").withColumnRenamed("n", "n1"), "year_n1"
    )
    src = src.withColumn("r1", (F.col("r") * 7 + 3) % F.col("n1"))
    tgt = ranked.select(
        F.col("year").alias("year_n1"),
        F.col("r").alias("r1"),
        F.col("item_id").alias("item_id_n1"),
        F.col("code").alias("code_n1"),
        F.col("description").alias("description_n1"),
    )
    e = src.join(tgt, ["year_n1", "r1"])
    score = ((F.col("item_id") * 37 + F.col("item_id_n1") * 11) % 1000) / 1000.0
    return e.select(
        F.col("item_id").alias("row_id"),
        F.col("year").alias("year_n"),
        F.col("year_n1"),
        F.col("item_id").alias("item_id_n"),
        F.col("item_id_n1"),
        F.col("code").alias("code_n"),
        F.col("code_n1"),
        F.col("description").alias("description_n"),
        F.col("description_n1"),
        score.alias("combined"),
    )


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mapping`` over lineitem: a final-mapping-shaped table for reports."""
    li = table(spark, sf_dir, "lineitem")
    src = F.element_at(F.array(*[F.lit(s) for s in FIXTURE_SOURCES]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return li.select(
        F.col("l_orderkey").alias("row_id"),
        F.col("l_linenumber").alias("line"),
        (F.lit(1789) + F.col("l_orderkey") % 235).cast("int").alias("year_n"),
        (F.col("l_discount") * 10 + 0.0).alias("best_match_similarity"),
        (F.col("l_quantity") / 50 + 0.0).alias("combined"),
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast("double"))
        .otherwise(F.col("l_tax") * 12 + 0.0)
        .alias("embedding_similarity"),
        src.alias("best_match_source"),
        F.lpad((F.col("l_partkey") % 97).cast("string"), 2, "0").alias("best_match_code"),
        F.lpad((F.col("l_suppkey") % 97).cast("string"), 2, "0").alias("code_n1"),
    )


def raw_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_codes(year, code)`` over part: codes cycling through float-damaged
    forms by p_partkey % 6 (7 chars, 8 chars, 7+'.0', 8+'.0', 10 digits, NULL)."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    base7 = F.lpad((k % 9000000 + 1000000).cast("string"), 7, "0")
    base8 = (k % 90000000 + 10000000).cast("string")
    code = (
        F.when(k % 6 == 0, base7)
        .when(k % 6 == 1, base8)
        .when(k % 6 == 2, F.concat(base7, F.lit(".0")))
        .when(k % 6 == 3, F.concat(base8, F.lit(".0")))
        .when(k % 6 == 4, (k % 9000000000 + 1000000000).cast("string"))
    )
    return p.select(k.alias("row_id"), (F.lit(1980) + F.col("p_size")).cast("int").alias("year"), code.alias("code"))


def pred_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pred_truth(y_pred, y_true)``: embeddings.label vs vec_id % 10 (10 classes)
    plus labels toxic vs quality (2 classes), as strings."""
    e = table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("y_pred"), (F.col("vec_id") % 10).cast("string").alias("y_true")
    )
    lab = table(spark, sf_dir, "labels").select(
        F.concat(F.lit("t"), F.col("toxic").cast("string")).alias("y_pred"),
        F.concat(F.lit("t"), F.col("quality").cast("string")).alias("y_true"),
    )
    return e.unionByName(lab)


def queries_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``queries_v(query_id, text, embedding)`` over benchmark: the whole text,
    vector ``item_id % n`` of embeddings."""
    b = table(spark, sf_dir, "benchmark")
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    b = _with_count(b, emb)
    return b.join(emb, F.col("item_id") % F.col("_n") == F.col("vec_id")).select(
        F.col("item_id").alias("query_id"), "text", "embedding"
    )


def word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``word_pairs(pair_id, a, b)``: each part name with the next part's name,
    and each benchmark text with the next one (pair_id -1 - item_id).  An
    equi-join on ``key + 1``: linear in the tables, no pair blow-up."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("t"))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("k"), F.col("text").alias("t"))

    def pairs(t: DataFrame, pair_id) -> DataFrame:
        nxt = t.select((F.col("k") - 1).alias("k"), F.col("t").alias("b"))
        return t.join(nxt, "k").select(pair_id.alias("pair_id"), F.col("t").alias("a"), "b")

    return pairs(p, F.col("k")).unionByName(pairs(q, -1 - F.col("k")))


# ------------------------------------------------------------------ DuckDB
_YEAR_SQL = _year_case("p_partkey")
_DESC_SQL = "p_brand || ' ' || p_type || ' ' || p_name"

SQL = {
    "items": f"""
      SELECT d.p_partkey AS item_id,
             {_YEAR_SQL} AS year,
             CASE WHEN d.p_partkey % 5 = 0 THEN NULL
                  ELSE lpad(CAST(d.p_partkey % 900 AS VARCHAR), 8, '0') END AS code,
             CASE WHEN d.first_id % 97 = 5 THEN '' ELSE concat_ws(' ', d.description, l.line) END AS description,
             CASE WHEN d.first_id % 89 = 7 THEN list_transform(e.embedding, lambda x: 0::FLOAT) ELSE e.embedding END AS embedding
      FROM (SELECT p_partkey, {_DESC_SQL} AS description,
                   min(p_partkey) OVER (PARTITION BY {_DESC_SQL}) AS first_id
            FROM part) d
      JOIN embeddings e ON e.vec_id = d.first_id % (SELECT count(*) FROM embeddings)
      LEFT JOIN (SELECT doc_id, split_part(text, chr(10), 1) AS line FROM documents) l
             ON l.doc_id = d.first_id % (SELECT count(*) FROM documents)""",
    "catalog": f"""
      SELECT d.p_partkey AS item_id, {_YEAR_SQL} AS year,
             CASE WHEN d.p_partkey % 5 = 0 THEN NULL
                  ELSE lpad(CAST(d.p_partkey % 900 AS VARCHAR), 8, '0') END AS code,
             d.description, e.embedding
      FROM (SELECT p_partkey, {_DESC_SQL} AS description,
                   min(p_partkey) OVER (PARTITION BY {_DESC_SQL}) AS first_id
            FROM part) d
      JOIN embeddings e ON e.vec_id = d.first_id % (SELECT count(*) FROM embeddings)""",
    "hierarchy": """
      SELECT h.level, lpad(CAST(h.k AS VARCHAR), CAST(greatest(h.level, length(CAST(h.k AS VARCHAR))) AS INTEGER), '0') AS hscode,
             h.description, e.embedding, h.k * 10 + h.level AS item_id
      FROM (SELECT CAST(2 AS INTEGER) AS level, CAST(n_nationkey AS BIGINT) AS k, n_name AS description FROM nation
            UNION ALL SELECT 4, s_suppkey, s_name FROM supplier
            UNION ALL SELECT 6, c_custkey, c_mktsegment || ' ' || c_name FROM customer) h
      JOIN embeddings e ON e.vec_id = ((h.k * 10 + h.level) * 7) % (SELECT count(*) FROM embeddings)""",
    "mapping": f"""
      SELECT l_orderkey AS row_id, l_linenumber AS line,
             CAST(1789 + l_orderkey % 235 AS INTEGER) AS year_n,
             l_discount * 10 + 0.0 AS best_match_similarity,
             l_quantity / 50 + 0.0 AS combined,
             CASE WHEN l_linenumber = 7 THEN NULL ELSE l_tax * 12 + 0.0 END AS embedding_similarity,
             CASE l_linenumber % 4 {" ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(FIXTURE_SOURCES))} END
               AS best_match_source,
             lpad(CAST(l_partkey % 97 AS VARCHAR), 2, '0') AS best_match_code,
             lpad(CAST(l_suppkey % 97 AS VARCHAR), 2, '0') AS code_n1
      FROM lineitem""",
    "raw_codes": """
      SELECT p_partkey AS row_id, CAST(1980 + p_size AS INTEGER) AS year,
             CASE p_partkey % 6
               WHEN 0 THEN lpad(CAST(p_partkey % 9000000 + 1000000 AS VARCHAR), 7, '0')
               WHEN 1 THEN CAST(p_partkey % 90000000 + 10000000 AS VARCHAR)
               WHEN 2 THEN lpad(CAST(p_partkey % 9000000 + 1000000 AS VARCHAR), 7, '0') || '.0'
               WHEN 3 THEN CAST(p_partkey % 90000000 + 10000000 AS VARCHAR) || '.0'
               WHEN 4 THEN CAST(p_partkey % 9000000000 + 1000000000 AS VARCHAR)
             END AS code
      FROM part""",
    "pred_truth": """
      SELECT CAST(label AS VARCHAR) AS y_pred, CAST(vec_id % 10 AS VARCHAR) AS y_true FROM embeddings
      UNION ALL
      SELECT 't' || CAST(toxic AS VARCHAR), 't' || CAST(quality AS VARCHAR) FROM labels""",
    "queries_v": """
      SELECT b.item_id AS query_id, b.text, e.embedding
      FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id % (SELECT count(*) FROM embeddings)""",
    "word_pairs": """
      SELECT l.p_partkey AS pair_id, l.p_name AS a, r.p_name AS b
      FROM part l JOIN part r ON r.p_partkey = l.p_partkey + 1
      UNION ALL
      SELECT -1 - l.item_id, l.text, r.text FROM benchmark l JOIN benchmark r ON r.item_id = l.item_id + 1""",
    "synthetic_edges": """
      SELECT s.item_id AS row_id, s.year AS year_n, s.year_n1, s.item_id AS item_id_n, t.item_id AS item_id_n1,
             s.code AS code_n, t.code AS code_n1, s.description AS description_n, t.description AS description_n1,
             ((s.item_id * 37 + t.item_id * 11) % 1000) / 1000.0 AS combined
      FROM (SELECT i.*, row_number() OVER (PARTITION BY i.year ORDER BY i.item_id) - 1 AS r, y.year_n1,
                   (SELECT count(*) FROM items i2 WHERE i2.year = y.year_n1) AS n1
            FROM items i JOIN (SELECT year, lead(year) OVER (ORDER BY year) AS year_n1
                               FROM (SELECT DISTINCT year FROM items)) y ON i.year = y.year
            WHERE y.year_n1 IS NOT NULL) s
      JOIN (SELECT i.*, row_number() OVER (PARTITION BY i.year ORDER BY i.item_id) - 1 AS r FROM items i) t
        ON t.year = s.year_n1 AND t.r = (s.r * 7 + 3) % s.n1""",
}

# Dependencies between the CTEs above (each needs these defined first).
_DEPS = {
    "synthetic_edges": ["items"],
}


def with_views(*names: str, recursive: bool = False) -> str:
    """``WITH`` clause defining the named views (and what they depend on)."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in _DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{n} AS ({SQL[n]})" for n in order) + "\n"
