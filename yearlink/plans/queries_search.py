"""Registered queries: search (Q1-Q4), corpus (S12-S15), encoder (U1), I/O."""

from __future__ import annotations

from pyspark.sql import functions as F

from yearlink.functions.vectors import embed_texts, token_vectors
from yearlink.operators.match import adjacent_pairs
from yearlink.plans.queries_match import JAC_SQL, NORM_SQL, TOKENS_SQL
from yearlink.operators.ann import build_ivf, search_ivf
from yearlink.plans.index import build_index, open_index, search_index, verify_index
from yearlink.plans.registry import register, round_doubles
from yearlink.plans.search import corpus_info, flat_index_search, format_results, prepare_corpus, search, search_text, verify_corpus
from yearlink.sources import fixtures as fx
from yearlink.sources import io
from yearlink.sources.fixtures import with_views
from yearlink.sources.split_csv import scan_split_csv

COSQ = (
    "COALESCE(round(CASE WHEN q.norm * c.norm > 0 THEN "
    "list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) / (q.norm * c.norm) END, 9), 0.0)"
)


def _search_sql(top_k: int, rerank: bool) -> str:
    n_cand = 10 * top_k if rerank else top_k
    head = with_views("catalog", "queries_v", recursive=True) + f""",
  c AS (SELECT item_id, year, code, description, embedding, {NORM_SQL.format(v='embedding')} AS norm FROM catalog),
  q AS (SELECT query_id, text, embedding, {NORM_SQL.format(v='embedding')} AS norm FROM queries_v),
  cand AS (SELECT q.query_id, c.item_id, {COSQ} AS cos, q.text, c.description, c.year, c.code FROM q CROSS JOIN c),
  top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, item_id) AS k FROM cand)
          WHERE k <= {n_cand})"""
    if not rerank:
        body = """,
  sc AS (SELECT *, CAST(0.0 AS DOUBLE) AS jac, CAST(0.0 AS DOUBLE) AS lev, cos AS comb FROM top)"""
    else:
        body = f""",
  sc0 AS (SELECT *, description IS NOT NULL AND description <> '' AS has_desc,
                 {JAC_SQL.format(a=TOKENS_SQL.format(x='text'), b=TOKENS_SQL.format(x='description'))} AS jac0,
                 lower(text) AS la, lower(description) AS lb FROM top),
  dp AS (
    SELECT query_id, item_id, la AS a, lb AS b, 0 AS i, list_transform(range(length(lb) + 1), lambda j: 0) AS row
    FROM sc0 WHERE has_desc
    UNION ALL
    SELECT query_id, item_id, a, b, i + 1,
           list_reduce(list_transform(range(1, length(b) + 1), lambda j: j),
             lambda acc, j: list_append(acc,
                 CASE WHEN substr(a, i + 1, 1) = substr(b, j, 1) THEN row[j] + 1
                      ELSE greatest(row[j + 1], acc[j]) END),
             [0])
    FROM dp WHERE i < length(a)),
  lcs AS (SELECT query_id, item_id, row[length(b) + 1] AS l FROM dp WHERE i = length(a)),
  sc AS (SELECT s.*, CASE WHEN has_desc THEN jac0 ELSE 0.0 END AS jac,
                CASE WHEN NOT has_desc THEN 0.0 WHEN length(la) + length(lb) = 0 THEN 1.0
                     ELSE 2.0 * lcs.l / (length(la) + length(lb)) END AS lev,
                CASE WHEN has_desc THEN 0.7 * cos + 0.2 * jac0 + 0.1 * (CASE WHEN length(la) + length(lb) = 0 THEN 1.0
                     ELSE 2.0 * lcs.l / (length(la) + length(lb)) END) ELSE cos END AS comb
         FROM sc0 s LEFT JOIN lcs USING (query_id, item_id))"""
    return head + body + f"""
SELECT query_id, CAST(rank AS INTEGER) AS rank, comb AS combined_similarity, cos AS cosine_similarity,
       jac AS jaccard_similarity, lev AS levenshtein_similarity, item_id, year, code, description
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY comb DESC, cos DESC, item_id) AS rank FROM sc)
WHERE rank <= {top_k}"""


def _corpus(spark, sf):
    return fx.catalog(spark, sf)


@register("search", _search_sql(5, True))
def q_search(spark, sf):
    """Q1/Q3: batch search of the benchmark queries over the item corpus,
    top 5 after reranking 50 cosine candidates."""
    return search(fx.queries_v(spark, sf), _corpus(spark, sf), top_k=5)


@register("search_no_rerank", _search_sql(5, False))
def q_search_no_rerank(spark, sf):
    """Q2: cosine order only (jaccard = indel = 0, combined = cosine)."""
    return search(fx.queries_v(spark, sf), _corpus(spark, sf), top_k=5, rerank=False)


@register("batch_search", _search_sql(20, True))
def q_batch_search(spark, sf):
    """Q3: many queries in one job, top 20 each (200 candidates)."""
    return search(fx.queries_v(spark, sf), _corpus(spark, sf), top_k=20)


@register(
    "flat_index",
    with_views("queries_v")
    + f""",
  q AS (SELECT query_id, embedding, {NORM_SQL.format(v='embedding')} AS norm FROM queries_v),
  c AS (SELECT vec_id AS id, embedding, {NORM_SQL.format(v='embedding')} AS norm FROM embeddings)
SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM
  (SELECT q.query_id, c.id, {COSQ} AS score,
          row_number() OVER (PARTITION BY q.query_id ORDER BY {COSQ} DESC, c.id) AS rank
   FROM q CROSS JOIN c) WHERE rank <= 10""",
)
def q_flat_index(spark, sf):
    """Q4: exact inner-product top 10 over the unit vectors of `embeddings`."""
    return flat_index_search(fx.queries_v(spark, sf), fx.vec(spark, sf), 10)


@register("flat_index_approx")
def q_flat_index_approx(spark, sf):
    """Q4, approximate: inverted file over the unit vectors of `embeddings`,
    top 10, lists for a recall of 0.95 (measured against the exact search in
    the tests)."""
    path = io.scratch_path(spark, "ivf")
    build_ivf(fx.vec(spark, sf), path)
    return search_ivf(spark, fx.queries_v(spark, sf), path, 10)


@register(
    "corpus_info",
    with_views("catalog")
    + "SELECT count(*) AS n_items, CAST(max(len(embedding)) AS INTEGER) AS embedding_dim, "
    "'item_id,year,code,description' AS columns FROM catalog",
)
def q_corpus_info(spark, sf):
    """S12 + S13: corpus prepared from the items, then its info row."""
    c = prepare_corpus(_corpus(spark, sf), "embedding")
    return corpus_info(c)


@register(
    "verify_corpus",
    with_views("catalog")
    + """SELECT count(*) AS n_items,
       count(*) FILTER (WHERE embedding IS NOT NULL AND len(embedding) <> (SELECT max(len(embedding)) FROM catalog)) AS n_bad_dim,
       count(*) FILTER (WHERE embedding IS NULL) AS n_missing FROM catalog""",
)
def q_verify_corpus(spark, sf):
    """Corpus consistency counts (all zero when sound)."""
    return verify_corpus(prepare_corpus(_corpus(spark, sf), "embedding"))


@register(
    "format_results",
    "SELECT query_id, rank, printf('%d. [%.4f] %s', rank, floor(round(combined_similarity, 9) * 10000 + 0.5) / 10000.0::DOUBLE, description) AS line FROM ("
    + _search_sql(5, True)
    + ")",
)
def q_format_results(spark, sf):
    """Search results as text lines."""
    return format_results(search(fx.queries_v(spark, sf), _corpus(spark, sf), top_k=5), "text")


def _token_vectors_sql(name: str, source: str, text: str) -> str:
    """CTEs for ``name(txt, embedding)``: the token vectors of a text column."""
    h = "('0x' || substr(md5(tok), 1, 8))::BIGINT"
    return f"""
  {name}_t AS (SELECT DISTINCT coalesce({text}, '') AS txt FROM {source}),
  {name}_s AS (SELECT txt, {h} % 64 AS s, sum(CASE WHEN {h} % 128 >= 64 THEN 1.0::DOUBLE ELSE -1.0 END) AS v
               FROM (SELECT txt, unnest(string_split_regex(lower(txt), '\\s+')) AS tok FROM {name}_t) WHERE tok <> '' GROUP BY ALL),
  {name}_n AS (SELECT txt, sqrt(sum(v * v)) AS n FROM {name}_s GROUP BY txt),
  {name} AS (SELECT t.txt, list(CAST(coalesce(CASE WHEN n.n > 0 THEN s.v / n.n END, 0.0) AS FLOAT) ORDER BY r.s) AS embedding
             FROM {name}_t t CROSS JOIN (SELECT unnest(range(0, 64)) AS s) r
             LEFT JOIN {name}_s s ON s.txt = t.txt AND s.s = r.s LEFT JOIN {name}_n n ON n.txt = t.txt GROUP BY t.txt)"""


_EMBEDDED_SQL = with_views("items") + "," + _token_vectors_sql("tv", "items", "description") + """
SELECT item_id, CAST(i - 1 AS INTEGER) AS slot, round(CAST(x AS DOUBLE), 6) AS value FROM (
  SELECT item_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i
  FROM (SELECT item_id, description FROM items) JOIN tv ON txt = coalesce(description, ''))
WHERE x <> 0"""


@register("embed_items", _EMBEDDED_SQL)
def q_embed_items(spark, sf):
    """Each distinct description encoded once by the pluggable batch
    encoder (default: hashed tokens, 64 dims): non-zero slots."""
    e = embed_texts(fx.items(spark, sf).select("item_id", "description"), "description", "vec")
    return round_doubles(e.select("item_id", F.posexplode("vec").alias("slot", "value")).filter("value <> 0"), 6)


@register("embed_token_vectors", _EMBEDDED_SQL)
def q_embed_token_vectors(spark, sf):
    """U1 in the JVM: non-zero slots of each item's token vector."""
    e = token_vectors(fx.items(spark, sf).select("item_id", "description"), "description", "vec")
    return round_doubles(
        e.select("item_id", F.posexplode("vec").alias("slot", "value")).filter("value <> 0"), 6
    )


@register(
    "search_text",
    _search_sql(5, True).replace(
        "  c AS (SELECT item_id, year, code, description, embedding,",
        _token_vectors_sql("tvi", "catalog", "description").lstrip("\n") + "," + _token_vectors_sql("tvq", "queries_v", "text")
        + ",\n  ie AS (SELECT i.* REPLACE (t.embedding AS embedding) FROM catalog i JOIN tvi t ON t.txt = i.description),"
        + "\n  qe AS (SELECT q.* REPLACE (t.embedding AS embedding) FROM queries_v q JOIN tvq t ON t.txt = q.text),"
        + "\n  c AS (SELECT item_id, year, code, description, embedding,",
    ).replace("AS norm FROM catalog),", "AS norm FROM ie),").replace("AS norm FROM queries_v),", "AS norm FROM qe),"),
)
def q_search_text(spark, sf):
    """Q1 from text: query strings and corpus encoded alike, then searched."""
    return search_text(fx.queries_v(spark, sf).select("query_id", "text"), _corpus(spark, sf), top_k=5)


@register("search_indexed", _search_sql(5, True))
def q_search_indexed(spark, sf):
    """The corpus written once as an index, opened by its path, checked
    against its info row and searched without work on the corpus texts."""
    path = io.scratch_path(spark, "index")
    build_index(_corpus(spark, sf), path)
    index = open_index(spark, path, check=True)
    return search_index(fx.queries_v(spark, sf), index, top_k=5)


@register(
    "verify_index",
    with_views("catalog")
    + "SELECT count(*) AS n_items, count(*) AS n_items_info, CAST(max(len(embedding)) AS INTEGER) AS embedding_dim, "
    "0::BIGINT AS n_bad_dim, 0::BIGINT AS n_missing, true AS same_ids, true AS same_vectors, true AS same_texts FROM catalog",
)
def q_verify_index(spark, sf):
    """A stored index against its own info row."""
    path = io.scratch_path(spark, "index")
    build_index(_corpus(spark, sf), path)
    return verify_index(spark, path)


# ------------------------------------------------------------------ I/O
@register(
    "sink_scan_pairs",
    with_views("synthetic_edges") + "SELECT row_id, year_n, year_n1, code_n, code_n1, combined FROM synthetic_edges",
)
def q_sink_scan_pairs(spark, sf):
    """S9 + S8 + U0: write edges partitioned by year pair into the shared
    scratch folder, read them back (all pairs stacked)."""
    path = io.scratch_path(spark, "pairs")
    io.sink_pairs(fx.synthetic_edges(spark, sf).select("row_id", "year_n", "year_n1", "code_n", "code_n1", "combined"), path)
    return io.scan_snapshot(spark, path).select("row_id", "year_n", "year_n1", "code_n", "code_n1", "combined")


@register(
    "resume_pairs",
    with_views("items")
    + """SELECT year_n, year_n1 FROM (SELECT year AS year_n, lead(year) OVER (ORDER BY year) AS year_n1
         FROM (SELECT DISTINCT year FROM items)) WHERE year_n1 IS NOT NULL AND year_n >= 1963""",
)
def q_resume_pairs(spark, sf):
    """Pairs left to do after the pairs before 1963 were written."""
    it = fx.items(spark, sf)
    pairs = adjacent_pairs(it)
    path = io.scratch_path(spark, "resume")
    edges = fx.synthetic_edges(spark, sf).filter(F.col("year_n") < 1963).select("row_id", "year_n", "year_n1")
    io.sink_pairs(edges, path)
    return io.resume_pairs(spark, pairs, path)


@register(
    "scan_items_csv",
    with_views("items")
    + "SELECT year, count(*) AS n_items, count(code) AS n_codes FROM items WHERE nullif(description, '') IS NOT NULL GROUP BY year",  # an empty CSV field is missing
)
def q_scan_items_csv(spark, sf):
    """S1 + S2 + P1 + P2: items written as the 29-column CSV layout, read
    back with the declared schema, projected and cleaned."""
    it = fx.items(spark, sf)
    wide = it.select(
        *[
            (F.col("year") if n == "year" else F.col("code") if n == "hs" else F.col("description") if n == "brief_description"
             else F.col("item_id") if n == "index" else F.lit(None).cast(t)).alias(n)
            for n, t in io.ITEM_CSV_COLUMNS
        ]
    )
    path = io.scratch_path(spark, "items_csv")
    io.sink_snapshot(wide, path, "csv")
    back = io.project_items(io.scan_items(spark, path))
    return back.groupBy("year").agg(F.count(F.lit(1)).alias("n_items"), F.count("code").alias("n_codes"))


@register(
    "scan_split_csv",
    # an empty CSV field and the missing value mark are missing
    """SELECT doc_id, lang, length(t) AS n_chars, md5(t) AS digest
FROM (SELECT doc_id, lang, CASE WHEN text IN ('', 'NA') THEN NULL ELSE text END AS t FROM documents)""",
)
def q_scan_split_csv(spark, sf):
    """S1/S6 split scan: all documents as CSV, texts with line breaks and
    quotes, read back by several tasks a file."""
    docs = fx.table(spark, sf, "documents").select("doc_id", "lang", "text")
    path = io.scratch_path(spark, "documents_csv")
    io.sink_snapshot(docs, path, "csv")
    back = scan_split_csv(spark, path, docs.schema, io.DIALECT)
    return back.select("doc_id", "lang", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@register(
    "check_alignment",
    with_views("items")
    + """SELECT coalesce(i.year, CAST(NULL AS INTEGER)) AS year,
       count(*) FILTER (WHERE i.item_id IS NOT NULL AND e.vec_id IS NULL) AS items_without_vector,
       count(*) FILTER (WHERE i.item_id IS NULL AND e.vec_id IS NOT NULL) AS vectors_without_item,
       (count(*) FILTER (WHERE i.item_id IS NOT NULL AND e.vec_id IS NULL) = 0
        AND count(*) FILTER (WHERE i.item_id IS NULL AND e.vec_id IS NOT NULL) = 0) AS aligned
FROM items i FULL OUTER JOIN (SELECT vec_id FROM embeddings) e ON e.vec_id = i.item_id
GROUP BY 1""",
)
def q_check_alignment(spark, sf):
    """Items vs a vector table keyed by id (the raw embeddings table):
    one-sided rows per year."""
    vecs = fx.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.lit(None).cast("int").alias("year")
    )
    return io.check_alignment(fx.items(spark, sf), vecs)


@register(
    "scan_pair_files",
    with_views("synthetic_edges")
    + """SELECT year_n1 AS from_year, year_n AS to_year, count(*) AS n_rows,
       count(code_n) AS n_codes FROM synthetic_edges GROUP BY year_n1, year_n""",
)
def q_scan_pair_files(spark, sf):
    """Reverse-style pair files ``mapped_{N1}_{N}`` written as CSV, then
    read back in one scan with the years parsed from the file paths."""
    e = fx.synthetic_edges(spark, sf).select(
        F.concat(F.lit("mapped_"), F.col("year_n1").cast("string"), F.lit("_"), F.col("year_n").cast("string")).alias("pair"),
        F.col("code_n").alias("HS_N"), F.col("description_n").alias("Description_N"),
    )
    path = io.scratch_path(spark, "pair_files")
    e.write.mode("overwrite").partitionBy("pair").option("header", True).option("escape", '"').csv(path)
    back = io.scan_pair_files(spark, path, pattern="pair=mapped_*/*.csv")
    return back.groupBy("from_year", "to_year").agg(F.count(F.lit(1)).alias("n_rows"), F.count("HS_N").alias("n_codes"))


def _pair_files(spark, edges, path, names):
    """Write edges as published pair files, one folder for each pair."""
    a, b = names
    edges.select(
        F.concat(F.lit("mapped_"), F.col(a).cast("string"), F.lit("_"), F.col(b).cast("string")).alias("pair"),
        *[F.col(src).alias(dst) for src, dst in io.PUBLISHED[(a, b)]],
        *[F.col("combined").alias(c) for c in io.PUBLISHED_SCORES],
    ).write.partitionBy("pair").option("header", True).option("escape", '"').csv(path)


def _load_pairs_sql(frm: str, to: str) -> str:
    nf = lambda c: f"CASE WHEN length({c}) > 8 AND {c} LIKE '%.0' THEN substr({c}, 1, length({c}) - 2) ELSE {c} END"
    code = lambda c, y: f"CASE WHEN {y} >= 1989 AND length({nf(c)}) = 7 THEN '0' || {nf(c)} WHEN {y} >= 1989 THEN {nf(c)} ELSE {c} END"
    keep = lambda c, y: f"NOT ({y} >= 1989 AND coalesce(length({nf(c)}), 0) >= 10)"
    return with_views("synthetic_edges") + f"""SELECT {frm} AS from_year, {to} AS to_year, year_n AS "year_N", year_n1 AS "year_N1",
  {code('code_n', 'year_n')} AS "HS_N", {code('code_n1', 'year_n1')} AS "HS_N1",
  combined AS "Cosine_Similarity", combined AS "Jaccard_Similarity", combined AS "Levenshtein_Similarity",
  combined AS "Combined_Similarity", nullif(description_n, '') AS "Description_N", nullif(description_n1, '') AS "Description_N1"
FROM synthetic_edges WHERE {keep('code_n', 'year_n')} AND {keep('code_n1', 'year_n1')}"""


def _load_pairs(spark, sf, frm, to):
    path = io.scratch_path(spark, "pairs")
    _pair_files(spark, fx.synthetic_edges(spark, sf), path, (frm, to))
    return io.load_pairs(spark, path, "forward" if frm == "year_n" else "reverse", pattern="pair=mapped_*/*.csv")


@register("load_forward_pairs", _load_pairs_sql("year_n", "year_n1"))
def q_load_forward_pairs(spark, sf):
    """S6 -> P5 -> F11 on both codes -> P6: published forward pair files."""
    return _load_pairs(spark, sf, "year_n", "year_n1")


@register("load_reverse_pairs", _load_pairs_sql("year_n1", "year_n"))
def q_load_reverse_pairs(spark, sf):
    """S6 -> P5 -> F11 on both codes -> P6: published reverse pair files."""
    return _load_pairs(spark, sf, "year_n1", "year_n")


@register(
    "scan_hierarchy",
    with_views("hierarchy") + "SELECT level, count(*) AS n, count(DISTINCT hscode) AS n_codes FROM hierarchy GROUP BY level",
)
def q_scan_hierarchy(spark, sf):
    """S3: hierarchy CSV read as strings and split by level."""
    h = fx.hierarchy(spark, sf).select(F.col("level").cast("string").alias("level"), "hscode", "description")
    path = io.scratch_path(spark, "hierarchy")
    io.sink_snapshot(h, path, "csv")
    parts = [io.scan_hierarchy(spark, path, lv) for lv in (2, 4, 6)]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("hscode").alias("n_codes"))


@register(
    "scan_year_vectors",
    with_views("items")
    + "SELECT year, count(*) AS n_vectors, CAST(max(len(embedding)) AS INTEGER) AS dim FROM items "
    "WHERE year IN (1789, 1963, 2023) GROUP BY year",
)
def q_scan_year_vectors(spark, sf):
    """Vectors stored partitioned by year, read back for three years only
    (partition pruning), keyed by item id."""
    v = fx.items(spark, sf).select("item_id", "year", "embedding")
    path = io.scratch_path(spark, "vectors")
    v.write.mode("overwrite").partitionBy("year").parquet(path)
    back = io.scan_year_vectors(spark, path, [1789, 1963, 2023])
    return back.groupBy("year").agg(F.count(F.lit(1)).alias("n_vectors"), F.max(F.size("embedding")).alias("dim"))


@register(
    "scan_ground_truth",
    with_views("items")
    + """SELECT CASE WHEN length(code) >= 2 THEN substr(code, 1, 2) END AS hs, count(*) AS n,
       count(DISTINCT nullif(description, '')) AS n_texts FROM items GROUP BY hs""",
)
def q_scan_ground_truth(spark, sf):
    """A labelled schedule exported as CSV (brief_description, hs) read
    back with a declared all-string schema."""
    from yearlink.functions.text import prefix2

    t = fx.items(spark, sf).select(
        F.col("description").alias("brief_description"), prefix2("code").alias("hs")
    )
    path = io.scratch_path(spark, "truth")
    io.sink_snapshot(t, path, "csv")
    back = io.scan_items_str(spark, path, ["brief_description", "hs"])
    return back.groupBy("hs").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("brief_description").alias("n_texts"))


_EMPTY_CORPUS_SQL = "CASE WHEN item_id % 7 = 0 THEN '' ELSE description END"


def _corpus_with_empty(spark, sf):
    it = fx.catalog(spark, sf)
    return it.withColumn("description", F.when(F.col("item_id") % 7 == 0, F.lit("")).otherwise(F.col("description")))


@register(
    "search_empty_cosine",
    _search_sql(5, True).replace(
        "c AS (SELECT item_id, year, code, description,", f"c AS (SELECT item_id, year, code, {_EMPTY_CORPUS_SQL} AS description,"
    ),
)
def q_search_empty_cosine(spark, sf):
    """Q1: candidates with an empty description keep their raw cosine."""
    return search(fx.queries_v(spark, sf), _corpus_with_empty(spark, sf), top_k=5)


@register(
    "search_skip_empty",
    _search_sql(5, True).replace(
        "c AS (SELECT item_id, year, code, description,",
        f"c AS (SELECT item_id, year, code, {_EMPTY_CORPUS_SQL} AS description,",
    ).replace("AS lb FROM top)", "AS lb FROM top WHERE description IS NOT NULL AND description <> '')"),
)
def q_search_skip_empty(spark, sf):
    """Empty descriptions skipped among the candidates."""
    return search(fx.queries_v(spark, sf), _corpus_with_empty(spark, sf), top_k=5, empty="skip")
