"""Round 3 findings: tiles and joins whose work per row must not grow."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from yearlink.functions.vectors import l2_norm
from yearlink.operators import similarity
from yearlink.operators.match import match_year_pair, prepare_items
from yearlink.operators.report import truth_join
from yearlink.plans import chain, queries_fallback
from yearlink.sources.fixtures import FIXTURE_YEARS


def _vectors(rng, n, d=3):
    """Repeated, zero and missing vectors; the last id comes twice."""
    rows = [(i, None if i % 19 == 0 else [0.0] * d if i % 7 == 0 else [float(rng.randint(-2, 2)) for _ in range(d)]) for i in range(n)]
    return rows + rows[-1:]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "id long, embedding array<float>").withColumn("k", F.lit(1)).withColumn("norm", l2_norm("embedding"))


def test_topk_by_vector_equals_a_brute_force(spark):
    rng = random.Random(4)
    left, right = _vectors(rng, 45), _vectors(rng, 70)

    def cos(a, b):
        n = np.linalg.norm(a) * np.linalg.norm(b) if a and b else 0.0
        return round(float(np.dot(a, b) / n), 9) if n else 0.0

    for k in (1, 4):
        want = []
        for i in sorted({r[0] for r in left}):
            pairs = [(-cos(v, w), j) for x, v in left if x == i for j, w in right]
            want += [(i, j, -c + 0.0) for c, j in sorted(pairs)[:k]]
        got = similarity.cosine_topk(_frame(spark, left), _frame(spark, right), ["k"], k, "id", "id", left_block=8, right_block=8)
        assert sorted((r.l_id, r.r_id, r.cos + 0.0) for r in got.collect()) == sorted(want)


def test_equal_vectors_enter_the_tiles_once(spark, monkeypatch):
    seen = []
    real = similarity._tiles
    monkeypatch.setattr(similarity, "_tiles", lambda l, r, *a: seen.append((l.count(), r.count())) or real(l, r, *a))
    left = _frame(spark, [(i, [float(i % 5), 1.0]) for i in range(200)])
    right = _frame(spark, [(i, [1.0, float(i % 4)]) for i in range(300)])
    assert similarity.cosine_topk(left, right, ["k"], 1, "id", "id").count() == 200
    assert seen == [(5, 4)]


def test_rows_are_copied_to_few_tiles_whatever_the_size(spark):
    l = _frame(spark, [(1, [1.0] * 64)])
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    copies = []
    for n in (100_000, 1_000_000):
        sizes = spark.createDataFrame([(1, n, 64, n)], "k int, _nl long, _wide int, _nr long")
        a, b = similarity._tile_rows(sizes, 1024, 4096, l, 1)
        copies.append(n / a + n / b)
        assert (n / a + 1) * (n / b + 1) >= n_parts and max(a, b) * 64 * 4 <= 64 << 20
    # before: a copy for each 1,024 or 4,096 rows of the other side, 1,221 at the second size
    assert copies[1] < 40 + copies[0]


def test_a_frequent_text_of_the_truth_join_is_dealt_to_several_tasks(spark):
    pred = spark.createDataFrame([(i, "" if i % 2 else f"t{i % 7}", f"p{i % 3}") for i in range(400)], "row_id long, description string, y_pred string")
    truth = spark.createDataFrame([(i, "" if i % 3 else None if i % 5 == 0 else f"t{i % 9}", "x") for i in range(60)], "item_id long, description string, y_true string")
    plain = pred.join(truth, "description")
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {c: spark.conf.get(c) for c in conf}
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        got = truth_join(pred, truth, most=500)
        assert got.columns == plain.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
        tasks = got.where("description = ''").select(F.spark_partition_id().alias("t")).distinct().count()
        assert tasks > 1
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


MATCH_SCHEMA = "item_id long, year int, code string, description string, embedding array<float>"


def _items_with_copies(rng, n, copies):
    words = "red blue apple car iron cloth cotton fresh".split()
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 3)))
        vec = None if i % 23 == 0 else [0.0] * 3 if i % 13 == 0 else [rng.choice([0.0, 0.5, 1.0]) + 1e-7 * rng.randint(0, 3) for _ in range(3)]
        rows += [(i + n * j, 2000 + i % 2, f"c{i}", text, vec) for j in range(rng.randint(1, copies))]
    return rows


def test_items_of_equal_text_and_vector_enter_the_matcher_once(spark, monkeypatch):
    seen = []
    real = similarity._tiles
    monkeypatch.setattr(similarity, "_tiles", lambda l, r, *a: seen.append((l.count(), r.count())) or real(l, r, *a))
    rows = [(i, 2000 + i % 2, None, f"word{i % 10} thing{i % 2}", [float(i % 10 + 1), 1.0]) for i in range(400)]
    got = match_year_pair(spark.createDataFrame(rows, MATCH_SCHEMA))
    assert got.count() == 200
    assert seen and max(max(s) for s in seen) == 5


def test_cut_after_k_rows_counts_all_copies(spark):
    for seed, how in ((1, {"top_k": 5}), (2, {"top_k": 12, "direction": "n_to_n1", "gamma": 0.0, "with_indel": False}), (3, {"top_k": 30})):
        df = spark.createDataFrame(_items_with_copies(random.Random(seed), 90, 9), MATCH_SCHEMA).repartition(3)
        want = sorted(map(tuple, match_year_pair(df, prune=False, shortcut=False, **how).collect()))
        for tiles in ({}, {"query_block": 16, "cand_block": 8}):
            assert sorted(map(tuple, match_year_pair(df, shortcut=False, **tiles, **how).collect())) == want, (seed, tiles)


def test_open_queries_do_not_return_their_k_nearest_rows(spark):
    """400 near vectors, k = 200: only pairs that can win leave the tiles."""
    rng = random.Random(7)
    rows = [(i, 2000 + i % 2, None, f"w{i} x{i % 5} y{i % 7}", [1.0, 0.05 * rng.random(), 0.05 * rng.random()]) for i in range(800)]
    spec = {"alpha": 0.7, "beta": 0.2, "gamma": 0.0, "tokens": "tokens", "ntok": "ntok", "nlen": "nlen"}
    left, right = (prepare_items(spark.createDataFrame(rows[y::2], MATCH_SCHEMA)).withColumn("qy", F.lit(1)) for y in (0, 1))
    names = []
    real = similarity._tiles
    similarity._tiles = lambda l, r, *a: names.append(l.columns) or real(l, r, *a)
    try:
        got = similarity.cosine_topk(left, right, ["qy"], 200, "item_id", "item_id", prune=spec, left_block=64, right_block=64).collect()
    finally:
        similarity._tiles = real
    assert any("_sc" in n for n in names)  # the third round, with the pairs to be ranked
    vec = {r[0]: np.array(r[4], np.float32).astype(float) for r in rows}
    tok = {r[0]: set(r[3].split()) for r in rows}
    cos = lambda a, b: round(float(vec[a] @ vec[b] / np.linalg.norm(vec[a]) / np.linalg.norm(vec[b])), 9)
    best = {}
    for r in got:
        best[r.l_id] = max(best.get(r.l_id, (-1.0,)), (0.7 * r.cos + 0.2 * r.jac, r.cos, -r.r_id))
    for i in range(0, 800, 40):
        top = sorted((-cos(i, j), j) for j in range(1, 800, 2))[:200]
        want = max((0.7 * -c + 0.2 * len(tok[i] & tok[j]) / len(tok[i] | tok[j]), -c, -j) for c, j in top)
        assert best[i][2] == want[2] and abs(best[i][0] - want[0]) < 1e-8


def test_a_tile_holds_few_token_sets(monkeypatch):
    monkeypatch.setattr(similarity, "_SETS_HELD", 3)
    toks = [["a", "b"], ["b"], ["c"], ["a", "c"], [], ["d", "b"], ["a"]]
    table = pa.table({"_vec": pa.array([[1.0]] * 7, pa.list_(pa.float32())), "_norm": [1.0] * 7, "_tok": toks})
    q, c, _ = similarity._sides_of(table, table)
    qi, ci = np.divmod(np.arange(49), 7)
    got = similarity._Tokens(q, c).jaccard(qi, ci)
    want = [len(set(toks[i]) & set(toks[j])) / len(set(toks[i]) | set(toks[j])) if toks[i] and toks[j] else 0.0 for i, j in zip(qi, ci)]
    assert got.tolist() == want
    assert max(len(q._sets), len(c._sets)) <= 3


def _longest(df) -> int:
    """Code points of the longest string of a table."""
    strings = [F.coalesce(F.length(c), F.lit(0)) for c, t in df.dtypes if t == "string"]
    return df.select(F.max(F.greatest(*strings, F.lit(0), F.lit(0)))).first()[0]


def test_chain_rounds_hold_keys_of_long_texts(spark, monkeypatch):
    seen = []
    real = chain._cut
    monkeypatch.setattr(chain, "_cut", lambda df: seen.append(_longest(df.select("nd", "pd"))) or real(df))
    text = {c: c * 5000 for c in "abcd"}
    rows = [
        (1, 2000, 2010, "1", "2", text["a"], " " + text["b"].upper() + " ", 0.9),
        (2, 2010, 2022, "2", "3", text["b"], text["c"], 0.8),
        (3, 2022, 2023, "3", "4", text["c"], text["d"].upper(), 0.7),
        (4, 2010, 2022, "5", "6", text["d"], text["a"], 0.6),
        (5, 2000, 2010, None, None, None, None, 0.5),
    ]
    ddl = "row_id long, year_n int, year_n1 int, code_n string, code_n1 string, description_n string, description_n1 string, combined double"
    got = chain.chain_by_description(spark.createDataFrame(rows, ddl))
    want = {i: ("4", text["d"].upper(), h) for i, h in ((1, 3), (2, 2), (3, 1))} | {4: (None, None, None), 5: (None, None, None)}
    assert {r.row_id: (r.mapped_2023_code, r.mapped_2023_description, r.hops) for r in got.collect()} == want
    assert len(seen) > 1 and max(seen) == 32


def _fallback_tables(spark, path) -> dict[int, tuple[int, str]]:
    """The tables of the fallback queries; year and text of each part."""
    rng = random.Random(8)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(30)]
    lines = [(i, f"{i} " + "long line " * 50) for i in range(40)]
    parts = [(i, f"name {i}", "brand", "type") for i in range(96)]
    for name, rows, ddl in (
        ("embeddings", vectors, "vec_id long, embedding array<float>"),
        ("documents", [(i, f"{t}\nmore") for i, t in lines], "doc_id long, text string"),
        ("part", parts, "p_partkey long, p_name string, p_brand string, p_type string"),
        ("nation", [(i, f"n{i}") for i in range(3)], "n_nationkey int, n_name string"),
        ("supplier", [(i, f"s{i}") for i in range(5)], "s_suppkey long, s_name string"),
        ("customer", [(i, f"c{i}", "m") for i in range(7)], "c_custkey long, c_name string, c_mktsegment string"),
    ):
        spark.createDataFrame(rows, ddl).write.parquet(f"{path}/{name}.parquet")
    text = lambda i: "" if i % 97 == 5 else f"brand type name {i} {lines[i % 40][1]}"
    return {i: (FIXTURE_YEARS[i % 16], text(i)) for i, *_ in parts}


def test_fallback_moves_neither_texts_nor_vectors(spark, tmp_path, monkeypatch):
    items = _fallback_tables(spark, tmp_path)
    seen = {}
    real = queries_fallback.parquet_table

    def table(df, name):
        seen[name] = out = real(df, name)
        return out

    monkeypatch.setattr(queries_fallback, "parquet_table", table)
    got = queries_fallback.q_merge_back(spark, str(tmp_path)).collect()
    by_year = {y: sorted(i for i, (z, _) in items.items() if z == y) for y in FIXTURE_YEARS}
    want = {}
    for y, nxt in zip(FIXTURE_YEARS, FIXTURE_YEARS[1:]):
        for r, i in enumerate(by_year[y]):
            want[i] = items[by_year[nxt][(r * 7 + 3) % len(by_year[nxt])]][1]
    assert {r.row_id for r in got} == set(want)
    kept = {r.row_id: r.best_match_description for r in got if r.best_match_source == "2023_mapping"}
    assert 0 < len(kept) < len(want) and "" in want.values()
    assert kept == {i: want[i] for i in kept}
    assert all(len(r.best_match_description) < 5 for r in got if r.row_id not in kept)
    for name in ("edges", "scored"):
        assert _longest(seen[name]) == 32
        assert not [c for c, t in seen[name].dtypes if t.startswith("array")]
