"""Adjacent pairs, candidate top-k and the best match."""

from pyspark.sql import functions as F

from yearlink.operators.match import adjacent_pairs, match_year_pair
from yearlink.sources import fixtures as fx
from tests.conftest import SF0001

SCHEMA = "item_id long, year int, code string, description string, embedding array<float>"


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: t[0])


def test_adjacent_pairs_skip_gaps(spark):
    df = spark.createDataFrame([(1, 1789, None, "a", [1.0]), (2, 1846, None, "b", [1.0]), (3, 1792, None, "c", [1.0])], SCHEMA)
    assert sorted(tuple(r) for r in adjacent_pairs(df).collect()) == [(1789, 1792), (1792, 1846)]


def test_top_k_changes_winner(spark):
    # the cosine winner (A) loses the blend to the second-best cosine (B)
    df = spark.createDataFrame(
        [
            (10, 2000, "A", "blue car", [1.0, 0.05]),
            (11, 2000, "B", "red apple fresh", [0.9, 0.3]),
            (20, 2001, "Q", "red apple fresh", [1.0, 0.0]),
        ],
        SCHEMA,
    )
    top500 = match_year_pair(df).collect()[0]
    top1 = match_year_pair(df, top_k=1).collect()[0]
    assert top500.code_n == "B" and top1.code_n == "A"
    assert top500.jaccard == 1.0 and top500.levenshtein == 1.0
    assert top500.combined == 0.7 * top500.cosine + 0.2 * 1.0 + 0.1 * 1.0


def test_ties_take_lowest_candidate_id(spark):
    df = spark.createDataFrame(
        [
            (12, 2000, "X", "same text", [0.5, 0.5]),
            (11, 2000, "Y", "same text", [0.5, 0.5]),
            (20, 2001, "Q", "same text", [0.5, 0.5]),
        ],
        SCHEMA,
    )
    r = match_year_pair(df).collect()[0]
    assert r.item_id_n == 11


def test_forward_direction_and_empty_years(spark):
    df = spark.createDataFrame(
        [(1, 2000, "a", "cotton cloth", [1.0, 0.0]), (2, 2001, "b", "cotton cloths", [1.0, 0.1]),
         (3, 2001, "c", "iron", [0.0, 1.0])],
        SCHEMA,
    )
    fwd = match_year_pair(df, direction="n_to_n1").collect()
    assert len(fwd) == 1 and fwd[0].item_id_n == 1 and fwd[0].item_id_n1 == 2
    rev = match_year_pair(df).collect()
    assert sorted(r.item_id_n1 for r in rev) == [2, 3]


def test_block_equals_expr_and_prune_is_exact(spark):
    it = fx.items(spark, SF0001).cache()
    block = _rows(match_year_pair(it, method="block"))
    expr = _rows(match_year_pair(it, method="expr"))
    unpruned = _rows(match_year_pair(it, prune=False))
    assert block == expr == unpruned
    assert len(block) > 0


def test_match_is_row_order_invariant(spark):
    it = fx.items(spark, SF0001)
    a = _rows(match_year_pair(it, gamma=0.0, with_indel=False))
    shuffled = it.repartition(7, F.rand(11))
    b = _rows(match_year_pair(shuffled, gamma=0.0, with_indel=False))
    assert a == b


def test_tiling_is_exact_with_many_blocks(spark):
    it = fx.items(spark, SF0001).cache()
    one = _rows(match_year_pair(it, top_k=3))
    many = _rows(match_year_pair(it, top_k=3, query_block=2, cand_block=3))
    assert one == many


def test_in_tile_prune_exact_with_small_top_k(spark):
    it = fx.items(spark, SF0001).cache()
    for k in (1, 3, 7):
        pruned = _rows(match_year_pair(it, top_k=k))
        plain = _rows(match_year_pair(it, top_k=k, prune=False))
        expr = _rows(match_year_pair(it, top_k=k, method="expr"))
        assert pruned == plain == expr


def test_negative_weights_are_not_pruned(spark):
    rows = [(y * 100 + i, y, f"c{i}", f"word{i} thing {'x' * (i * 3)}", [float(i + 1), 1.0, float(y % 5)]) for y in (1, 2) for i in range(6)]
    it = spark.createDataFrame(rows, "item_id long, year int, code string, description string, embedding array<float>")
    for weights in ({"gamma": -0.9}, {"beta": -0.5}):
        a, b = (sorted(map(tuple, match_year_pair(it, prune=p, **weights).collect())) for p in (True, False))
        assert a == b and len(a) == 6


def test_search_by_scan_is_search_by_tiles(spark):
    from yearlink.operators import similarity as sim
    from yearlink.plans.search import search

    rows = [(i, i % 3, f"c{i}", f"word{i % 11} thing{i % 4}", None if i % 17 == 0 else [float(i % 5), float(i % 7), 1.0 if i % 13 else 0.0])
            for i in range(300)]
    corpus = spark.createDataFrame(rows, "item_id long, year int, code string, description string, embedding array<float>").repartition(4)
    queries = spark.createDataFrame(
        [(j, f"thing{j % 4} word{j}", [float(j % 3), float(j), 2.0] if j else [0.0, 0.0, 0.0]) for j in range(9)],
        "query_id long, text string, embedding array<float>",
    )
    a, b = (sorted(map(tuple, search(queries, corpus, top_k=4, method=m).collect())) for m in ("scan", "block"))
    assert a == b and len(a) == 36
    side = queries.selectExpr("query_id", "embedding", "1.0D as norm")
    assert sim.cosine_topk_scan(side, side, 1, "query_id", "query_id", most=3) is None


def _many_texts(rng, n, years=(2000, 2001)):
    """Items with repeated texts and vectors, near vectors, empty texts, zero
    vectors."""
    words = "red blue green apple car iron cloth cotton fresh old new salt".split()
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
        vec = [rng.choice([0.0, 0.5, 1.0]) for _ in range(3)]
        if i % 17 == 0:
            text = rng.choice(["", "  ", text.upper()])
        if i % 13 == 0:
            vec = [0.0, 0.0, 0.0]
        if i % 11 == 0:
            vec = [x + 1e-6 * rng.random() for x in vec]
        rows.append((i, years[i % len(years)], f"c{i}", text, vec))
    return rows


def test_shortcut_and_bounds_between_tiles_are_exact(spark, monkeypatch):
    import random

    from yearlink.operators import similarity

    calls = []
    real = similarity._bounded_topk
    monkeypatch.setattr(similarity, "_bounded_topk", lambda *a, **k: calls.append(1) or real(*a, **k))
    for seed, how in ((1, {"top_k": 7}), (2, {"top_k": 40, "direction": "n_to_n1"}), (3, {"gamma": 0.0, "with_indel": False}),
                      (4, {"strip": False, "guard": False, "top_k": 20})):
        df = spark.createDataFrame(_many_texts(random.Random(seed), 260), SCHEMA).repartition(4)
        plain = _rows(match_year_pair(df, prune=False, shortcut=False, **how))
        assert len(plain) == 130
        for tiles in ({}, {"query_block": 32, "cand_block": 16}):
            assert _rows(match_year_pair(df, **tiles, **how)) == plain, (seed, tiles)
            if tiles:
                assert _rows(match_year_pair(df, shortcut=False, **tiles, **how)) == plain, (seed, tiles)
    assert calls


def test_settled_queries_leave_the_quadratic_stage(spark):
    from yearlink.operators.exact import identical_counterparts
    from yearlink.operators.match import prepare_items

    rows = [(i, 2000, None, f"text {i % 40}", [float(i % 40 + 1), 1.0, 3.0]) for i in range(200)]
    rows += [(200 + i, 2001, None, f"Text {i}", [float(i + 1), 1.0, 3.0]) for i in range(60)]
    p = prepare_items(spark.createDataFrame(rows, SCHEMA)).withColumn("qy", F.lit(2001))
    got = identical_counterparts(p.where("year = 2001"), p.where("year = 2000"), "qy", F.lower("description"), 100)
    assert {tuple(r) for r in got.collect()} == {(200 + i, i) for i in range(40)}
    # not proven to be among the best 3 candidates by cosine: four copies each
    assert identical_counterparts(p.where("year = 2001"), p.where("year = 2000"), "qy", F.lower("description"), 3).count() == 0
    plan = match_year_pair(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "ExistingRDD" not in plan


def test_intersections_dense_and_sparse(monkeypatch):
    import numpy as np

    from yearlink.operators import similarity

    rng = np.random.default_rng(3)
    q = [set(rng.integers(0, 60, rng.integers(0, 9)).tolist()) | ({100} if i % 2 else set()) for i in range(70)]
    c = [set(rng.integers(20, 80, rng.integers(0, 9)).tolist()) | ({100} if i % 3 else set()) for i in range(50)]
    flat = lambda sets: (np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.array([x for s in sets for x in s]))
    want = np.array([[len(a & b) for b in c] for a in q])
    for pairs in (1 << 22, 3):
        monkeypatch.setattr(similarity, "_SPARSE_PAIRS", pairs)
        assert (similarity._intersections(*flat(q), *flat(c), 70, 50, 101) == want).all()


def test_match_with_indel_equals_a_brute_force(spark):
    """The Indel term has no oracle on the long item texts (too slow in SQL)."""
    import random

    import numpy as np

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rows = _many_texts(random.Random(8), 80)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.row_id: r for r in match_year_pair(df).collect()}
    vec = {r[0]: np.array(r[4], np.float32).astype(float) for r in rows}
    for q in (r for r in rows if r[1] == 2001):
        best = None
        for c in (r for r in rows if r[1] == 2000):
            n = np.linalg.norm(vec[q[0]]) * np.linalg.norm(vec[c[0]])
            cos = round(float(vec[q[0]] @ vec[c[0]] / n), 9) if n else 0.0
            a, b = set(q[3].lower().split()), set(c[3].lower().split())
            jac = len(a & b) / len(a | b) if a and b else 0.0
            x, y = q[3].strip().lower(), c[3].strip().lower()
            lev = 0.0 if not q[3] or not c[3] else 1.0 if not x + y else 2.0 * lcs(x, y) / len(x + y)
            key = (round(0.7 * cos + 0.2 * jac + 0.1 * lev, 10), cos, -c[0])
            best = key if best is None or key > best else best
        r = got[q[0]]
        assert (round(r.combined, 10), r.cosine, -r.item_id_n) == best
