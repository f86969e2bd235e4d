"""Scalar functions F1-F15 on hand-computed cases (FIXTURES.md section C)."""

import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from yearlink.functions import text as tx
from yearlink.functions.indel import _ratio_series, indel, indel_ratio, lcs_length, lcs_lengths_vec
from yearlink.functions.vectors import cosine, l2_normalize


def _dp_lcs(a, b):
    prev = [0] * (len(b) + 1)
    for ca in a:
        cur = [0]
        for j, cb in enumerate(b):
            cur.append(prev[j] + 1 if ca == cb else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


def test_indel_hand_cases():
    assert indel_ratio("refined sugar", "sugar, refined") == pytest.approx(14 / 27)
    assert indel_ratio("", "a") == 0.0
    assert indel_ratio(" ABC ", "abc") == 1.0
    assert indel_ratio(" ABC ", "abc", strip=False, guard=False) == pytest.approx(0.75)
    # guard runs before strip: two blank strings reach the ratio (0/0 -> 1)
    assert indel_ratio("  ", "  ") == 1.0
    assert indel_ratio(None, "x", guard=False) is None


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcé 中", max_size=150), st.text(alphabet="abcé 中", max_size=150))
def test_lcs_bitparallel_equals_dp(a, b):
    assert lcs_length(a, b) == _dp_lcs(a, b)


def test_lcs_vectorised_equals_scalar():
    random.seed(3)
    alpha = "ab cdé中"
    xs = ["".join(random.choice(alpha) for _ in range(random.randint(1, 260))) for _ in range(300)]
    ys = ["".join(random.choice(alpha) for _ in range(random.randint(1, 260))) for _ in range(300)]
    v = lcs_lengths_vec(xs, ys)
    assert [int(x) for x in v] == [lcs_length(x, y) for x, y in zip(xs, ys)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=40), st.text(max_size=40)), min_size=1, max_size=30))
def test_indel_symmetric_in_unit_interval(pairs):
    a = pd.Series([p[0] for p in pairs])
    b = pd.Series([p[1] for p in pairs])
    r1 = _ratio_series(a, b, True, True)
    r2 = _ratio_series(b, a, True, True)
    assert ((r1 >= 0) & (r1 <= 1)).all()
    assert (r1 - r2).abs().max() < 1e-12
    assert list(r1) == [indel_ratio(x, y) for x, y in pairs]


def test_indel_udf(spark):
    df = spark.createDataFrame(
        [("refined sugar", "sugar, refined"), ("", "a"), (" ABC ", "abc")], "a string, b string"
    )
    got = [r[0] for r in df.select(indel("a", "b")).collect()]
    assert got == pytest.approx([14 / 27, 0.0, 1.0])
    got = [r[0] for r in df.select(indel("a", "b", strip=False, guard=False)).collect()]
    assert got[2] == pytest.approx(0.75)


def test_tokens_and_jaccard(spark):
    df = spark.createDataFrame(
        [("sugar refined", "refined  sugar"), ("", "a"), ("a a b", "a"), ("Cotton cloth,\tcotton ", "x")],
        "a string, b string",
    )
    rows = df.select(
        tx.jaccard(tx.tokens("a"), tx.tokens("b")).alias("j"), F.array_sort(tx.tokens("a")).alias("t")
    ).collect()
    assert [r.j for r in rows[:3]] == [1.0, 0.0, 0.5]
    assert rows[3].t == ["cloth,", "cotton"]


def test_cosine_edges(spark):
    df = spark.createDataFrame(
        [([0.0, 0.0], [1.0, 2.0]), ([1.0, 2.0], [1.0, 2.0]), ([1.0, 2.0], [-1.0, -2.0])],
        "a array<float>, b array<float>",
    )
    assert [r[0] for r in df.select(cosine("a", "b")).collect()] == [0.0, 1.0, -1.0]
    n = df.select(l2_normalize("b").alias("u")).collect()[0].u
    assert sum(x * x for x in n) == pytest.approx(1.0, rel=1e-6)


def test_slug_uniq_key(spark):
    df = spark.createDataFrame(
        [(1, 1900, None, "Clocks & parts: Valued > $5, not more than $10 each"), (2, 1900, " 12 ", "x"),
         (3, 1901, "  ", "Tea")],
        "item_id long, year int, code string, description string",
    )
    rows = df.select(tx.slug("description").alias("s"), tx.uniq_key("year", "item_id", "code", "description").alias("k")).collect()
    assert rows[0].s == "clocks__parts_valued__5_not_more_than_10"
    assert rows[0].k == "1900_1_clocks__parts_valued__5_not_more_than_10"
    assert rows[1].k == "12"
    assert rows[2].k == "1901_3_tea"


def test_clean_code(spark):
    from yearlink.operators.report import clean_codes

    df = spark.createDataFrame(
        [(1, 1989, "1234567"), (2, 1989, "1234567.0"), (3, 1989, "12345678.0"), (4, 1989, "1234567890"),
         (5, 1988, "1234567.0"), (6, 1989, None)],
        "row_id long, year int, code string",
    )
    got = {r.row_id: r.code for r in clean_codes(df, "code", "year").collect()}
    assert got == {1: "01234567", 2: "01234567", 3: "12345678", 5: "1234567.0", 6: None}


def test_prefix_pad_round(spark):
    df = spark.createDataFrame([("3",), ("84",), ("841",), (None,)], "c string")
    rows = df.select(tx.pad2("c").alias("p"), tx.prefix2("c").alias("x")).collect()
    assert [r.p for r in rows] == ["03", "84", "841", None]
    assert [r.x for r in rows] == [None, "84", "84", None]
    r = spark.createDataFrame([(2.5,), (0.125,)], "v double").select(tx.round_report("v", 0).alias("a"), tx.round_report("v", 2).alias("b")).collect()
    assert r[0].a == 2.0 and r[1].b == 0.12


def test_blocked_row_number(spark):
    from pyspark.sql import Window

    from yearlink.operators.ranking import blocked_row_number

    df = spark.range(0, 5000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 100003).alias("k"))
    got = {(r.g, r.k): r.rn for r in blocked_row_number(df, "g", "k", block=64).collect()}
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1)
    assert got == {(r.g, r.k): r.rn for r in ref.collect()}
