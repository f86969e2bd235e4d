"""F4 in Catalyst against the Arrow form and the plain recurrence."""

import random

from pyspark.sql import functions as F

from yearlink.functions.indel import indel, indel_ratio, lcs_length
from yearlink.functions.indel_expr import WORD, indel_expr
from yearlink.functions.indel_expr import lcs_length as lcs_expr
from yearlink.operators.match import match_year_pair


def _text(rnd, n):
    return "".join(rnd.choice("ab cdé中😀") for _ in range(n))


def test_lengths_around_the_words(spark):
    rnd = random.Random(4)
    sizes = [0, 1, 2, WORD - 1, WORD, WORD + 1, 2 * WORD - 1, 2 * WORD, 2 * WORD + 1, 200, 400]
    rows = [(i * 100 + j, _text(rnd, n), _text(rnd, m)) for i, n in enumerate(sizes) for j, m in enumerate(sizes)]
    # runs of one letter carry through all words
    rows += [(9000 + n, "a" * n, "a" * (n + 7)) for n in sizes]
    df = spark.createDataFrame(rows, "i long, a string, b string").repartition(8)
    got = {r.i: r.n for r in df.select("i", lcs_expr(F.col("a"), F.col("b")).alias("n")).collect()}
    assert got == {i: lcs_length(a, b) for i, a, b in rows}


def test_variants_nulls_and_long_texts(spark):
    rnd = random.Random(5)
    rows = [("", "a"), (None, "a"), ("a", None), (None, None), ("", ""), ("  ", " "), (" ABC ", "abc"), ("refined sugar", "sugar, refined")]
    rows += [(_text(rnd, 2500), _text(rnd, 1500)), ("x" * 3000, "y" * 40)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    for strip in (True, False):
        for guard in (True, False):
            got = {r.i: r.x for r in df.select("i", indel_expr("a", "b", strip, guard).alias("x")).collect()}
            want = {i: indel_ratio(a, b, strip, guard) for i, (a, b) in enumerate(rows)}
            assert got.keys() == want.keys()
            assert all(got[i] is want[i] if want[i] is None else abs(got[i] - want[i]) < 1e-12 for i in want)


def _items(spark):
    rnd = random.Random(6)
    words = "wool yarn cotton silk thread raw combed dyed bleached spun".split()
    rows = []
    for i in range(60):
        text = "" if i % 20 == 7 else " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 25)))
        rows.append((i, 2000 + i % 3, f"c{i}", text, [0.0] * 4 if i % 17 == 3 else [rnd.random() for _ in range(4)]))
    return spark.createDataFrame(rows, "item_id long, year int, code string, description string, embedding array<float>")


def test_matcher_without_python_workers(spark):
    items = _items(spark)
    plan = match_year_pair(items, python=False, materialize=False)
    tree = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in tree and "Arrow" not in tree
    rows = lambda df: sorted((r.row_id, r.item_id_n, round(r.levenshtein, 9), round(r.combined, 9)) for r in df.collect())
    assert rows(plan) == rows(match_year_pair(items))


def test_both_forms_agree_on_an_arrow_batch(spark):
    rnd = random.Random(7)
    df = spark.createDataFrame([(_text(rnd, rnd.randint(0, 150)), _text(rnd, rnd.randint(0, 150))) for _ in range(200)], "a string, b string")
    bad = df.select(indel("a", "b").alias("x"), indel_expr("a", "b").alias("y")).filter("abs(x - y) > 1e-12 or x is null or y is null")
    assert bad.count() == 0
