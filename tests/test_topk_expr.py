"""The Catalyst top-k of cosines: bounded, complete and equal to a ranking of all pairs."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from yearlink.functions.vectors import cosine, l2_norm
from yearlink.operators import similarity as sim

SCHEMA = "g int, id long, embedding array<float>"


def _table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("norm", l2_norm("embedding"))


def _noise(seed, n, d, g=1, first=0):
    return [(g, first + i, v.tolist()) for i, v in enumerate(np.random.default_rng(seed).standard_normal((n, d)).astype(np.float32))]


def _all_ranked(left, right, k):
    a = left.select("g", F.col("id").alias("l_id"), F.col("embedding").alias("a"), F.col("norm").alias("na"))
    b = right.select("g", F.col("id").alias("r_id"), F.col("embedding").alias("b"), F.col("norm").alias("nb"))
    w = Window.partitionBy("g", "l_id").orderBy(F.desc("cos"), F.asc("r_id"))
    ranked = a.join(b, "g").select("g", "l_id", "r_id", cosine("a", "b", "na", "nb").alias("cos"))
    return sorted(map(str, ranked.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k).drop("rk").collect()))


def _topk(left, right, k, **sizes):
    out = sim.cosine_topk(left, right, ["g"], k, "id", "id", method="expr", **sizes)
    return sorted(map(str, out.select("g", "l_id", "r_id", "cos").collect()))


def test_few_pairs_are_left_to_sort(spark):
    left, right = _table(spark, _noise(1, 150, 24)), _table(spark, _noise(2, 600, 24))
    l = left.select("g", F.col("id").alias("_lid"), F.col("embedding").alias("_vec"), F.col("norm").alias("_norm"))
    r = right.select("g", F.col("id").alias("_rid"), F.col("embedding").alias("_vec"), F.col("norm").alias("_norm"))
    scored = sim._scored(l, r, sim._sizes(l, r, ["g"]), ["g"], 5, "expr", 1024, 4096)
    per = [n for _, n in scored.groupBy("l_id").count().collect()]
    assert len(per) == 150 and min(per) >= 5
    assert sum(per) < 150 * 600 // 4
    # a number is not handed to a lambda for each pair
    assert "lambdafunction(" not in scored._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[0]


@pytest.mark.parametrize("d", [5, 70])
def test_equal_to_all_pairs_ranked(spark, d):
    rows = _noise(3, 40, d) + _noise(4, 30, d, 2, 500)
    odd = [
        (1, 900, [0.0] * d), (1, 901, None), (1, 902, [1.0] * (d - 1) + [None]), (1, 903, [1.0] * (d - 1)),
        (1, 904, [-0.0] + [0.5] * (d - 1)), (1, 905, [0.0] + [0.5] * (d - 1)), (1, 906, []), (1, 907, [2.0] * (d + 3)),
        (1, 908, [float("nan")] + [1.0] * (d - 1)), (3, 909, [1.0] * d),
    ]
    left = _table(spark, rows + odd + rows[:3])
    right = _table(spark, _noise(5, 300, d) + _noise(6, 7, d, 2, 700) + odd[:-1] + [(4, 1, [1.0] * d)] + [(1, 2000 + i, rows[0][2]) for i in range(9)])
    # an id that comes twice has the best of both, as when all pairs are ranked
    assert _topk(left, right, 3, left_block=7 * d, right_block=11) == _all_ranked(left, right, 3)


def test_many_wanted(spark):
    left, right = _table(spark, _noise(7, 20, 16)), _table(spark, _noise(8, 3400, 16))
    assert _topk(left, right, 33) == _all_ranked(left, right, 33)


def test_signed_zero_and_equal_vectors_are_one_class(spark):
    rows = [(1, i, [0.0 if i % 2 else -0.0, 1.0]) for i in range(6)] + [(1, 10, None), (1, 11, None)]
    t = _table(spark, rows).select("g", F.col("id").alias("_rid"), F.col("embedding").alias("_vec"), F.col("norm").alias("_norm"))
    classes, members = sim._vector_classes(t, ["g"], "_rid", "test-vectors")
    assert members.count() == 8
    assert classes.count() <= 3
