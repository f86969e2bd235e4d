import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import words
from yearlink.llm import common as C
from yearlink.llm import language_id as L
from yearlink.llm import lm_scoring as M


def fold(i, k):
    return zlib.crc32(str(i).encode()) % k


# ------------------------------------------------------------ language models
def test_scores_have_exact_counts_and_beat_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check_counts(docs, M.scored(docs).collect())


def test_odd_documents_are_scored(odd_docs, no_docs):
    got = M.scored(odd_docs, bits=1 << 18).collect()
    check_counts(odd_docs, got, better=False)
    assert M.scored(no_docs).count() == 0


def check_counts(docs, got, better=True):
    rows = [(r.doc_id, [w.lower() for w in words(r.text)] + [None]) for r in docs.select("doc_id", "text").collect()]
    c = Counter()
    for i, t in rows:
        if i is not None and fold(i, 7) != 2:
            c.update(t)
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t in rows:
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        want[i, None if i is None else fold(i, 7) == 2, len(t), sum(c[w] > 0 for w in t), n, round(base, 5)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    if better:
        held = [r for r in got if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_without_training_documents(spark):
    got = M.scored(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]


def test_bloom_filter_keeps_levels():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**64, 20_000, dtype=np.uint64))
    counts = np.maximum(1, (rng.pareto(1.0, len(keys))).astype(int))
    q = M.level(counts)
    f = M.BloomFilter(bits=1 << 22)
    f.insert(keys, q)
    assert (f.levels(keys) >= q).all()  # a Bloom filter never forgets
    assert (f.levels(keys) == q).mean() > 0.98
    assert (f.levels(rng.integers(0, 2**64, 20_000, dtype=np.uint64)) > 0).mean() < 0.02
    many = np.arange(1, 10**6, 997)
    worth = M.decoded()[M.level(many)]
    assert (abs(worth / many - 1) < 0.15).all()


def test_cutoffs_bound_the_filter():
    by_level = {1: np.full(M.LEVELS, 5), 2: np.array([0, 900, 80, 9, *([1] * (M.LEVELS - 4))])}
    for capacity in (10**6, 30_000, 5_000, 100):
        cut = M.cutoffs(by_level, capacity)
        assert cut[2] >= 2
        q = np.arange(M.LEVELS)
        assert sum((by_level[k] * q)[cut[k] :].sum() for k in cut) <= capacity


def test_the_parts_of_the_filter_are_those_of_a_whole_one():
    rng = np.random.default_rng(1)
    bits = 1 << 20
    keys, counts = np.unique(rng.integers(0, 2**64, 3000, dtype=np.uint64)), None
    counts = rng.integers(1, 9, len(keys))
    batch = pa.record_batch(
        [pa.array([1], pa.int32()), pa.array([C.pack_sorted(keys)]), pa.array([C.pack(counts.astype(np.uint64))])],
        names=["kind", "keys", "counts"],
    )
    data = np.zeros(bits // 8, np.uint8)
    size = len(data) // M.SEGMENTS
    for b in M._fill({1: 2, 2: 2}, bits)(iter([batch])):
        part = b.column(0)[0].as_py()
        data[part * size : (part + 1) * size] |= np.frombuffer(b.column(1)[0].as_py(), np.uint8)
    whole = M.BloomFilter(bits=bits)
    whole.insert(keys[counts > 1], M.level(counts[counts > 1]))
    assert (data == whole.data).all()


def test_the_filter_grows_with_the_counts_and_keeps_every_level():
    by_level = {1: np.full(M.LEVELS, 5), 2: np.array([0, 900_000, 80, 9, *([1] * (M.LEVELS - 4))])}
    entries = sum(int((x * np.arange(M.LEVELS)).sum()) for x in by_level.values())
    bits = M.filter_bits(by_level, 1 << 18)
    assert bits >= M.BITS_EACH * entries and bits % (8 * M.SEGMENTS) == 0
    assert M.filter_bits(by_level, 1 << 27) == 1 << 27


@pytest.mark.parametrize("n", [1, 3, 8, 211, 300])
def test_owners_answer_for_all_n_grams(n):
    """Also for pairs seen once, and at any number of hash ranges."""
    rng = np.random.default_rng(2)
    for kind, width in ((1, 64), (2, M.PAIR_BITS)):
        keys = np.unique(rng.integers(0, 2**width, 5000, dtype=np.uint64))
        counts = rng.integers(1, 4, len(keys))
        absent = np.setdiff1d(rng.integers(0, 2**width, 5000, dtype=np.uint64), keys)
        cut, other, seen, wrong = C.bounds(keys, n, width), C.bounds(absent, n, width), 0, 0
        for k in range(n):
            s, o = slice(cut[k], cut[k + 1]), slice(other[k], other[k + 1])
            line = lambda chunk, x, counts=None: (chunk, k, *((x, None) if kind == 1 else (None, x)), counts)  # noqa: B023, E731
            lines = [line(-1, C.pack_sorted(keys[s]), C.pack(counts[s].astype(np.uint64)))] if cut[k] < cut[k + 1] else []
            lines += [line(9, C.pack_sorted(x)) for x in (keys[s], absent[o]) if len(x)]
            cols = zip(*(lines or [()] * 5), strict=True)
            if not lines:
                continue
            batch = pa.record_batch([pa.array(c, t) for c, t in zip(cols, M._LINES.values(), strict=True)], names=list(M._LINES))
            got = [r for b in M._answer(n, 1 << 18)(iter([batch])) for r in b.to_pylist()]
            levels = [C.unpack(r["words" if kind == 1 else "pairs"]).astype(int) for r in got]
            if cut[k] < cut[k + 1]:
                assert (levels[0] >= counts[s]).all()
                seen += len(levels[0])
                if kind == 1:
                    assert (C.unpack(got[0]["counts"]) == counts[s]).all()
                levels = levels[1:]
            wrong += sum(int((x > 0).sum()) for x in levels)
        assert seen == len(keys) and wrong < 0.03 * len(absent)


def test_a_small_least_size_changes_no_score(spark):
    """The filter used to drop n-grams to stay within ``bits``."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300)
    wide = {r.doc_id: r.score / r.n_tokens for r in M.scored(docs).collect()}
    small = {r.doc_id: r.score / r.n_tokens for r in M.scored(docs, bits=1 << 12).collect()}
    assert max(abs(wide[i] - small[i]) for i in wide) < 0.05


# ------------------------------------------------------------ language id
def test_language_of_the_held_out_fold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = L.languages(docs).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.held_out]) > 0.97


def test_smallest_is_the_top_of_each_language(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 10 < 9, "b").otherwise("c").alias("lang"),
        F.xxhash64(F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.lit(7))).alias("o"),  # half of all: one row
        F.lit("t").alias("t"),
    )
    rows = rows.union(spark.createDataFrame([("d", -(1 << 63), "x"), ("d", (1 << 63) - 1, "y"), ("d", -1, "z")], rows.schema))
    for many in (1, 50, 400, 5000):
        w = F.row_number().over(Window.partitionBy("lang").orderBy("o", "t"))
        want = rows.withColumn("k", w).where(F.col("k") <= many).groupBy("lang", "o", "t").agg(F.count("*").cast("int").alias("n"))
        got = L.smallest(rows, many)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_odd_documents_have_a_language(odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(L, "STEPS", 20)
    got = L.languages(odd_docs).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert (r.held_out is None) == (r.doc_id is None)
        if r.doc_id in (100_001, 100_002, 100_003, 100_010):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None:
            assert r.lang_pred in ("de", "en", "es", "fr")
    assert L.languages(no_docs).count() == 0
    nothing = L.languages(odd_docs.withColumn("lang", odd_docs.lang.substr(9, 1)).replace("", None, "lang")).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    only = L.languages(odd_docs.where("lang = 'de'")).collect()
    assert {r.lang_pred for r in only} <= {"de", "und"}


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    model = L.Model(["a", "b", "c"], hidden=3, seed=1)
    params = [model.ahead.w, model.ahead.u, model.behind.w, model.behind.u, model.out, model.bias]
    for d in (model.ahead, model.behind):
        d.w, d.u = d.w.astype(np.float64), d.u.astype(np.float64)
    model.out, model.bias = model.out.astype(np.float64), model.bias.astype(np.float64)
    params = [model.ahead.w, model.ahead.u, model.behind.w, model.behind.u, model.out, model.bias]
    x, y = rng.integers(0, 6, (7, 4)).astype(np.uint8), np.array([0, 1, 2, 1])
    real = (np.arange(7)[:, None] < np.array([7, 5, 7, 2])[None, :]).astype(float)

    def loss():
        fs, _ = model.ahead.run(x)
        bs, _ = model.behind.run(x[::-1])
        logs = model.log_probabilities(np.concatenate((fs, bs[::-1]), axis=2))
        return -(logs[:, np.arange(4), y] * real).sum() / real.sum()

    for p, g in zip(params, model._step(x, y, real), strict=True):
        for at in [tuple(rng.integers(0, s) for s in p.shape) for _ in range(6)]:
            old = p[at]
            p[at] = old + 1e-2
            up = loss()
            p[at] = old - 1e-2
            down = loss()
            p[at] = old
            assert (up - down) / 2e-2 == pytest.approx(g[at], abs=2e-4)


def test_every_byte_is_read_once_and_the_fast_form_is_the_plain_one():
    model = L.Model(["a", "b"], seed=3)
    text = ("abc déf " * 40).encode()[:200]
    data = np.frombuffer(text * 2, np.uint8)
    x = np.pad(data[:200], L.WARM)[:, None]  # zero bytes around the text
    fs, _ = model.ahead.run(x)
    bs, _ = model.behind.run(x[::-1])
    plain = model.log_probabilities(np.concatenate((fs, bs[::-1]), axis=2))[L.WARM : -L.WARM].sum(axis=(0, 1))
    assert np.allclose(model.ahead.states(x)[:, :, 0], fs[:, 0], atol=1e-5)
    old, L.READ = L.READ, 200
    try:
        got = model.pooled(data, np.array([0, 200, 200, 400]))
    finally:
        L.READ = old
    assert np.allclose(got[0], plain, rtol=1e-4) and np.allclose(got[0], got[2]) and (got[1] == 0).all()
    cut = model.pooled(data, np.array([0, 200, 200, 400]))  # spans of READ bytes, warmed up
    assert np.allclose(cut[0], plain, rtol=0.05)
