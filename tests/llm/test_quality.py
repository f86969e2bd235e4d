import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import SF, words
from yearlink.llm import docstats as D
from yearlink.llm import quality_classifier as Q
from yearlink.llm import rule_cascade as R


def fold(i, k):
    return zlib.crc32(str(i).encode()) % k


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_classifier_on_the_held_out_fold(spark, labels):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = {r.doc_id: r for r in Q.quality_scores(docs, labels).collect()}
    assert len(got) == docs.count()
    held = [i for i in truth if got[i].held_out]
    assert all(r.held_out == (fold(i, 5) == 0) and 0 <= r.score <= 1 for i, r in got.items())
    assert all(r.predicted == int(r.score >= 0.3) for r in got.values())
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.95
    assert np.mean([got[i].predicted == 1 for i in truth if truth[i] == 1]) > 0.98


def test_held_out_labels_do_not_teach(spark, labels):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    turned = labels.selectExpr(
        "doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) as quality", "'x' as score"
    )
    a, b = Q.quality_scores(docs, labels), Q.quality_scores(docs, turned)
    assert {r.doc_id: round(r.score, 9) for r in a.collect()} == {r.doc_id: round(r.score, 9) for r in b.collect()}


def test_classifier_with_odd_rows(spark, odd_docs, no_docs, labels):
    odd_labels = spark.createDataFrame([(None, 1), (1, None), (2, 7), (3, 1), (3, 1), (4, 0)], "doc_id long, quality int")
    got = Q.quality_scores(odd_docs, labels.select("doc_id", "quality").union(odd_labels)).collect()
    assert len(got) == odd_docs.count()
    assert all(0 <= r.score <= 1 and (r.held_out is None) == (r.doc_id is None) for r in got)
    none = Q.quality_scores(odd_docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert Q.quality_scores(no_docs, labels).count() == 0
    assert Q.good_documents(odd_docs, labels).columns == odd_docs.columns


def test_discriminant_is_the_density_ratio():
    rng = np.random.default_rng(0)
    x = {0: rng.normal(0, 1, (300, 3)), 1: rng.normal(1, 2, (500, 3))}
    moments = {k: (lambda z: z.T @ z)(np.column_stack((np.ones(len(v)), v))) for k, v in x.items()}
    model = Q.Discriminant(moments, pooled=0.0, sphere=0.0)
    at = rng.normal(0, 2, (20, 3))

    def log_density(v):
        cov = np.cov(v.T)
        d = at - v.mean(axis=0)
        return -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1]

    odds = log_density(x[1]) - log_density(x[0]) + np.log(500 / 300)
    assert np.allclose(model.score(at), 1 / (1 + np.exp(-odds)), atol=1e-6)


def test_rules_are_the_definition(odd_docs, no_docs):
    texts = {}
    for r in odd_docs.select("doc_id", "text").collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    got = R.judged(odd_docs).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        if len(set(texts[r.doc_id])) > 1:
            continue
        t = texts[r.doc_id][0] or ""
        w = words(t)
        wins = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        seen = {}
        for k, x in enumerate(wins):
            seen.setdefault(x, []).append(k)
        hit = {k + o for ks in seen.values() if len(ks) > 1 for k in ks for o in range(8)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        assert (r.n_words, r.word_chars) == (len(w), sum(len(x.decode()) for x in w))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t)
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == len(hit)
        assert r.base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w))
        assert not (r.base_failed and r.kept)
    assert R.judged(no_docs).count() == 0


def test_the_order_of_the_rules_does_not_matter(odd_docs):
    batch = pa.array([r.text for r in odd_docs.select("text").collect()])
    want = np.ones(len(batch), bool)
    for r in R.RULES:
        want &= ~r.rejects(D.Stats(batch))
    for seed in range(8):
        order = tuple(np.random.default_rng(seed).permutation(np.array(R.RULES, object)))
        assert (R.kept_by(D.Stats(batch), order) == want).all()


def test_plan_puts_the_most_rejections_a_second_first(spark):
    docs = spark.createDataFrame([("a",)] * 30 + [("b " * 30,)] * 10, "text string")
    cheap, never = R.Rule("cheap", lambda s: s.chars < 5), R.Rule("never", lambda s: s.repeated_words < 0)
    assert [r.name for r in R.plan(docs, rules=(never, cheap))] == ["cheap", "never"]


def test_rules_match_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    got = sorted(tuple(r) for r in R.judged(spark.read.parquet(f"{SF}/documents.parquet")).collect())
    assert got == sorted(con.sql(R.SQL).fetchall())
