import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import words
from yearlink.llm import minhash_dedup as M
from yearlink.llm import substring_dedup as S
from yearlink.llm.components import UnionFind, components


def removed(rows, window):
    """kept words of each row by the definition"""
    starts = defaultdict(set)
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - window + 1):
            starts[tuple(w[p : p + window])].add(i)
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for p in range(len(w) - window + 1):
            ids = [j for j in starts[tuple(w[p : p + window])] if j is not None]
            if ids and (i is None or min(ids) < i):
                gone |= set(range(p, p + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


@pytest.mark.parametrize(("window", "block"), [(13, 7), (5, 3)])
def test_substring_dedup_is_the_definition(odd_docs, window, block):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in S.repeat_digest(odd_docs, window=window, block=block).collect()]
    assert Counter(got) == Counter(removed(rows, window))
    assert sum(r[2] for r in got) > 0


def test_substring_dedup_keeps_the_columns(odd_docs, no_docs):
    out = S.remove_repeats(odd_docs)
    assert out.dtypes == odd_docs.dtypes
    digests = {r.doc_id: r for r in S.repeat_digest(odd_docs).collect()}
    before = {r.doc_id: r for r in odd_docs.collect()}
    for r in out.collect():
        if r.doc_id is None:
            continue
        d = digests[r.doc_id]
        assert hashlib.sha256(b" ".join(words(r.text))).hexdigest() == d.kept_sha256
        if not d.n_removed:
            assert r.text == before[r.doc_id].text
        assert (r.lang, r.key, r.row) == (before[r.doc_id].lang, "k", "r")
    assert S.remove_repeats(no_docs).count() == 0
    assert S.repeat_digest(no_docs).count() == 0
    with pytest.raises(ValueError):
        S.repeat_digest(odd_docs, window=12)


def sets_of(rows, k):
    out = {}
    for i, t in rows:
        w = [x.lower() for x in words(t)]
        out[i] = {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def groups(sets, threshold):
    uf = UnionFind()
    ids = list(sets)
    for x, i in enumerate(ids):
        uf.find(i)
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                uf.union(i, j)
    return {i: uf.find(i) for i in ids}


@pytest.mark.parametrize(("shingle", "threshold"), [(3, 85), (5, 80)])
def test_near_duplicates_are_the_definition(spark, odd_docs, shingle, threshold):
    rng = np.random.default_rng(1)
    base = [f"v{x}" for x in rng.integers(0, 400, 120)]
    near = []
    for i in range(150):  # a group that drifts away from its base
        w = list(base)
        for p in rng.integers(0, 120, rng.integers(0, 9)):
            w[p] = "z" + str(rng.integers(0, 1000))
        near.append((200_000 + int(rng.integers(0, 10**6)), " ".join(w)))
    extra = spark.createDataFrame([(i, t, *[None] * 8) for i, t in near], odd_docs.schema)
    docs = odd_docs.union(extra)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sets = sets_of([r for r in rows if r[0] is not None], shingle)
    comp = groups(sets, threshold)
    got = M.near_duplicates(docs, shingle=shingle, threshold=threshold).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), comp[r.doc_id], comp[r.doc_id] == r.doc_id)
    stay = M.one_of_each_group(docs, shingle=shingle, threshold=threshold)
    assert stay.columns == docs.columns
    assert {r.doc_id for r in stay.collect()} == {None, *(i for i, c in comp.items() if i == c)}


def test_near_duplicates_of_nothing(no_docs):
    assert M.near_duplicates(no_docs).count() == 0


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    errors = []
    for k in range(40):
        a, b = np.unique(pool[k : k + 400]), np.unique(pool[k + 60 : k + 460])
        sig = M.super_minhash([a, b], 160, block=97)
        errors.append((sig[0] == sig[1]).mean() - 340 / 460)
    assert abs(np.mean(errors)) < 0.02
    assert np.std(errors) < (340 / 460 * 120 / 460 / 160) ** 0.5 * 1.1
    assert (M.super_minhash([a], 160) == M.super_minhash([b, a], 160)[1:]).all()


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(200)]
    pairs += [(5000, 5001 + i) for i in range(500)]
    uf = UnionFind()
    for a, b in pairs:
        if a != b:
            uf.union(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long").repartition(7)).collect()}
    assert got == {x: uf.find(x) for x in uf.up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
