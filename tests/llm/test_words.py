import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from yearlink.llm import common as C
from yearlink.llm import docstats as D

TEXT = st.one_of(st.none(), st.text(alphabet=" \n\t\x0b\x0c\r\x1c abAB#é漢", max_size=60))


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_words_are_those_of_bytes_split(texts):
    w = C.tokenize(pa.array(texts, pa.string()))
    seen = {}
    for i, t in enumerate(texts):
        span = range(w.first[i], w.first[i + 1])
        assert [w.buf[w.start[k] : w.end[k]].tobytes() for k in span] == (t or "").encode().split()
        for k in span:
            word = w.buf[w.start[k] : w.end[k]].tobytes()
            assert seen.setdefault(word, w.hash[k]) == w.hash[k]
    assert len(set(seen.values())) == len(seen)


def test_hashes_do_not_depend_on_the_place(monkeypatch):
    texts = pa.array(["alpha beta gamma " * 40, "gamma", "x" * 500 + " beta"])
    whole = C.tokenize(texts).hash
    monkeypatch.setattr(C, "_PIECE", 16)
    assert (C.tokenize(texts).hash == whole).all()
    assert (C.tokenize(pa.array(["ALPHA Beta"]), lower=True).hash == whole[:2]).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=50), st.integers(1, 9))
def test_packing_round_trip(values, buckets):
    v = np.array(sorted(values), np.uint64)
    assert (C.unpack_sorted(C.pack_sorted(v)) == v).all()
    assert (C.unpack(C.pack(v[::-1])) == v[::-1]).all()
    cut = C.bounds(v, buckets, 64)
    assert cut[0] == 0 and cut[-1] == len(v)
    for b in range(buckets):
        assert all(int(x) * buckets >> 64 == b for x in v[cut[b] : cut[b + 1]])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n#!A", max_size=80)), max_size=4))
def test_statistics_match_plain_python(texts):
    s = D.Stats(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        t = t or ""
        w = t.split()
        assert s.n_words[i] == len(w)
        assert s.word_chars[i] == sum(map(len, w))
        assert s.symbols[i] == sum(c in "#*$%&|<>" for c in t)
        assert s.distinct_words[i] == len(set(w))
        assert s.same_as_previous[i] == sum(a == b for a, b in zip(w, w[1:], strict=False))
        lines = [x for x in t.split("\n") if x.split()]
        assert s.n_lines[i] == len(lines)
        assert s.duplicate_lines[i] == len(lines) - len(set(lines))
        wins = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        hit = {k + o for k, x in enumerate(wins) if wins.count(x) > 1 for o in range(8)}
        assert s.repeated_words[i] == len(hit)


def test_slices_bound_the_bytes(spark):
    batch = pa.record_batch([pa.array(["x" * 10] * 100 + ["y" * 1000])], names=["t"])
    parts = list(C.slices(iter([batch]), "t", rows=40, size=100))
    assert sum(p.num_rows for p in parts) == 101
    assert all(p.num_rows == 1 or sum(map(len, p.column(0).to_pylist())) <= 100 for p in parts)
