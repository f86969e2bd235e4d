import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import SF
from yearlink.llm import collocations, license_scan, queries, spelling
from yearlink.llm.license_rules import GATES, RULES, SHORT

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    return c


@pytest.mark.parametrize("name", ["op11_license_scan", "op12_spelling_variants", "op13_collocations"])
def test_query_equals_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE[name]).to_arrow_table()
    assert sorted(df.columns) == sorted(want.column_names)
    key = sorted(df.columns)
    got = Counter(tuple(r) for r in df.select(key).collect())
    assert got == Counter(tuple(r[k] for k in key) for r in want.to_pylist())


# --- license scan -----------------------------------------------------------


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute_detections(text):
    words = words_of(text)
    norm = " " + "  ".join(f"{w}={i}" for i, w in enumerate(words)) + " "
    spans = []
    for i, cls, label, conf, key, pattern in license_scan.rules():
        if key in norm:
            for m in re.finditer(pattern, norm):
                at = [int(x) for x in re.findall(r"=([0-9]+)", m.group())]
                spans.append((at[0], at[-1], i, label, conf, cls))
    base = [s for s in spans if s[5] == 0]
    rest = [s for s in spans if s[5] > 0]
    kept = [
        d
        for d in rest
        if not any(
            (e[5] <= d[5] and e[0] <= d[0] and e[1] >= d[1] and (e[:2] != d[:2] or e[5] < d[5] or e[2] < d[2]))
            or (e[5] < d[5] and e[0] <= d[1] and e[1] >= d[0])
            for e in rest
            if e is not d
        )
    ]
    return len(words), sorted(b[:3] for b in base), sorted(k[:3] for k in kept)


def examples(words, rng, n=6):
    """Texts that a rule's pattern matches, drawn at random."""

    def draw(p):
        out, i = "", 0
        while i < len(p):
            if p[i] == "(":
                depth, j, cuts = 1, i + 1, [i]
                while depth:
                    depth += (p[j] == "(") - (p[j] == ")")
                    if p[j] == "|" and depth == 1:
                        cuts.append(j)
                    j += 1
                cuts.append(j - 1)
                options = [p[a + 1 : b] for a, b in itertools.pairwise(cuts)]
                some = j < len(p) and p[j] == "?"
                if not some or rng.random() < 0.5:
                    out += draw(rng.choice(options))
                i = j + some
            elif p[i] == "[":
                j = p.index("]", i)
                body = p[i + 1 : j]
                out += rng.choice("0123456789") if body == "0-9" else rng.choice(body)
                i = j + 1 + (j + 1 < len(p) and p[j + 1] == "+")
            elif i + 1 < len(p) and p[i + 1] == "?":
                out += p[i] if rng.random() < 0.5 else ""
                i += 2
            else:
                out += "whatsit" if p[i] == "_" else p[i]
                i += 1
        return out

    return [draw(words) for _ in range(n)]


def test_rules_are_gated_by_words_that_every_match_holds():
    rng = random.Random(5)
    numbered = license_scan.rules()[len(license_scan.BASE) :]
    lines = RULES.strip().splitlines()
    assert len(lines) >= 300 and len(set(lines)) == len(lines)
    for line, (_, cls, _, conf, key, pattern) in zip(lines, numbered, strict=True):
        words = line.split(" | ")[4]
        assert 1 <= cls <= 4 and 0 < conf < 1
        for text in examples(words, rng):
            norm = " " + "  ".join(f"{w}={i}" for i, w in enumerate(text.split())) + " "
            assert re.search(pattern, norm), (line, text)
            assert key in norm, (line, text)
            assert any(g in text for g in GATES) or any(f" {s} " in f" {text} " for s in SHORT), (line, text)


def test_detections_equal_a_brute_force(spark):
    rng = random.Random(11)
    lines = [x.split(" | ")[4] for x in RULES.strip().splitlines()]
    texts = [None, "", " \n", "The MIT License.", "mit license MIT-License mit\tlicense", "LİCENSE mit licence", "x" * 50_000]
    texts += [" ".join(examples(w, rng, 1)) for w in lines]
    for _ in range(60):
        parts = [examples(rng.choice(lines), rng, 1)[0] for _ in range(rng.randint(2, 30))]
        cut = [" ".join(p.split()[rng.randint(0, 2) :]) for p in parts]
        texts.append(rng.choice([" ", ", ", "\n- ", " lorem ipsum "]).join(cut).title())
    texts.append("Licensed under the Apache License, Version 2.0. " * 700 + "CC BY-SA 4.0 " * 700)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, norm string").repartition(4)
    got = {r.doc_id: r for r in license_scan.detections(df).collect()}
    for i, t in enumerate(texts[:-1]):
        n, base, kept = brute_detections(t)
        r = got[i]
        assert r.n_words == n, t
        assert sorted((x.start, x.end, x.rule) for x in r.base) == base
        assert sorted((x.start, x.end, x.rule) for x in r.found) == kept, t
    long = got[len(texts) - 1]
    assert len(long.base) == 700 and len(long.found) == 1400


def test_scan_digest_of_odd_rows(spark, odd_docs, no_docs):
    rows = license_scan.scanned(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert 0 <= r.score <= 1 and (r.n_base == 0) == (r.first_word is None) == (r.base_labels == "")
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert license_scan.scanned(no_docs).collect() == []
    plan = license_scan.scanned(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.split("InMemoryTableScan")[0]


# --- spelling variants ------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


WORD = st.text(alphabet="abéÿ", min_size=7, max_size=9)


@settings(max_examples=120, deadline=None)
@given(st.lists(WORD, min_size=1, max_size=60, unique=True))
def test_scans_find_all_pairs_once(words):
    n = np.arange(2, 2 + len(words))
    want = {w: sorted(v for v in words if one_edit(w, v)) for w in words}
    found = defaultdict(int)
    best = {}
    for back in (False, True):
        keys = [w[::-1] for w in words] if back else words
        for r in spelling._best(keys, n, keys, back).to_pylist():
            found[r["word"]] += r["n_near"]
            best[r["word"]] = max(best.get(r["word"], (0, "")), (r["best_n"], r["best"]))
    size = dict(zip(words, n.tolist(), strict=True))
    for w in words:
        assert found[w] == len(want[w])
        if want[w]:
            assert best[w] == max((size[v], v) for v in want[w])


@settings(max_examples=60, deadline=None)
@given(st.lists(WORD, min_size=2, max_size=40, unique=True), st.integers(1, 6))
def test_queries_reach_every_block_that_may_hold_a_near_word(words, size):
    words = sorted(words)
    index = [(i, words[i], words[min(i + size, len(words)) - 1]) for i in range(0, len(words), size)]
    import pyarrow as pa

    (out,) = spelling._router(index, 3)(iter([pa.record_batch([pa.array(words)], names=["key"])]))
    routed = set(zip(out.column(1).to_pylist(), out.column(0).to_pylist(), strict=True))
    for a in words:
        for k, b in enumerate(words):
            if one_edit(a, b) and a[:3] == b[:3]:
                assert (a, k // size * size) in routed


def brute_variants(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            if len(run) >= 7:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if h % 31 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= 2 and len(w) >= 7}
    out = {}
    for w, k in n.items():
        near = [v for v in n if one_edit(w, v)]
        top = min(near, key=lambda v: (-n[v], v), default=None)
        form = top if top is not None and n[top] >= 10 * k else None
        out[w] = (form, k, len(near), n[form] if form else None)
    res = set()
    for w, (form, k, near, fn) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        res.add((w, form, root, k, near, fn))
    return res


@pytest.mark.parametrize("block", [50_000, 40])
def test_variants_equal_a_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    rng = random.Random(3)
    base = ["standard", "sección", "ciónabcd", "unterwegs", "aaaaaaaa", "ÿber×llig"]
    rows = [(None, "standard standard"), (1, None), (2, ""), (3, "w" * 3000 + " " + "w" * 3000), (4, "Short ÀÉÎÕÜÝÞ àéîõüýþ")]
    for d in range(60):
        words = []
        for _ in range(80):
            w = list(rng.choice(base) + rng.choice(["", "a", "ab"]))
            if rng.random() < 0.25:
                i = rng.randrange(len(w))
                w[i : i + rng.randint(0, 1)] = rng.choice(["x", "", "xy", "é"])
            words.append("".join(w))
        rows.append((10 + d, " ".join(words + ["standard"] * 40)))
    rows += rows[-3:]
    df = spark.createDataFrame([(i, t, 1, "b") for i, t in rows], "doc_id long, text string, n int, block string").repartition(3)
    got = spelling.variant_groups(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in got.collect()} == brute_variants(rows)


def test_variants_of_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert {tuple(r) for r in spelling.variant_groups(odd_docs).collect()} == brute_variants(rows)
    assert spelling.variant_groups(no_docs).collect() == []


# --- collocations -----------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=80), max_size=12), st.integers(2, 9))
def test_summaries_keep_every_frequent_key(runs, threshold):
    total = Counter(itertools.chain.from_iterable(runs))
    mass = sum(total.values())
    s = collocations.Summary(mass // threshold)
    for r in runs:
        c = Counter(r)
        s.add(np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)]))
        s.merge()
    assert len(s.keys) <= s.capacity and s.lost < threshold
    kept = set(s.frequent(threshold).tolist())
    assert {k for k, n in total.items() if n >= threshold} <= kept <= set(total)


def brute_collocations(rows, threshold, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    f = {k: v for k, v in f.items() if v >= threshold}
    out = defaultdict(list)
    for (lang, g), a in f.items():
        if len(g) < 2:
            continue
        inside = [b for (x, h), b in f.items() if x == lang and len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h)))]
        if any(100 * b >= 80 * a for b in inside):
            continue
        cuts = [(2000000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g))]
        score, _, left, right = min(cuts)
        out[lang].append((-score, -a, " ".join(g).encode(), left, right))
    return {
        (lang, i + 1, g.decode(), -a, left, right, n[lang], -s)
        for lang, found in out.items()
        for i, (s, a, g, left, right) in enumerate(sorted(found)[:top])
    }


@pytest.mark.parametrize("ranges", [16_000_000, 300])
def test_collocations_equal_a_brute_force(spark, monkeypatch, ranges):
    monkeypatch.setattr(collocations, "RANGE_SIZE", ranges)
    monkeypatch.setattr(collocations, "CHUNK_SIZE", 500)
    monkeypatch.setattr(collocations, "_LONG_TEXT", 300)
    rng = random.Random(9)
    vocab = ["the", "The", "of", "red", "fox", "é", "\x1c", "a-b", "漢", "und"]
    rows = [(None, None), ("en", ""), ("en", " \t\n"), ("und", "red fox " * 50), (None, "red fox. " * 50), ("de", ".,;")]
    for _ in range(80):
        sep = [" ", "  ", "\t", ", ", ". ", "\n", "\x0b"]
        rows.append((rng.choice(["en", "de", None]), "".join(rng.choice(vocab) + rng.choices(sep, [20, 2, 2, 1, 1, 1, 1])[0] for _ in range(60))))
    rows += [rows[-1]] * 40
    df = spark.createDataFrame([(t, x, 1, 2, "p") for x, t in rows], "text string, lang string, f int, words int, phrase string").repartition(3)
    for threshold, top in ((8, 2000), (30, 5)):
        got = {tuple(r) for r in collocations.collocations(df, threshold=threshold, top=top).collect()}
        assert got == brute_collocations(rows, threshold, top)


def test_collocations_of_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.lang, r.text) for r in odd_docs.collect()]
    assert {tuple(r) for r in collocations.collocations(odd_docs).collect()} == brute_collocations(rows, 30, 2000)
    assert collocations.collocations(no_docs).collect() == []
