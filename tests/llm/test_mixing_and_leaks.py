import math
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SF, words
from yearlink.llm import decontaminate as D
from yearlink.llm import mixing as X
from yearlink.llm.common import read


# ------------------------------------------------------------ mixing
def skewed(spark):
    rows = [(i, "big" if i % 3 == 0 else f"s{i % 7}" if i % 5 else None, "w " * (i % 40)) for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def sql_rows(docs, sql):
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    return sorted((tuple(r) for r in con.sql(sql).fetchall()), key=repr)


def test_mixing_matches_sql(spark):
    docs = skewed(spark)
    got = sorted((tuple(r) for r in X.mixed(docs).collect()), key=repr)
    assert got == sql_rows(docs, X.SQL)


@pytest.mark.parametrize(("entropy", "repeats", "budget"), [(0.5, 4.0, None), (0.99, 1.2, None), (1.0, 50.0, 30_000), (0.95, 4.0, 500)])
def test_weights_budget_and_passes(spark, entropy, repeats, budget):
    docs = skewed(spark)
    got = X.mixed(docs, entropy=entropy, repeats=repeats, budget=budget, block_tokens=200).collect()
    size, tokens = {}, defaultdict(int)
    for r in docs.collect():
        size[r.doc_id] = (r.source, len(words(r.text)))
        tokens[r.source] += len(words(r.text))
    total = sum(tokens.values())
    budget = budget or total
    weight = {r.source: r.weight for r in got}
    assert sum(weight.values()) == pytest.approx(1, abs=1e-6)
    # the weights are powers of the shares
    big = max(tokens, key=tokens.get)
    t = {round(math.log(weight[s] / weight[big]) / math.log(tokens[s] / tokens[big]), 3) for s in weight if abs(tokens[s] - tokens[big]) > 100}
    assert len(t) == 1
    most = max(budget * weight[s] / tokens[s] for s in weight)
    level = -sum(w * math.log(w) for w in weight.values()) / math.log(len(weight))
    assert most <= repeats + 1e-3
    assert level >= entropy - 1e-6 or most == pytest.approx(repeats, rel=1e-3)
    used, passes = defaultdict(int), defaultdict(lambda: defaultdict(list))
    for r in got:
        assert size[r.doc_id] == (r.source, r.n_tokens)
        used[r.source] += r.n_tokens
        passes[r.source][r.epoch].append((r.block_rank, r.place, r.doc_id))
    for s, w in weight.items():
        quota = round(w * budget)
        assert quota - 40 <= used[s] <= quota + 1
        for e, uses in passes[s].items():
            ids = [i for _, _, i in uses]
            assert len(set(ids)) == len(ids)  # a document once in a pass
            if e < max(passes[s]):
                assert len(ids) == sum(x == s for x, _ in size.values())
        orders = [[i for _, _, i in sorted(u)] for u in passes[s].values() if len(u) > 20]
        assert len({tuple(o[:20]) for o in orders}) == len(orders)  # every pass in an order of its own


def test_mixing_odd_documents(odd_docs, no_docs):
    got = X.mixed(odd_docs).collect()
    assert "" in {r.source for r in got}
    assert None not in {r.source for r in got}  # only texts without words
    assert None in {r.source for r in X.mixed(odd_docs.withColumn("source", odd_docs.lang)).collect()}
    assert X.mixed(no_docs).count() == 0
    assert X.mixed(odd_docs.where("text is null")).count() == 0


def test_mixing_has_no_python_on_its_plan(spark):
    plan = X.mixed(skewed(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ------------------------------------------------------------ leaks
ITEM = "A train leaves Boston at 9 am with 120 km to go and meets Anna after 3 hours on the road to Denver"


def found(spark, texts, items, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r.n_tokens for r in D.leaks(docs, bench, **how).collect()}


def test_template():
    tokens, values = D.template("Bob paid Mary 12 dollars, or $5.5 for 3km.\nThen 10% of it left Rome!")
    assert tokens == [
        "bob", "paid", "<name>", "<num>", "<unit>", "or", "<unit>", "<num>", "for", "<num>", "<unit>",
        "then", "<num>", "<unit>", "of", "it", "left", "<name>",
    ]
    assert values[2:5] == ["mary", "12", "dollars"] and values[6:8] == ["$", "5.5"]
    assert D.template(None) == ([], []) == D.template(" ... !? \n")


def test_copies_and_changed_parameters_are_caught(spark):
    changed = ITEM.replace("Boston", "Paris").replace("120 km", "75.5 miles").replace("Anna", "Bob").replace("Denver", "Lyon")
    texts = [
        "Intro words. " + ITEM + " and more text after it.",
        "He said: " + changed + ". End",
        ITEM.upper(),
        "A train leaves the town at noon and nobody meets it on the way to the sea or anywhere else at all",
        None,
        "",
    ]
    got = found(spark, texts, [ITEM, None, "too short"])
    assert {k[0] for k in got} == {0, 1, 2}
    assert all(k[1] == 0 for k in got) and got[0, 0] >= 18


RICH = (
    "Alice Brown of New York met Carl Gauss in Bonn on 3 May. Alice gave Carl 12 old books about Euler and Rome."
    " How many books does Carl Gauss own in Bonn now?"
)


def test_copies_in_other_letters_and_lines_are_found_whole(spark):
    n = len(D.template(RICH)[0])
    wrapped = [RICH.replace(" ", "\n"), RICH.replace(" Gauss", "\nGauss")]
    texts = [RICH, RICH.lower(), RICH.upper(), *wrapped, f"He asked: {RICH}", f"then he asked {RICH} and left"]
    got = found(spark, texts, [RICH])
    assert got == {(d, 0): n for d in range(len(texts))}


def test_short_items_inside_a_sentence_are_found(spark):
    item = "What colour is the sky over Paris today?"
    n = len(D.template(item)[0])
    assert n == 8
    texts = [item, f"she asked what {item.lower()} then", f"she asked {item} Then", "She asked What colour is the sky over Rome today then"]
    assert found(spark, texts, [item]) == {(d, 0): n for d in range(4)}


def test_changed_names_that_open_sentences_are_found(spark):
    changed = RICH.replace("Alice", "Dora").replace("Carl", "Emil").replace("12", "40").replace("Bonn", "Wien")
    n = len(D.template(RICH)[0])
    mixed = changed.replace("Emil 40", "Dora 40")  # one name for two
    got = found(spark, [changed, changed.replace(" ", "\n"), mixed], [RICH])
    assert got[0, 0] == got[1, 0] == n and got.get((2, 0), 0) < n


def test_texts_with_like_words_are_left_alone(spark):
    texts = [
        "Alice Brown met Emil. Carl wrote 12 letters about Rome. How many books are old now? Euler lived in Bonn.",
        "In Bonn Alice Brown of New York met Carl. 3 May is a day on which he gave all he had.",
        " ".join(reversed(RICH.split())),
    ]
    assert found(spark, texts, [RICH]) == {}


def test_an_item_with_two_texts_is_reported_once(spark):
    docs = spark.createDataFrame([(1, f"{RICH} {ITEM}")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, RICH), (5, ITEM)], "item_id long, text string")
    (row,) = D.leaks(docs, bench).collect()
    assert (row.doc_id, row.item_id, row.n_tokens) == (1, 5, max(len(D.template(t)[0]) for t in (RICH, ITEM)))


DENSE = "A train travels 60 km in 2 h and 90 km in 3 h."


def test_items_dense_in_numbers_and_names_are_found(spark):
    changed = DENSE.replace("60", "75").replace("2 h", "4 h").replace("90", "85").replace("3 h", "5 h")
    table = "3 4 5 6 7 8 9 10 11 12"  # no real word at all
    texts = [f"Some words before. {DENSE} Some more after.", f"Here:\n{changed}", f"see {table} there", "12 11 10 9 8 7 6 5 4 3"]
    n = len(D.template(DENSE)[0])
    assert found(spark, texts, [DENSE, table]) == {(0, 0): n, (1, 0): n, (2, 1): 10}


def test_one_window_with_enough_words_finds_the_whole_copy(spark):
    """A hit used to count for the window's 8 tokens only, too few."""
    item = "12 km 5 kg two words stand here now 7 km 8 kg"
    n = len(D.template(item)[0])
    assert found(spark, [f"x y {item} z", item.replace("12", "14")], [item]) == {(0, 0): n, (1, 0): n}


def test_passages_are_the_longest_equal_templates():
    import random

    rng = random.Random(7)
    for _ in range(60):
        words = ["5", "7", "km", "a", "b", "c", "d"]
        item = [rng.choice(words) for _ in range(rng.randint(8, 40))]
        a, b = sorted((rng.randint(0, len(item)), rng.randint(0, len(item))))
        doc = [rng.choice(words) for _ in range(9)] + item[a:b] + [rng.choice(words) for _ in range(9)]
        docs, bench = D.Templates([" ".join(doc)]), D.Benchmark([(1, " ".join(item))], D.WINDOW, D.LITERALS)
        x, y = docs.tokens[0], bench.text.tokens[0]
        got = {(p, q, n) for _, _, p, q, n in D._passages(docs, bench, D.WINDOW, D.LITERALS)}
        for p in range(len(x)):
            for q in range(len(y)):
                if p and q and x[p - 1] == y[q - 1]:
                    continue
                n = 0
                while p + n < len(x) and q + n < len(y) and x[p + n] == y[q + n]:
                    n += 1
                real = sum(t not in D._SLOTS for t in x[p : p + n])
                if n >= D.WINDOW and real >= D.LITERALS:
                    assert (p, q, n) in got
        for p, q, n in got:
            assert x[p : p + n] == y[q : q + n]


def test_slots_have_to_be_consistent():
    item = D.template("on day 3 the team of 5 met 3 others and 5 left")
    good = D.template("on day 8 the team of 2 met 8 others and 2 left")
    bad = D.template("on day 8 the team of 2 met 9 others and 2 left")
    assert item[0] == good[0] == bad[0]
    n = len(item[0])
    assert D.consistent_length(*good, *item) == n
    assert D.consistent_length(*bad, *item) < n


def test_consistent_length_is_the_longest_one_to_one_stretch():
    import random

    rng = random.Random(4)
    for _ in range(200):
        kinds = [rng.choice(["<num>", "<name>", "w"]) for _ in range(rng.randint(1, 9))]
        x = [rng.choice("abc") for _ in kinds]
        y = [rng.choice("abc") for _ in kinds]

        def fine(a, b, kinds=kinds, x=x, y=y):
            pairs = {(k, p, q) for k, p, q in zip(kinds[a:b], x[a:b], y[a:b], strict=True) if k != "w"}
            return len({p[:2] for p in pairs}) == len(pairs) == len({(p[0], p[2]) for p in pairs})

        want = max(b - a for a in range(len(kinds)) for b in range(a, len(kinds) + 1) if fine(a, b))
        assert D.consistent_length(kinds, y, kinds, x) == want


def test_leaks_on_the_tables_are_the_shared_passages(spark):
    folder = "/root/testdata/sf0.01"
    norm = lambda t: [w.strip(".,;:!?\"'()").lower() for w in t.split()]
    items = read(spark, folder, "benchmark").collect()
    docs = read(spark, folder, "documents")
    index = defaultdict(set)
    for r in items:
        w = norm(r.text)
        for p in range(len(w) - 12):
            index[tuple(w[p : p + 13])].add(r.item_id)
    want = set()
    for r in docs.collect():
        w = norm(r.text)
        for p in range(len(w) - 12):
            want |= {(r.doc_id, i) for i in index.get(tuple(w[p : p + 13]), ())}
    bench = read(spark, folder, "benchmark")
    got = {(r.doc_id, r.item_id) for r in D.leaks(docs, bench).collect()}
    assert got == want and want
    old, D.BLOCK = D.BLOCK, 300  # many blocks of items
    try:
        assert {(r.doc_id, r.item_id) for r in D.leaks(docs, bench).collect()} == want
    finally:
        D.BLOCK = old
    left = D.clean(docs, bench)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_leaks_of_odd_documents(spark, odd_docs, no_docs):
    text = odd_docs.where("doc_id = 3").first().text
    bench = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None), (3, "")], "item_id long, text string")
    got = D.leaks(odd_docs, bench).collect()
    assert {r.item_id for r in got} == {1}
    assert {r.doc_id for r in got} >= {None, 3, 100_005, 100_006}
    assert D.leaks(odd_docs, bench.limit(0)).count() == 0
    assert D.leaks(no_docs, bench).count() == 0
    assert D.clean(odd_docs, bench).where("doc_id is null").count() == 2


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = read(spark, SF, "documents")
    lengths = []
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == read(spark, SF, "documents").columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert all(r.n_chars == len(r.text) for r in docs.collect())
        lengths.append(docs.count())
    assert lengths == sorted(lengths, reverse=True) and 0 < lengths[-1] < 200
    uses = P.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in uses} <= {r.doc_id for r in docs.collect()}
    assert len(uses) > 0.8 * lengths[-1]


def test_pipeline_with_odd_rows_and_column_names(spark, odd_docs, no_docs):
    import corpus_pipeline as P

    names = ["my col", "a.b", "a:b", "_llm_gone", "_llm_out", "_llm_bad", "_llm_leak", "q`q"]
    for docs in (odd_docs, no_docs):
        for name in names:
            docs = docs.withColumn(name, F.lit(name))
        start = docs.columns
        for _, stage in P.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == start
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        rows = docs.collect()
        assert all(r[n] == n for r in rows for n in names)
        uses = P.STAGES[-1][1](spark, docs, SF).collect()
        assert bool(uses) == bool(rows) and {r.doc_id for r in uses} <= {r.doc_id for r in rows}
    assert not rows
