"""C1/C2 chaining and J11 reconciliation.

C1 is held against its definition as a fixed point on random graphs, C2
against expected tables written by hand.
"""

import random

from yearlink.plans.chain import chain_by_code, chain_by_description
from yearlink.plans.reconcile import reconcile

EDGE_SCHEMA = (
    "row_id long, year_n int, code_n string, description_n string, "
    "year_n1 int, code_n1 string, description_n1 string, combined double"
)


def _edges(spark, rows):
    """rows: (row_id, (year, code, text), (year, code, text), combined)"""
    return spark.createDataFrame([(i, *n, *n1, c) for i, n, n1, c in rows], EDGE_SCHEMA)


def _mapped(df):
    return {r.row_id: r.mapped_2023_code for r in df.collect()}


def _random_rows(seed):
    """A third of the rows share one code, some codes are NULL."""
    rnd = random.Random(seed)
    rows = []
    for i in range(60):
        y = rnd.choice([2019, 2020, 2021, 2022])
        code = lambda: None if rnd.random() < 0.1 else "hot" if rnd.random() < 0.33 else f"c{rnd.randrange(8)}"
        rows.append((i, (y, code(), f"t{i}"), (y + 1, code(), f"u{i}"), rnd.random()))
    return rows


def test_c1_is_the_fixed_point_of_its_definition(spark):
    for seed in range(4):
        rows = _random_rows(seed)
        # the latest row that enters a node stands for it; a reached row hands
        # its largest seed on to the row that stands for its own source
        stands = {}
        for i, _, (y1, c1, _), _ in rows:
            if c1 is not None:
                stands[y1, c1] = max(i, stands.get((y1, c1), -1))
        top = {i: i if n1[0] == 2023 else None for i, _, n1, _ in rows}
        changed = True
        while changed:
            changed = False
            for i, n, _, _ in rows:
                to = stands.get((n[0], n[1])) if n[1] is not None else None
                if to is not None and top[i] is not None and (top[to] is None or top[to] < top[i]):
                    top[to], changed = top[i], True
        want = {i: None if s is None else (rows[s][2][1], rows[s][2][2]) for i, s in top.items()}
        got = chain_by_code(_edges(spark, rows)).collect()
        assert {r.row_id: None if r.mapped_2023_description is None else (r.mapped_2023_code, r.mapped_2023_description) for r in got} == want


def test_c2_follows_texts_to_the_anchor(spark):
    rows = [
        # three hops, texts differ in case and outer blanks
        (0, (2020, "a", "Raw hides "), (2021, "b", "raw HIDES, wet"), 0.9),
        (1, (2021, "b", " Raw hides, wet"), (2022, "c", "Hides"), 0.9),
        (2, (2022, "c", "hides"), (2023, "d", "Hides and skins"), 0.9),
        # a gap of the calendar: straight from 2020 to 2022
        (3, (2020, "e", "skins"), (2022, "c", "HIDES"), 0.5),
        # ends in 2022 without a way on
        (4, (2021, "f", "tin"), (2022, "g", "tin bars"), 0.9),
        (5, (2020, "f", "tin ore"), (2021, "f", "Tin"), 0.9),
        # no text on the way
        (6, (2021, "h", "lead"), (2022, "i", None), 0.9),
        (7, (2022, "i", None), (2023, "k", "lead bars"), 0.9),
    ]
    out = {r.row_id: (r.mapped_2023_code, r.hops) for r in chain_by_description(_edges(spark, rows)).collect()}
    assert out == {
        0: ("d", 3), 1: ("d", 2), 2: ("d", 1), 3: ("d", 2), 4: (None, None), 5: (None, None), 6: (None, None), 7: ("k", 1),
    }


def test_c2_of_a_repeated_text_takes_the_best_edge(spark):
    rows = [
        (0, (2021, "a", "wool"), (2022, "b", "yarn"), 0.4),
        (1, (2022, "b", "yarn"), (2023, "x", "yarn x"), 0.2),
        (2, (2022, "c", "Yarn"), (2023, "y", "yarn y"), 0.8),
        (3, (2022, "d", "YARN"), (2023, "z", "yarn z"), None),
        # equal scores: the later row
        (4, (2021, "e", "silk"), (2022, "f", "thread"), 0.4),
        (5, (2022, "f", "thread"), (2023, "p", "p"), 0.5),
        (6, (2022, "g", "thread"), (2023, "q", "q"), 0.5),
    ]
    assert _mapped(chain_by_description(_edges(spark, rows))) == {0: "y", 1: "x", 2: "y", 3: "z", 4: "q", 5: "p", 6: "q"}


def test_c2_with_a_third_of_the_rows_on_one_text(spark):
    rows = [(i, (2021, None, "hot" if i % 3 == 0 else f"t{i}"), (2022, None, "hot" if i % 3 == 0 else f"u{i}"), 0.5) for i in range(300)]
    rows += [(1000, (2022, None, "hot"), (2023, "anchor", "end"), 0.5)]
    got = _mapped(chain_by_description(_edges(spark, rows)))
    assert {i for i, c in got.items() if c == "anchor"} == {1000, *range(0, 300, 3)}


def test_fan_in_and_null_codes(spark):
    rows = [
        (0, (2021, "a", "A"), (2022, "x", "X"), 0.5),
        (1, (2021, "b", "B"), (2022, "x", "X"), 0.5),
        (2, (2022, "x", "X"), (2023, "z", "Z"), 0.5),
        (3, (2021, None, "C"), (2022, None, "Y"), 0.5),
    ]
    # by code only the last row of node (2022, x) is linked; by text both are
    assert _mapped(chain_by_code(_edges(spark, rows))) == {0: None, 1: "z", 2: "z", 3: None}
    assert _mapped(chain_by_description(_edges(spark, rows))) == {0: "z", 1: "z", 2: "z", 3: None}


def test_reconcile_status(spark):
    schema = "year_n int, item_id_n long, year_n1 int, item_id_n1 long, combined double"
    fwd = spark.createDataFrame([(1, 1, 2, 10, 0.9), (1, 2, 2, 11, 0.4), (1, 3, 2, 12, 0.3)], schema)
    rev = spark.createDataFrame([(1, 1, 2, 10, 0.8), (1, 2, 2, 13, 0.6)], schema)
    got = {r.item_id_n: (r.status, r.item_id_n1, r.conflict) for r in reconcile(fwd, rev).collect()}
    assert got == {1: ("mutual", 10, False), 2: ("conflict", 13, True), 3: ("one_way", 12, False)}


def test_reconcile_ties_and_fan_in(spark):
    schema = "year_n int, item_id_n long, year_n1 int, item_id_n1 long, combined double"
    fwd = spark.createDataFrame([(1, 1, 2, 500, 0.5), (1, 2, 2, 7, None)], schema)
    rev = spark.createDataFrame([(1, 1, 2, j, 0.5) for j in range(100, 400)], schema)
    got = {r.item_id_n: (r.item_id_n1, r.status, r.source, r.score) for r in reconcile(fwd, rev).collect()}
    assert got == {1: (500, "conflict", "forward", 0.5), 2: (7, "one_way", "forward", None)}
