"""Chains brought up to date (S10 over C1/C2) against the full run."""

import random

import pytest
from pyspark.sql import functions as F

from yearlink.plans.chain import chain_by_code, chain_by_description
from yearlink.plans.chain_update import changed_pairs, update_by_code, update_by_description
from tests.test_chain import _edges


def _world(seed, years, per_pair=25):
    """Edges between adjacent editions; texts and codes repeat, some are NULL."""
    rnd = random.Random(seed)
    rows = []
    for y, y1 in zip(years, years[1:]):
        for k in range(per_pair):
            code = lambda: None if rnd.random() < 0.1 else "hot" if rnd.random() < 0.33 else f"c{rnd.randrange(6)}"
            text = lambda: None if rnd.random() < 0.1 else "Hot" if rnd.random() < 0.33 else f" T{rnd.randrange(6)}"
            rows.append((y * 1000 + k, (y, code(), text()), (y1, code(), text()), rnd.choice([None, 0.1, 0.5, 0.9])))
    return rows


def _grown(rows):
    more = [(2020 * 1000 + 500 + i, *r[1:]) for i, r in enumerate(_world(99, [2020, 2021], 9))]
    return rows + more


def _between(rows):
    """Edition 2020 comes in between 2019 and 2021."""
    new = _world(5, [2019, 2020, 2021])
    return [r for r in rows if (r[1][0], r[2][0]) != (2019, 2021)] + new


def _gone(rows):
    return [r for r in rows if r[1][0] != 2019]


CASES = {
    "grown": ([2018, 2019, 2020, 2021, 2022, 2023], _grown),
    "between": ([2018, 2019, 2021, 2022, 2023], _between),
    "gone": ([2018, 2019, 2020, 2021, 2022, 2023], _gone),
    "empty before": ([], lambda rows: _world(8, [2020, 2021, 2022, 2023])),
    "all gone": ([2021, 2022, 2023], lambda rows: []),
}


def _rows(df):
    cols = sorted(df.columns)
    return sorted((repr(tuple(r[c] for c in cols)) for r in df.collect()))


@pytest.mark.parametrize("case", CASES)
def test_update_is_the_full_run(spark, case):
    years, change = CASES[case]
    before = _world(3, years)
    a, b = _edges(spark, before), _edges(spark, change(before))
    changed = changed_pairs(a, b)
    assert _rows(update_by_description(b, chain_by_description(a, with_path=True), changed, with_path=True)) == _rows(
        chain_by_description(b, with_path=True)
    )
    assert _rows(update_by_code(b, chain_by_code(a, with_seed=True), changed)) == _rows(chain_by_code(b, with_seed=True))


def test_changed_pairs_sees_every_kind_of_change(spark):
    rows = _world(1, [2019, 2020, 2021, 2022])
    other = [(i, n, n1, 0.25) if n[0] == 2019 else (i, n, n1, c) for i, n, n1, c in rows if n[0] != 2020] + _world(2, [2022, 2023])
    got = {tuple(r) for r in changed_pairs(_edges(spark, rows), _edges(spark, other)).collect()}
    assert got == {(2019, 2020), (2020, 2021), (2022, 2023)}


def test_rows_beyond_the_change_are_not_resolved_again(spark):
    before = _world(3, [2018, 2019, 2020, 2021, 2022, 2023])
    a, b = _edges(spark, before), _edges(spark, _grown(before))
    mark = F.when(F.col("year_n") > 2020, "kept").otherwise(F.col("mapped_2023_code"))
    previous = chain_by_description(a).withColumn("mapped_2023_code", mark)
    out = update_by_description(b, previous, changed_pairs(a, b))
    assert {r.mapped_2023_code for r in out.filter("year_n > 2020").collect()} == {"kept"}
    # and the chains that enter there take the result that lies there
    assert {r.mapped_2023_code for r in out.filter("year_n <= 2020").collect()} == {"kept", None}
