"""Registered queries against their DuckDB oracles (the driver's check), at sf0.001."""

import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF0001

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

FAST = [
    "match_year_pair_nolcs", "reconcile", "topk_cosine_expr", "indel_ratio",
    "chain_by_code", "chain_by_description", "hierarchy_match", "merge_back", "era_summary", "source_crosstab",
    "classification_report", "clean_code", "search", "flat_index", "sink_scan_pairs", "slug_uniq_key",
    "unmatched_updates", "embed_items",
]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return repr(v)


def _hash(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return c


def test_contract_keys():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 70


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:3] == ["row_id", "year_n", "year_n1"]


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF0001)
    srows = [tuple(r) for r in df.collect()]
    tbl = con.sql(E.oracle_sql()[name]).to_arrow_table()
    orows = [tuple(r.values()) for r in tbl.to_pylist()]
    assert sorted(df.columns) == sorted(tbl.column_names)
    assert len(srows) == len(orows)
    assert _hash(srows, df.columns) == _hash(orows, tbl.column_names)
