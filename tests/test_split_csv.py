"""Split scan of CSV files with line breaks in quoted texts."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yearlink.sources import io
from yearlink.sources.split_csv import csv_records, scan_split_csv

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("more", T.StringType())])


@pytest.fixture
def small_splits(spark):
    """Splits of 256 bytes."""
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], "256")
    spark.conf.set(keys[1], "16")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _quoted(x):
    return "" if x is None else '"' + x.replace('"', '""') + '"' if any(c in x for c in '",\n') else x


def _write(folder, name, rows, newline="\n"):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", newline="", encoding="utf-8") as f:
        f.write(newline.join([",".join(SCHEMA.names), *[",".join([str(i), _quoted(t), _quoted(m)]) for i, t, m in rows]]) + newline)


def _rows(seed, n=150):
    rnd = random.Random(seed)
    parts = ["plain", "two\nlines", 'a "quoted" word', "comma, here", "\n\n", "é中😀", '"', '""', "x" * 30]
    return [(seed * 1000 + i, rnd.choice([None, "NA", " blank ", *["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 5)))] * 8]), "end") for i in range(n)]


def _values(df):
    return sorted(tuple(r) for r in df.collect())


def test_equal_to_the_whole_file_scan(spark, small_splits, tmp_path):
    a, b = _rows(1), _rows(2)
    a[70] = (a[70][0], 'several splits "long"\n' * 60, "end")
    a[71] = (a[71][0], "w" * 2000, None)
    _write(tmp_path, "a.csv", a)
    _write(tmp_path, "b.csv", b)
    got = _values(scan_split_csv(spark, str(tmp_path), SCHEMA, io.DIALECT))
    assert got == _values(io._csv(spark, SCHEMA).csv(str(tmp_path)))
    assert got == sorted((i, None if t in (None, "NA") else t, m) for i, t, m in a + b)
    # the files were really dealt to several tasks each
    parts = spark.read.text(str(tmp_path)).select(F.col("_metadata.file_path"), F.col("_metadata.file_block_start")).distinct()
    assert parts.count() > 20


def test_ends_and_empty_files(spark, small_splits, tmp_path):
    for name, newline in (("cr", "\r\n"), ("lf", "\n")):
        rows = [(i, "one,two", "last") for i in range(40)]
        _write(tmp_path / name, "f.csv", rows, newline)
        assert _values(scan_split_csv(spark, str(tmp_path / name), SCHEMA, io.DIALECT)) == rows
    _write(tmp_path / "head", "f.csv", [])
    assert csv_records(spark, str(tmp_path / "head")).count() == 0
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "f.csv").write_text("")
    assert csv_records(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "open").mkdir()
    (tmp_path / "open" / "f.csv").write_text("id,text,more\n\n1,a,b\n\n2,c,d")  # empty lines, no last line end
    assert _values(scan_split_csv(spark, str(tmp_path / "open"), SCHEMA, io.DIALECT)) == [(1, "a", "b"), (2, "c", "d")]


def test_items_and_pair_files(spark, small_splits, tmp_path):
    names = [n for n, _ in io.ITEM_CSV_COLUMNS]
    with open(tmp_path / "items.csv", "w", encoding="utf-8") as f:
        f.write(",".join(names) + "\n")
        for i in range(30):
            cells = {"year": "1999", "hs": f"01.{i}", "brief_description": f'"line {i}\nof ""two"""', "index": str(i)}
            f.write(",".join(cells.get(n, "NA") for n in names) + "\n")
    path = str(tmp_path / "items.csv")
    split = io.project_items(io.scan_items(spark, path, split=True))
    assert _values(split) == _values(io.project_items(io.scan_items(spark, path))) and split.count() == 30
    pairs = tmp_path / "pairs"
    _write(pairs, "mapped_1990_1991.csv", _rows(1, 20))
    _write(pairs, "mapped_1991_1993.csv", _rows(2, 20))
    whole = io.scan_pair_files(spark, str(pairs), SCHEMA)
    got = io.scan_pair_files(spark, str(pairs), SCHEMA, split=True)
    assert got.columns == whole.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, whole.collect()))
