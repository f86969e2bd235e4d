import pytest

SF = "/root/testdata/sf0.001"
FIELDS = "doc_id long, text string, lang string, source string, n_chars long, score double, n int, `key` string, bucket int, row string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents of the smallest table and odd rows: nulls, empty texts, a long
    text, repeated rows, copies; extra columns named like inner ones."""
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    base = rows[3][1]
    long = " ".join(f"w{i % 4999} x{i}" for i in range(30_000))
    rows += [
        (None, base, "en", "src1"),
        (None, None, None, None),
        (100_001, None, "en", None),
        (100_002, "", None, "src1"),
        (100_003, " \n\t ", "de", "src2"),
        (100_004, long, "en", "src2"),
        (100_005, base, None, "src3"),
        (100_005, base, None, "src3"),
        (100_006, base + "\n" + base, "en", ""),
        (100_007, "one two", "en", "src1"),
        (100_008, "One TWO", "en", "src1"),
        (100_009, "a\x0bb\x0cc\x1cd e   f", "en", "src1"),
        (100_010, "1234 !!! ???", "en", "src1"),
        (100_011, "a " * 3000, "en", "src0"),
    ]
    data = [(i, t, lang, s, None if t is None else len(t), 1.0, 7, "k", 3, "r") for i, t, lang, s in rows]
    return spark.createDataFrame(data, FIELDS).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


def words(text):
    return (text or "").encode().split()
