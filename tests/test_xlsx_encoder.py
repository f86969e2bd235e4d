"""S7 from workbooks, U1 as a batch predictor."""

import os
import zipfile
from xml.sax.saxutils import escape

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF0001
from yearlink.functions import vectors as V
from yearlink.sources import fixtures as fx
from yearlink.sources import io, xlsx

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACK = "http://schemas.openxmlformats.org/package/2006/relationships"


def write_book(path, sheets, strings=()):
    """``sheets``: name -> XML of the rows."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{DOC}"><sheets>{names}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACK}">{rels}</Relationships>')
        if strings:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{"".join(f"<si>{s}</si>" for s in strings)}</sst>')
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{rows}</sheetData></worksheet>')


def inline(values):
    return "<row>" + "".join(f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>' if v else "<c/>" for v in values) + "</row>"


def folder(spark, name):
    path = io.scratch_path(spark, name).removeprefix("file:")
    os.makedirs(path)
    return path


def test_labelled_schedule_from_workbooks(spark):
    items = [(r.description, r.code) for r in fx.items(spark, SF0001).select("description", "code").collect()]
    path = folder(spark, "books")
    for k in range(3):  # one workbook for each third
        write_book(f"{path}/{k}.xlsx", {"hs": "".join(map(inline, [("hs", "x", "brief_description"), *((c, "x", d) for d, c in items[k::3])]))})
    got = io.scan_xlsx(spark, path, ["brief_description", "hs", "missing"])
    assert got.columns == ["brief_description", "hs", "missing"]
    key = lambda r: (r[0] or "", r[1] or "")
    want = sorted(((d or None, c or None) for d, c in items), key=key)
    assert sorted(((r[0], r[1]) for r in got.collect()), key=key) == want
    assert got.where("missing is not null").count() == 0


def test_cells_of_every_kind(spark):
    path = folder(spark, "kinds")
    strings = ["<t>hs</t>", "<t>text</t>", "<r><t>rich </t></r><r><t>text</t></r><rPh><t>no</t></rPh>", "<t/>"]
    rows = (
        '<row r="2"><c r="B2" t="s"><v>0</v></c><c r="AA2" t="s"><v>1</v></c><c r="AB2" t="s"><v>0</v></c></row>'
        '<row r="3"><c r="B3"><v>101.0</v></c><c r="AA3" t="s"><v>2</v></c><c r="AB3"><v>7</v></c></row>'
        '<row r="4"><c r="B4"><v>0.25</v></c><c r="AA4" t="b"><v>1</v></c></row>'
        '<row r="5"/>'
        '<row r="6"><c r="B6" t="e"><v>#N/A</v></c><c r="AA6" t="str"><f>A1</f><v>1.0</v></c></row>'
        '<row r="7"><c r="B7" t="s"><v>3</v></c></row>'
    )
    write_book(f"{path}/a.xlsx", {"first": inline(["hs"]), "second & last".replace("&", "and"): rows}, strings)
    got = [tuple(r) for r in io.scan_xlsx(spark, f"{path}/a.xlsx", ["hs", "text"], "second and last").collect()]
    assert got == [("101", "rich text"), ("0.25", "TRUE"), (None, "1.0")]
    assert io.scan_xlsx(spark, path, ["hs"]).collect() == []
    with open(f"{path}/a.xlsx", "rb") as f, pytest.raises(ValueError, match="no sheet"):
        list(xlsx.rows(f.read(), "third"))


def test_batch_encoder_equals_the_jvm_form(spark):
    texts = [("a", "Red  wine, red WINE\tcask"), ("b", None), ("c", "  \n"), ("d", "é É x" * 500), ("e", "red")]
    df = spark.createDataFrame(texts, "id string, t string").repartition(3)
    a = {r.id: r.v for r in V.embed_texts(df, "t", "v").collect()}
    b = {r.id: r.v for r in V.token_vectors(df, "t", "v").collect()}
    assert a.keys() == b.keys() and len(a) == 5
    for k in a:
        np.testing.assert_allclose(a[k], b[k], rtol=1e-6)
    assert not any(a["b"]) and not any(a["c"])


def test_table_of_token_vectors_is_mean_pooled_and_masked(spark):
    rng = np.random.default_rng(0)
    tokens, table = ["red", "wine", "cask"], rng.normal(size=(3, 5)).astype(np.float32)
    path = f"{folder(spark, 'model')}/model.npz"
    np.savez(path, tokens=tokens, vectors=table)

    def load():
        model = np.load(path)
        return V.table_encoder(model["tokens"].tolist(), model["vectors"])

    V.register_encoder("table", load, batch_size=2)
    df = spark.createDataFrame([(1, "red wine unknown red"), (2, "unknown"), (3, "Cask"), (4, "red wine unknown red")], "id int, t string")
    got = {r.id: np.array(r.v) for r in V.embed_texts(df, "t", "v", "table").collect()}
    mean = table[[0, 1, 0]].astype(float).mean(axis=0)
    np.testing.assert_allclose(got[1], mean / np.linalg.norm(mean), rtol=1e-5)
    np.testing.assert_allclose(got[3], table[2] / np.linalg.norm(table[2]), rtol=1e-5)
    assert not got[2].any() and (got[4] == got[1]).all()
    plan = V.embed_texts(df, "t", "v", "table").select(F.size("v"))._jdf.queryExecution().toString()
    assert "ArrowEvalPython" in plan or "PythonUDF" in plan
