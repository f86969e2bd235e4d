"""Rows of xlsx workbooks, for ``io.scan_xlsx``.

A workbook is a zip of XML parts.  The sheet is read as a stream, row by row,
and leaves as Arrow batches; only the table of shared strings is held.  Cells
are texts as stored: numbers without a trailing ``.0``, booleans as TRUE and
FALSE, dates as their serial number, formulas as their last value.  Error
cells, empty cells and columns that a sheet lacks are null.  Of columns with
the same name the first counts.  A row without any value is left out.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa

ROWS = 4096  # rows of a batch
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_INTEGRAL = re.compile(r"(-?\d+)\.0+")


def _texts(node) -> str:
    """Text of a string item, its runs joined; phonetic readings do not count."""
    runs = [node.find(_MAIN + "t"), *(r.find(_MAIN + "t") for r in node.findall(_MAIN + "r"))]
    return "".join(t.text or "" for t in runs if t is not None)


def _stream(book: zipfile.ZipFile, part: str, tag: str) -> Iterator:
    """Elements ``tag`` of a part, forgotten once they are used."""
    with book.open(part) as f:
        events = ElementTree.iterparse(f, ("start", "end"))
        holders = []
        for event, node in events:
            if event == "start":
                holders.append(node)
                continue
            holders.pop()
            if node.tag == _MAIN + tag:
                yield node
                if holders:
                    holders[-1].clear()


def _sheet_part(book: zipfile.ZipFile, sheet: str | None) -> str:
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(_MAIN + "sheet")
    found = [(s.get("name"), s.get(_REL)) for s in sheets]
    wanted = [rel for name, rel in found if sheet is None or name == sheet]
    if not wanted:
        raise ValueError(f"no sheet {sheet!r} among {[name for name, _ in found]}")
    for rel in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if rel.get("Id") == wanted[0]:
            return posixpath.normpath(posixpath.join("/xl", rel.get("Target"))).lstrip("/")
    raise ValueError(f"sheet {wanted[0]} has no part")


def _column(reference: str) -> int:
    n = 0
    for letter in reference.rstrip("0123456789"):
        n = 26 * n + ord(letter) - ord("A") + 1
    return n - 1


def _value(cell, shared: list[str]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        node = cell.find(_MAIN + "is")
        return _texts(node) or None if node is not None else None
    text = cell.findtext(_MAIN + "v")
    if not text or kind == "e":
        return None
    if kind == "s":
        return shared[int(text)] or None
    if kind == "b":
        return "TRUE" if text == "1" else "FALSE"
    whole = _INTEGRAL.fullmatch(text) if kind == "n" else None
    return whole[1] if whole else text


def rows(content: bytes, sheet: str | None = None) -> Iterator[dict[int, str]]:
    """Values by column number of each row of a sheet that has one."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        part = _sheet_part(book, sheet)
        strings = "xl/sharedStrings.xml"
        shared = [_texts(s) for s in _stream(book, strings, "si")] if strings in book.namelist() else []
        for row in _stream(book, part, "row"):
            found, at = {}, -1
            for cell in row.findall(_MAIN + "c"):
                at = _column(cell.get("r")) if cell.get("r") else at + 1
                value = _value(cell, shared)
                if value is not None:
                    found[at] = value
            if found:
                yield found


def rows_of_books(columns: list[str], sheet: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow function from (path, content) to the named columns."""

    def batch(held: list[list[str | None]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[i] for r in held], pa.string()) for i in range(len(columns))], names=columns)

    def run(batches):
        for books in batches:
            for content in books.column(1):
                lines = rows(content.as_py(), sheet)
                header: dict[str, int] = {}
                for at, name in next(lines, {}).items():
                    header.setdefault(name.strip(), at)
                places = [header.get(c) for c in columns]
                held = []
                for line in lines:
                    held.append([line.get(p) for p in places])
                    if len(held) == ROWS:
                        yield batch(held)
                        held = []
                if held:
                    yield batch(held)

    return run
