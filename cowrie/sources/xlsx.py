"""Sheets of .xlsx workbooks, as reviewers fill them: read and written with the standard library. A workbook is a zip
of XML parts; a sheet's cells name their column and row, texts are shared, inline or formula results. Sheets that people
read are small, so both sides work on the driver."""

from __future__ import annotations

import posixpath
import re
import zipfile
from collections.abc import Iterable
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession

from .io import SchemaError

# Names of the office format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_TYPES = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?>
<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>"""
_ROOT = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?>
<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>"""
_BOOK = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?>
<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{name}" sheetId="1" r:id="rId1"/></sheets></workbook>"""
_PARTS = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?>
<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>"""
_UNWRITABLE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def column_name(k: int) -> str:
    """A, B, ..., Z, AA, ... for 0, 1, ..."""
    out = ""
    k += 1
    while k:
        k, rest = divmod(k - 1, 26)
        out = chr(ord("A") + rest) + out
    return out


def _column_number(name: str) -> int:
    out = 0
    for c in name:
        out = out * 26 + ord(c) - ord("A") + 1
    return out - 1


def _text_of(node: ElementTree.Element) -> str:
    """All text runs of a shared or inline string, without phonetic ones."""
    parts = [t.text or "" for t in node.findall(f"{_MAIN}t")]
    return "".join(parts + [t.text or "" for r in node.findall(f"{_MAIN}r") for t in r.findall(f"{_MAIN}t")])


def _value(cell: ElementTree.Element, shared: list[str]) -> str:
    kind, raw = cell.get("t"), cell.find(f"{_MAIN}v")
    if kind == "inlineStr":
        return _text_of(cell.find(f"{_MAIN}is"))
    if raw is None or raw.text is None:
        return ""
    if kind == "s":
        return shared[int(raw.text)]
    if kind == "b":
        return "TRUE" if raw.text == "1" else "FALSE"
    if kind in ("str", "e"):
        return raw.text
    number = float(raw.text)
    return str(int(number)) if number.is_integer() else raw.text


def rows_of(path: str, sheet: str | None = None) -> list[list[str]]:
    """All rows of a sheet as texts, gaps as empty cells; by default the first sheet."""
    with zipfile.ZipFile(path) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        sheets = {s.get("name"): s.get(_LINK) for s in book.iter(f"{_MAIN}sheet")}
        if sheet is not None and sheet not in sheets:
            raise SchemaError(f"{path} has no sheet {sheet!r}; it has {list(sheets)}")
        wanted = sheets[sheet] if sheet is not None else next(iter(sheets.values()))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = links[wanted]
        part = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
        shared = [_text_of(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_MAIN}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        out: list[list[str]] = []
        for row in ElementTree.fromstring(z.read(part)).iter(f"{_MAIN}row"):
            while row.get("r") and len(out) < int(row.get("r")) - 1:
                out.append([])
            cells: list[str] = []
            for cell in row.findall(f"{_MAIN}c"):
                place = re.match("[A-Z]+", cell.get("r") or "")
                at = _column_number(place[0]) if place else len(cells)
                cells += [""] * (at - len(cells)) + [_value(cell, shared)]
            out.append(cells)
        return out


def read_workbook(spark: SparkSession, path: str, columns: list[str], key: str, sheet: str | None = None) -> DataFrame:
    """A sheet with a header: the columns as texts, rows whose key is filled, gaps as empty text. A header that lacks a
    column is an error."""
    rows = rows_of(path, sheet)
    header = [c.strip() for c in rows[0]] if rows else []
    if lacking := [c for c in columns if c not in header]:
        raise SchemaError(f"{path} lacks {lacking}")
    at = [header.index(c) for c in columns]
    data = [tuple(r[k] if k < len(r) else "" for k in at) for r in rows[1:]]
    return spark.createDataFrame([d for d in data if d[columns.index(key)].strip()], ", ".join(f"`{c}` string" for c in columns))


def _sheet(rows: Iterable[list[str]]) -> str:
    out = ['<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>']
    for i, row in enumerate(rows, 1):
        cells = "".join(f'<c r="{column_name(k)}{i}" t="inlineStr"><is><t xml:space="preserve">{escape(_UNWRITABLE.sub("", v))}</t></is></c>' for k, v in enumerate(row) if v)
        out.append(f'<row r="{i}">{cells}</row>')
    return "".join(out) + "</sheetData></worksheet>"


def write_workbook(df: DataFrame, path: str, columns: list[str], name: str = "Sheet1") -> int:
    """The columns in order as the one sheet of a workbook, with a header; nulls as empty cells. Gives the rows."""
    rows = [["" if v is None else str(v) for v in r] for r in df.select(*columns).collect()]  # a sheet that people fill
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for part, body in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _ROOT), ("xl/workbook.xml", _BOOK.format(name=escape(name, {'"': "&quot;"}))), ("xl/_rels/workbook.xml.rels", _PARTS), ("xl/worksheets/sheet1.xml", _sheet([columns, *rows]))):
            z.writestr(part, body)
    return len(rows)
