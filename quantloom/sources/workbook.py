"""Sheets of .xlsx workbooks with the standard library: shared strings and inline cells.

Workbooks are small by format (about a million rows a sheet); they are read on
the driver and handed to Spark as text columns.
"""

from __future__ import annotations

import re
import zipfile
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

from quantloom.errors import IncompatibleSourceError

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_names(path: str | Path) -> list[str]:
    with zipfile.ZipFile(path) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    return [s.attrib["name"] for s in book.iterfind("m:sheets/m:sheet", _NS)]


def sheet_rows(path: str | Path, sheet: str) -> list[list[str | None]]:
    """All rows of a sheet as text; whole numbers without a fraction."""
    with zipfile.ZipFile(path) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        own = [s for s in book.iterfind("m:sheets/m:sheet", _NS) if s.attrib["name"] == sheet]
        if not own:
            raise IncompatibleSourceError(f"{path} has no sheet {sheet!r}")
        links = ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        target = next(r.attrib["Target"] for r in links if r.attrib["Id"] == own[0].attrib[_REL])
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", _NS):
                shared.append("".join(t.text or "" for t in item.iter("{%s}t" % _NS["m"])))
        body = ElementTree.fromstring(z.read("xl/" + target.lstrip("/").removeprefix("xl/")))
    rows = []
    for row in body.iterfind("m:sheetData/m:row", _NS):
        cells: dict[int, str | None] = {}
        for i, cell in enumerate(row.iterfind("m:c", _NS)):
            at = _column(cell.attrib["r"]) if "r" in cell.attrib else i
            kind = cell.attrib.get("t", "n")
            value = cell.find("m:v", _NS)
            if kind == "inlineStr":
                text = "".join(t.text or "" for t in cell.iter("{%s}t" % _NS["m"]))
            elif value is None or value.text is None:
                text = None
            elif kind == "s":
                text = shared[int(value.text)]
            elif kind == "b":
                text = "True" if value.text == "1" else "False"
            else:
                text = value.text.removesuffix(".0") if kind == "n" else value.text
            cells[at] = text
        rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    return rows


def read_sheet(spark: SparkSession, path: str | Path, sheet: str, ordinal: str = "_ord") -> DataFrame:
    rows = [r for r in sheet_rows(path, sheet) if any(c is not None for c in r)]
    if not rows:
        raise IncompatibleSourceError(f"sheet {sheet!r} of {path} is empty")
    header = [str(c) for c in rows[0] if c is not None]
    width = len(header)
    data = [[*(r + [None] * width)[:width], i] for i, r in enumerate(rows[1:])]
    return spark.createDataFrame(data, ", ".join(f"`{c.replace('`', '``')}` string" for c in header) + f", {ordinal} long")


def write_sheets(path: str | Path, sheets: dict[str, list[list]]) -> None:
    """A minimal workbook with inline strings."""
    from xml.sax.saxutils import escape

    def letter(i: int) -> str:
        out = ""
        i += 1
        while i:
            i, r = divmod(i - 1, 26)
            out = chr(65 + r) + out
        return out

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(sheets)
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/></Types>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{_NS["m"]}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i + 1}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(names))) + "</Relationships>")
        for i, n in enumerate(names):
            body = "".join(f'<row r="{y + 1}">' + "".join(f'<c r="{letter(x)}{y + 1}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>' for x, v in enumerate(row) if v is not None) + "</row>" for y, row in enumerate(sheets[n]))
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'<?xml version="1.0"?><worksheet xmlns="{_NS["m"]}"><sheetData>{body}</sheetData></worksheet>')
