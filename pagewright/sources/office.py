"""DOCX and XLSX packages read with the standard library alone: to block rows and cell rows."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from typing import Any
from xml.etree import ElementTree as ET

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _paragraph(p: ET.Element) -> str:
    out = []
    for e in p.iter():
        if e.tag == W + "t":
            out.append(e.text or "")
        elif e.tag in (W + "tab",) and len(e.attrib) == 0:
            out.append("\t")
        elif e.tag in (W + "br", W + "cr"):
            out.append("\n")
    return "".join(out)


def _cells(table: ET.Element) -> list[list[str]]:
    """A table's rows; a cell that spans columns or rows is repeated in each."""
    rows: list[list[str]] = []
    for tr in table.findall(W + "tr"):
        row: list[str] = []
        for tc in tr.findall(W + "tc"):
            props = tc.find(W + "tcPr")
            span = props.find(W + "gridSpan") if props is not None else None
            merge = props.find(W + "vMerge") if props is not None else None
            text = "\n".join(_paragraph(p) for p in tc.findall(W + "p"))
            if merge is not None and merge.get(W + "val", "continue") == "continue" and rows and len(row) < len(rows[-1]):
                text = rows[-1][len(row)]
            row += [text] * int(span.get(W + "val", "1") if span is not None else 1)
        rows.append(row)
    return rows


def docx_blocks(raw: bytes) -> Iterator[tuple[str, str | None, str | None, list[list[str]] | None]]:
    """(kind, style, text, rows) of paragraphs and tables in their order."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names, default = {}, "Normal"
        if "word/styles.xml" in z.namelist():
            for s in ET.fromstring(z.read("word/styles.xml")).findall(W + "style"):
                n = s.find(W + "name")
                names[s.get(W + "styleId")] = n.get(W + "val") if n is not None else s.get(W + "styleId")
                if s.get(W + "type") == "paragraph" and s.get(W + "default") == "1":
                    default = names[s.get(W + "styleId")]
        body = ET.fromstring(z.read("word/document.xml")).find(W + "body")
        for e in body if body is not None else ():
            if e.tag == W + "p":
                style = e.find(f"{W}pPr/{W}pStyle")
                yield "paragraph", names.get(style.get(W + "val"), default) if style is not None else default, _paragraph(e), None
            elif e.tag == W + "tbl":
                yield "table", None, None, _cells(e)


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", reference).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """The numbers of the cell styles that show dates or times."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")) for f in root.iter(S + "numFmt")}
    formats = root.find(S + "cellXfs")
    used = [int(x.get("numFmtId", "0")) for x in formats] if formats is not None else []
    dates = lambda k: 14 <= k <= 22 or 45 <= k <= 47 or bool(re.search("[ymdhs]", own.get(k, ""), re.IGNORECASE))
    return {i for i, k in enumerate(used) if dates(k)}


def _number(text: str) -> int | float:
    value = float(text)
    return int(value) if value.is_integer() and abs(value) < 2**53 else value


def xlsx_sheets(raw: bytes) -> Iterator[tuple[str, list[list]]]:
    """(name, rows of cells) of each sheet in the workbook's order; rows are as wide as the widest. Cells are text, numbers, truth values, dates
    with their time, or None."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(S + "t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(S + "si")]
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book, dates = ET.fromstring(z.read("xl/workbook.xml")), _date_styles(z)
        about = book.find(S + "workbookPr")
        zero = datetime(1904, 1, 1) if about is not None and about.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        for sheet in book.iter(S + "sheet"):
            target = targets[sheet.get(R + "id")]
            path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
            rows: list[list] = []
            for n, tr in enumerate(ET.fromstring(z.read(path)).iter(S + "row")):
                at = int(tr.get("r", n + 1)) - 1
                while len(rows) < at:
                    rows.append([])
                row: list = []
                for k, c in enumerate(tr.findall(S + "c")):
                    j = _column(c.get("r")) if c.get("r") else k
                    row += [None] * (j - len(row))
                    v, kind = c.find(S + "v"), c.get("t")
                    text: Any = v.text if v is not None else None
                    if kind == "s" and text is not None:
                        text = shared[int(text)]
                    elif kind == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(S + "t"))
                    elif kind == "b" and text is not None:
                        text = text == "1"
                    elif kind == "d" and text is not None:
                        text = datetime.fromisoformat(text)
                    elif kind in (None, "n") and text is not None:
                        text = _number(text)
                        if int(c.get("s", "0")) in dates:
                            text = zero + timedelta(seconds=round(text * 86400))
                    row.append(text)
                rows.append(row)
            width = max(map(len, rows), default=0)
            yield sheet.get("name"), [r + [None] * (width - len(r)) for r in rows]
