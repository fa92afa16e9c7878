"""Workbooks: XLSX/XLSM parts and XML spreadsheets, with zipfile and ElementTree."""

from __future__ import annotations

import io
import re
import zipfile
from datetime import datetime, timedelta
from decimal import Decimal, InvalidOperation
from xml.etree import ElementTree

SECTION = "\n\n==== SECTION ====\n\n"
# Number formats of the standard that show dates.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_NAME = re.compile(r"\{[^}]*\}")
_TAIL = Decimal("0.000001")


def number_text(value: str) -> str:
    """A stored number as it is read: tails of binary fractions next to an integer go."""
    try:
        d = Decimal(value)
    except InvalidOperation:
        return value
    whole = d.to_integral_value()
    if abs(d - whole) < _TAIL:
        d = whole
    text = format(d, "f")
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return "0" if text == "-0" else text


def serial_date(value: str, from_1904: bool) -> str:
    day = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30)
    at = day + timedelta(days=float(value))
    return at.strftime("%Y-%m-%d") if at.time() == datetime.min.time() else at.strftime("%Y-%m-%d %H:%M:%S")


def _tag(x: ElementTree.Element) -> str:
    return _NAME.sub("", x.tag)


def _all(x: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [y for y in x.iter() if _tag(y) == name]


def _clean(text: str) -> str:
    return re.sub(r"[\r\n\t]+", " ", text).strip()


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def render(sheets: list[tuple[str, list[list[str]]]]) -> str:
    """Sheets as sections: their mark, then the non-empty rows with trailing blanks cut."""
    out = []
    for name, rows in sheets:
        lines = [f"[SHEET {name}]"]
        for row in rows:
            while row and not row[-1]:
                row = row[:-1]
            if row:
                lines.append(" | ".join(row))
        out.append("\n".join(lines))
    return SECTION.join(out)


def read_xlsx(raw: bytes) -> list[tuple[str, list[list[str]]]]:
    """(sheet name, rows of cell texts) of every sheet, in the workbook's order; stored results of formulas are read."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    have = set(z.namelist())
    xml = lambda name: ElementTree.fromstring(z.read(name))
    shared = ["".join(t.text or "" for t in _all(si, "t")) for si in _all(xml("xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in have else []
    dated: list[bool] = []
    if "xl/styles.xml" in have:
        styles = xml("xl/styles.xml")
        own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in _all(styles, "numFmt")}
        for xfs in _all(styles, "cellXfs"):
            for xf in xfs:
                k = int(xf.get("numFmtId", "0"))
                code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(k, ""))
                dated.append(k in DATE_FORMATS or bool(re.search(r"[ymd]", code, re.I)) and "0" not in code)
    book = xml("xl/workbook.xml")
    from_1904 = any(p.get("date1904") in ("1", "true") for p in _all(book, "workbookPr"))
    links = {r.get("Id"): r.get("Target") for r in _all(xml("xl/_rels/workbook.xml.rels"), "Relationship")}
    out = []
    for sheet in _all(book, "sheet"):
        target = links[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))].lstrip("/")
        rows = []
        for row in _all(xml(target if target.startswith("xl/") else f"xl/{target}"), "row"):
            cells: list[str] = []
            for k, c in enumerate(x for x in row if _tag(x) == "c"):
                at = _column(c.get("r")) if c.get("r") else k
                cells += [""] * (at + 1 - len(cells))
                kind, value = c.get("t", "n"), next((v.text or "" for v in c if _tag(v) == "v"), "")
                if kind == "s":
                    cells[at] = _clean(shared[int(value)])
                elif kind == "inlineStr":
                    cells[at] = _clean("".join(t.text or "" for t in _all(c, "t")))
                elif kind == "b":
                    cells[at] = "TRUE" if value == "1" else "FALSE"
                elif kind in ("str", "e"):
                    cells[at] = _clean(value)
                elif value:
                    style = int(c.get("s", "0"))
                    cells[at] = serial_date(value, from_1904) if style < len(dated) and dated[style] else number_text(value)
            rows.append(cells)
        out.append((sheet.get("name", ""), rows))
    return out


def is_xml_spreadsheet(raw: bytes) -> bool:
    return b"urn:schemas-microsoft-com:office:spreadsheet" in raw[:2000]


def read_xml_spreadsheet(raw: bytes) -> list[tuple[str, list[list[str]]]]:
    """The sheets of an XML spreadsheet of 2003."""
    out = []
    for sheet in _all(ElementTree.fromstring(raw), "Worksheet"):
        name = next((v for k, v in sheet.attrib.items() if k.endswith("}Name")), "")
        rows = []
        for row in _all(sheet, "Row"):
            cells: list[str] = []
            for c in (x for x in row if _tag(x) == "Cell"):
                index = next((int(v) for k, v in c.attrib.items() if k.endswith("}Index")), len(cells) + 1)
                cells += [""] * (index - len(cells))
                data = next((x for x in c if _tag(x) == "Data"), None)
                value = "".join(data.itertext()) if data is not None else ""
                kind = next((v for k, v in data.attrib.items() if k.endswith("}Type")), "") if data is not None else ""
                cells[index - 1] = number_text(value) if kind == "Number" else value[:10] if kind == "DateTime" else _clean(value)
            rows.append(cells)
        out.append((name, rows))
    return out
