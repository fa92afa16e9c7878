"""Pages of a print file, given as their text and their tables: which of both to read, and what runs on to the next page.

An extractor of the print format isn't part of this package; whatever gives a page's plain text and the cells of its
tables (several readings of them, if it has them) can feed this. A document's pages are read in order in one Arrow
batch, for a page may take its header from the one before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words of lines outside tables that are kept, of headers, and the labels of a ledger printed in pieces.
CONTEXT = ["subscription", "redemption", "설정", "해지", "입금", "출금", "기준일", "결제일", "운용사", "수신", "date", "order"]
HEADER = ["펀드", "fund", "설정", "해지", "입금", "출금", "투입", "인출", "subscription", "redemption", "transaction", "구분", "date", "기준일", "결제일", "settlement", "당일", "예정", "청구", "예상", "t+", "nav", "순유입", "이체", "amount"]
PIECES_HEADER = ["펀드명", "운용사", "수탁코드", "구분", "내용", "금액", "d+1(예상금액)", "당일좌수"]
PIECES_LABELS = ["보험료입금", "입금소계", "출금소계", "특별계정운용보수", "입금 기타", "출금 기타"]
PIECES_COLUMNS = "펀드명 | 운용사 | 수탁코드 | 구분 | 내용 | 금액 | D+1(예상금액)"
_CODE = re.compile(r"[A-Z0-9]{3,}")
_PIECE_CODE = re.compile(r"\b([A-Z]\d{4,6}|\d{6})\b")
_NUMBER = re.compile(r"[+-]?\d[\d,]*(?:\.\d+)?[억만천]?")
_DATE = re.compile(r"\d{1,2}-[A-Za-z]{3}-\d{2}|\d{4}[-/.]\d{1,2}[-/.]\d{1,2}")
_SECTION = re.compile(r"\d+\.\s*(?:subscription|redemption)", re.I)
_TOTAL = re.compile(r"total|총 ?계|설정 합계|해지 합계|.*subtotal.*|.*(?:소계|합계)|.*\d+\s*개\s*펀드.*|.*계[\[\](){}<>]*", re.I)


@dataclass
class Page:
    """A page's plain text and the readings of its tables: reading, table, row, cell."""

    text: str = ""
    readings: list[list[list[list[str | None]]]] = field(default_factory=list)


def number(cell: str) -> bool:
    return bool(_NUMBER.fullmatch(re.sub(r"(?i)krw|[₩￦원\s]", "", cell)))


def nonzero(cell: str) -> bool:
    return number(cell) and bool(re.search("[1-9]", cell))


def clean(table: list[list[str | None]]) -> list[list[str]]:
    """A table's filled rows; line breaks within a cell become ' / '."""
    rows = [[re.sub(r"\s+", " ", re.sub(r"\s*\n\s*", " / ", c or "")).strip() for c in row] for row in table if row]
    return [r for r in rows if any(r)]


def total(row: list[str]) -> bool:
    return any(_TOTAL.fullmatch(c) for c in [x for x in row if x][:3])


def data(row: list[str]) -> bool:
    """Three filled cells, an amount behind the first, a code or text before the first amount that is no code."""
    filled = [c for c in row if c]
    if len(filled) < 3 or total(row) or (len(filled) <= 4 and any(":" in c for c in filled)) or not any(map(nonzero, row[1:])):
        return False
    plain = [i for i, c in enumerate(row) if number(c) and not _CODE.fullmatch(c)] or [i for i, c in enumerate(row) if number(c)]
    lead = (row[: plain[0]] or row[:4])[:8]
    return any(_CODE.fullmatch(c) or c and not number(c) for c in lead)


def header(row: list[str]) -> bool:
    filled = [c for c in row if c]
    words = sum(w in " ".join(filled).lower() for w in HEADER)
    return len(filled) >= 2 and (words > 0 or sum(not number(c) and not _CODE.fullmatch(c) for c in filled) >= 2)


def fragment(cell: str) -> bool:
    """Letters that a reading tore from their word."""
    return bool(re.fullmatch(r"[A-Za-z가-힣]{1,3}", cell)) and not _CODE.fullmatch(cell)


def reading_score(tables: list[list[list[str | None]]]) -> tuple[int, int, int, int]:
    """(data rows, fewer fragments, header rows, rows of three cells): the greatest reading is the best."""
    rows = [r for t in tables for r in clean(t)]
    return sum(map(data, rows)), -sum(fragment(c) for r in rows for c in r), sum(map(header, rows)), sum(sum(map(bool, r)) >= 3 for r in rows)


def data_line(line: str) -> bool:
    tokens = line.replace(" | ", " ").split()
    return len(tokens) >= 4 and any(_CODE.fullmatch(t) and not number(t) or _CODE.fullmatch(t) for t in tokens) and any(map(nonzero, tokens)) and not _TOTAL.fullmatch(tokens[0])


def header_line(line: str) -> bool:
    low = line.lower()
    return sum(w in low for w in HEADER) >= 3 and not data_line(line)


def text_score(text: str) -> tuple[int, int, int, int]:
    """(data lines less fragmented ones, data lines, header lines, lines)."""
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    found = sum(map(data_line, lines))
    torn = sum(sum(map(fragment, x.replace(" | ", " ").split())) >= 4 for x in lines)
    return found - torn, found, sum(map(header_line, lines)), len(lines)


def prefer_plain(plain: str, table: str) -> bool:
    """Is the plain text the better reading? Not where only the tables hold orders and keep amounts beside units."""
    if not plain:
        return False
    here, there = text_score(plain), text_score(table)
    kept = " | " in table and any(w in table for w in ("설정(해지)금액", "판매회사분결제액", "펀드납입(인출)금액", "결제액")) and "좌수" in table
    if here[1] == 0 and there[1] > 0 and (kept or here[0] <= 0):
        return False
    if there[1] == 0 and here[1] > 0:
        return True
    return here > there


def table_lines(tables: list[list[list[str | None]]], before: list[str] | None) -> tuple[list[str], list[str] | None]:
    """(lines, header to hand on) of a page's tables: preambles as text, totals left out, the header repeated behind a
    section's mark; a table of data alone takes the header of the page before."""
    out: list[str] = []
    latest = before
    for table in map(clean, tables):
        first = next((i for i, r in enumerate(table) if data(r) or total(r)), None)
        top, start = [], 0
        if first:
            start = first - 1
            while start and header(table[start - 1]) and not (sum(map(bool, table[start - 1])) <= 4 and any(":" in c for c in table[start - 1])):
                start -= 1
            top = list(dict.fromkeys(" | ".join(r) for r in table[start:first]))
        body = table[first:] if first else table
        if not top and before and sum(map(data, body[:5])) >= min(3, len(body)) > 0:
            top = before
        out += [" ".join(c for c in r if c) for r in table[:start]] + top
        latest = top or latest
        for row in body:
            filled = [c for c in row if c]
            if total(row):
                continue
            if len(filled) == 1 and _SECTION.fullmatch(filled[0]):
                out += [filled[0], *top]
            elif " | ".join(row) not in top:
                out.append(" | ".join(row))
    return [x for x in out if x.strip()], latest


def context_lines(text: str, table: list[str]) -> list[str]:
    """Lines outside the tables that help to tell direction and day, each once."""
    held = " ".join(table).lower()
    lines = (re.sub(r"\s+", " ", x).strip() for x in text.split("\n"))
    return list(dict.fromkeys(x for x in lines if x and x.lower() not in held and any(w in x.lower() for w in CONTEXT)))


def carried(lines: list[str]) -> list[str] | None:
    """The last section's mark of a page, with the header below it: what the next page's rows stand under."""
    out = None
    for i, x in enumerate(lines):
        if _SECTION.fullmatch(x):
            out = [x] + ([lines[i + 1]] if i + 1 < len(lines) and header_line(lines[i + 1]) else [])
    return out


def from_pieces(text: str, target: str = "") -> str | None:
    """A ledger whose cells were printed in pieces, one fund a run of lines from its first inflow: its subtotals as table
    rows; None if the text is none. `target` is a part of a manager's name, by which it is told from the fund's."""
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    head = next((i for i, x in enumerate(lines) if all(w in re.sub(r"\s+", "", x).lower() for w in PIECES_HEADER)), None)
    if head is None:
        return None
    runs: list[list[str]] = []
    for x in lines[head + 1 :]:
        if x.startswith(PIECES_LABELS[0]):
            runs.append([x])
        elif runs:
            runs[-1].append(x)
    rows: list[str] = []
    for run in runs:
        code, names, managers, amounts = "", [], [], {}
        for x in run:
            lead = x
            for label in PIECES_LABELS:
                if label in x:
                    lead = x.split(label, 1)[0].strip()
                    break
            if m := _PIECE_CODE.search(lead):
                lead = lead.replace(m[1], " ").strip()
            if not code and (m := _PIECE_CODE.search(x)):
                code = m[1]
            tokens = lead.split()
            at = next((i for i, t in enumerate(tokens) if target and target in t), None)
            if at is None:
                at = next((i for i, t in enumerate(tokens) if "자산운용" in t and (managers or not target)), len(tokens))
            if tokens[:at]:
                names.append("".join(tokens[:at]))
            if tokens[at:]:
                managers.append(" ".join(tokens[at:]))
            for label in ("입금소계", "출금소계"):
                if label in x:
                    amounts[label] = (re.findall(r"-?\d[\d,]*|-", x.split(label, 1)[1]) + ["-", "-"])[:2]
        name, manager = "".join(names), " ".join(dict.fromkeys(managers))
        if not code or not name:
            continue
        now, later = amounts.get("입금소계", ("-", "-"))
        if (now, later) != ("-", "-"):
            rows.append(f"{name} | {manager} | {code} | 입금 | 입금소계 | {now} | {later}")
        if (out := amounts.get("출금소계", ("-", "-"))[0]) != "-":
            rows.append(f"{name} | {manager} | {code} | 출금 | 출금소계 | {out} | -")
    return "\n".join([*lines[:head], PIECES_COLUMNS, *rows]) if rows else None


def document_text(pages: list[Page], target: str = "") -> str:
    """The raw text of a document: one section a page."""
    out: list[str] = []
    table_header: list[str] | None = None
    marks: list[str] | None = None
    for n, page in enumerate(pages, 1):
        plain = (page.text or "").strip()
        if pieces := from_pieces(plain, target):
            out.append(f"[PAGE {n}]\n{pieces}")
            continue
        lines = [x.strip() for x in plain.split("\n") if x.strip()]
        if lines and marks and data_line(lines[0]) and not _SECTION.fullmatch(lines[0]):
            lines = marks + lines
        plain = "\n".join(lines)
        marks = carried(lines) or marks
        best = max(page.readings, key=reading_score, default=[])
        rows, table_header = table_lines(best, table_header)
        table = "\n".join(context_lines(plain, rows) + rows) if rows else ""
        chosen = plain if prefer_plain(plain, table) else table or plain
        if chosen:
            out.append(f"[PAGE {n}]\n{chosen}")
    return "\n\n==== SECTION ====\n\n".join(out)


PAGES = "array<struct<page_no: int, text: string, readings: array<array<array<array<string>>>>>>"


def read_pages(pages: DataFrame, target: str = "") -> DataFrame:
    """(doc_id, raw_text) of pages (doc_id, page_no, text, readings); a document without text gives null.

    A document's pages are brought together (its text is one row anyway) and read in order.
    """
    packed = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "text", "readings"))).cast(PAGES).alias("pages"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [document_text([Page(p["text"] or "", [[[list(r or []) for r in t or []] for t in x or []] for x in p["readings"] or []]) for p in doc or []], target) or None for doc in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "raw_text"])

    return packed.select(F.col("doc_id").cast("long"), "pages").mapInArrow(run, "doc_id long, raw_text string")
