"""E-mails and web archives: headers, candidate bodies, the best of them."""

from __future__ import annotations

import re
from datetime import timedelta, timezone
from email import message_from_bytes
from email.header import decode_header, make_header
from email.message import Message
from email.utils import parsedate_to_datetime

from . import charset, html

SEOUL = timezone(timedelta(hours=9))
# Words of order documents, and of quoted mails; what marks off an earlier message; names of its header's
# fields; words that say that a header is only shown as an example.
WORDS = ["buy & sell report", "buy&sell", "fund code", "fund name", "subscription", "redemption", "설정", "해지", "입금", "출금", "금액", "amount"]
QUOTED = ["original message", "forwarded message", "from:", "sent:", "subject:", "mailto:"]
MARKERS = ["forwarded message", "original message", "원본 메시지", "전달된 메시지", "이전 메시지"]
FIELDS = ["from:", "sender:", "sent:", "to:", "subject:", "title:", "date:", "cc:", "보낸 사람:", "보낸사람:", "받는 사람:", "받는사람:", "참조:", "제목:", "날짜:"]
EXAMPLES = ["예시", "예를 들어", "example", "sample", "metadata", "메타데이터"]
#: A field's value that only a mail's header has: an address, a weekday and day, an offset, a day.
_SENT = re.compile(
    r"@|mailto:|(?:mon|tue|wed|thu|fri|sat|sun),?\s+\d{1,2}\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)|[+-]\d{4}|\d{4}[-./]\d{1,2}[-./]\d{1,2}|gmt[+-]\d", re.I
)
_ORDER_LINE = re.compile(r".*\d.* \| .*|.* \| .*\d.*|\d{1,2}-\d{1,2}-\d{4}|[A-Za-z]?\d[\dA-Za-z-]{2,}|-?\d[\d,]*(?:\.\d+)?")


def header(value: str | None) -> str:
    if not value:
        return ""
    try:
        return str(make_header(decode_header(value)))
    except (LookupError, UnicodeDecodeError, ValueError):
        return value


def seoul_date(value: str | None) -> str | None:
    """The calendar day in Seoul of a mail's Date field."""
    try:
        return parsedate_to_datetime(value).astimezone(SEOUL).strftime("%Y-%m-%d") if value else None
    except (TypeError, ValueError):
        return None


def body_parts(message: Message) -> list[tuple[str, str]]:
    """(subtype, text) of the text parts that aren't attachments."""
    out = []
    for part in message.walk():
        if part.get_content_maintype() == "text" and part.get_content_disposition() != "attachment" and part.get_content_subtype() in ("plain", "html"):
            raw = part.get_payload(decode=True) or b""
            out.append((part.get_content_subtype(), charset.decode(raw, part.get_content_charset())))
    return out


def lines_of(subtype: str, text: str) -> list[str]:
    return html.to_lines(html.blocks(text)) if subtype == "html" else [x.rstrip() for x in text.replace("\r\n", "\n").split("\n")]


def score(lines: list[str], subtype: str) -> int:
    """How much a body looks like an order document: 12 a word, up to 20 for table rows (2 each), 12 for dates (3 each) and
    10 for length (a point per 500 characters), 2 for HTML; 20 less for each sign of a quoted mail, 30 less without any word."""
    joined = "\n".join(lines)
    low = joined.lower()
    hits = sum(w in low for w in WORDS)
    dates = len(re.findall(r"\d{1,4}[-./]\d{1,2}[-./]\d{1,4}", joined))
    return (
        12 * hits + min(20, 2 * sum(" | " in x for x in lines)) + min(12, 3 * dates) + min(10, len(joined) // 500) + (2 if subtype == "html" else 0)
        - 20 * sum(w in low for w in QUOTED) - (0 if hits else 30)
    )


def earlier_message(lines: list[str]) -> int | None:
    """The line where an earlier message begins: a separator, an attribution, or a header of two fields with a mail's values.

    A header right below a line of text only counts between lines of orders; one shown as an example doesn't.
    """
    low = [" ".join(x.split()).lower() for x in lines]
    field = [x.startswith(tuple(FIELDS)) for x in low]

    def separates(x: str) -> bool:
        return any(m in x for m in MARKERS) or bool(re.fullmatch(r"on .+ wrote:", x))

    def example(i: int) -> bool:
        return any(e in "\n".join(low[max(0, i - 3) : i]) for e in EXAMPLES)

    def ordered(a: int, b: int) -> bool:
        return any(_ORDER_LINE.fullmatch(x.strip()) or "buy & sell report" in x for x in low[a:b] if x)

    for i, x in enumerate(low):
        if not x or not (separates(x) or field[i]) or example(i):
            continue
        if separates(x):
            return i
        above = low[i - 1] if i else ""
        end = i
        while end < len(low) and (field[end] or not low[end]):
            end += 1
        if above and not separates(above) and not (ordered(max(0, i - 6), i) and ordered(end, end + 18)):
            continue
        block = [y for y, f in zip(low[i : i + 5], field[i : i + 5]) if f]
        if len(block) >= 2 and _SENT.search("\n".join(block)):
            return i
    return None


def without_earlier(lines: list[str]) -> list[str]:
    """A body's lines before any earlier message, without blank ones at the end."""
    kept = lines[: earlier_message(lines)]
    while kept and not kept[-1].strip():
        kept.pop()
    return kept


# The header of a report of purchases and sales, and words that end it.
REPORT_HEADER = ["Date | Buy&Sell | External Fund Manager | Fund Code | Fund Name | Fund Price | Buy |  | Sell |  | Custodian Bank", " |  |  |  |  |  | Amount | Unit | Amount | Unit | "]
REPORT_ENDS = ["total", "합계", "총계"]
_REPORT_DATE = re.compile(r"\d{1,2}-\d{1,2}-\d{4}")
_REPORT_CODE = re.compile(r"[A-Za-z]?\d[\dA-Za-z-]{2,}")
_NUMBER = re.compile(r"-?\d[\d,]*(?:\.\d+)?")


def report_rows(lines: list[str]) -> list[str] | None:
    """A report of purchases and sales whose cells stand one below the other, as table rows; None if it is none.

    A row is date, kind, manager, code, name and price (a row without a date has neither date nor kind), then up to
    five cells; where mail programs dropped blank ones, two numbers are the amounts bought and sold.
    """
    lines = [" ".join(x.split()) for x in lines]
    title = next((i for i, x in enumerate(lines) if re.fullmatch(r"buy\s*&\s*sell report", x, re.I)), None)
    head = next((i for i, x in enumerate(lines) if title is not None and i >= title and x == "Date"), None)
    i = next((i for i, x in enumerate(lines) if head is not None and i >= head and _REPORT_DATE.fullmatch(x)), None)
    if i is None:
        return None

    def begins(k: int) -> bool:
        if _REPORT_DATE.fullmatch(lines[k]) or lines[k].lower() in REPORT_ENDS:
            return True
        return len(lines) >= k + 4 and bool(lines[k] and lines[k + 2] and _REPORT_CODE.fullmatch(lines[k + 1]) and _NUMBER.fullmatch(lines[k + 3]))

    out = [x for x in lines[title:head] if x] + REPORT_HEADER
    first = len(out)
    while i < len(lines):
        if not lines[i]:
            i += 1
            continue
        if lines[i].lower() in REPORT_ENDS:
            break
        row = [] if _REPORT_DATE.fullmatch(lines[i]) else ["", ""]
        while i < len(lines) and len(row) < 6 and lines[i].lower() not in REPORT_ENDS:
            row.append(lines[i])
            i += 1
        if len(row) < 6:
            break
        tail: list[str] = []
        while i < len(lines) and len(tail) < 5 and not begins(i):
            tail.append(lines[i])
            i += 1
        if len(tail) == 2:
            tail = [tail[0], "", tail[1]]
        out.append(" | ".join(row + tail + [""] * (5 - len(tail))))
    return out if len(out) > first else None


def read_eml(raw: bytes, name: str) -> str:
    """The raw text of a mail: its section mark, its header, an empty line, the best body."""
    m = message_from_bytes(raw)
    head = [f"[EML {name}]"] + [f"{k}: {header(m[k])}" for k in ("Subject", "From", "To", "Date") if m[k]]
    if day := seoul_date(m["Date"]):
        head.append(f"Date (Asia/Seoul): {day}")
    bodies = [(subtype, without_earlier(lines_of(subtype, text))) for subtype, text in body_parts(m)]
    bodies = [(subtype, (report_rows(lines) if subtype == "plain" else None) or lines) for subtype, lines in bodies]
    best = max(bodies, key=lambda b: score(b[1], b[0]), default=("plain", []))[1]
    return "\n".join([*head, "", *best]).rstrip()


def rebuild(text: str) -> bytes:
    """The MIME message that a mail's raw text (as `read_eml` gives it) was read from, as far as the text tells."""
    head, _, body = text.replace("\r\n", "\n").partition("\n\n")
    m = Message()
    for line in head.split("\n"):
        name, colon, value = line.partition(":")
        if colon and name.lower() in ("subject", "from", "to", "date") and name not in m:
            m[name] = " ".join(value.split())
    m.set_payload(body.encode("utf-8", "replace"), "utf-8")
    return m.as_bytes()


def read_mht(raw: bytes) -> str:
    """The HTML parts of a web archive, one after another, as one section each."""
    m = message_from_bytes(raw)
    parts = [html.to_lines(html.blocks(t)) for s, t in body_parts(m) if s == "html"]
    return "\n\n==== SECTION ====\n\n".join("\n".join([f"[MHT {i}]", *p]) for i, p in enumerate(parts, 1))
