"""The date of a document, by the places where documents put it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dates, ledger
from .dates import ymd
from .text import let, squeeze

# The header lines of a report of purchases and sales, in lower case.
REPORT_HEADERS = ["date | buy&sell | external fund manager | fund code | fund name", "date | buy&sell | fund code | fund name"]
_YMD = r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})"
_LABELLED = r"(?i)(?:기준일(?:자)?|결제일|document\s*date|settlement\s*date)\s*[:：]?\s*(\d{4})\s*[./-]?\s*(\d{1,2})\s*[./-]?\s*(\d{1,2})"
_DATE_LINE = r"(?im)^\s*date\s*[:：]?\s*(\d{4})\s*[./-]?\s*(\d{1,2})\s*[./-]?\s*(\d{1,2})\s*$"
_KOREAN = r"(\d{4})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일"
_SEOUL = r"(?i)Date\s*\(Asia/Seoul\)\s*:\s*(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})"
_SHORT = r"(?<![\p{L}\p{N}_])(\d{1,2}-[A-Za-z]{3}-\d{2})(?![\p{L}\p{N}_])"


def found(c: Column, pattern: str) -> Column:
    """The first match of a pattern of year, month and day, as YYYY-MM-DD."""
    return F.when(c.rlike(pattern), ymd(F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2), F.regexp_extract(c, pattern, 3)))


def title_date(lines: Column) -> Column:
    """A date that stands alone in one of the first six lines, right below a title (not a label of a date) and above
    words of an order table; lines: a document's filled lines, single-spaced."""
    top = F.slice(lines, 1, 12)

    def one(line: Column, i: Column) -> Column:
        own = F.filter(F.transform(F.split(line, r"\|"), squeeze), lambda x: x != "")
        before = F.get(lines, i - 1)
        after = F.lower(F.array_join(F.slice(F.slice(lines, 1, 12), i + 2, F.lit(5)), " "))
        ok = (F.size(own) == 1) & F.get(own, F.lit(0)).rlike(rf"^{_YMD}\z") & (i > 0) & ~before.rlike(r"(?i)기준일|결제일|trade\s*date|settlement\s*date") & after.rlike(r"t일|t\+1|순유입|nav|운용지시|펀드코드")
        return F.when(ok, found(F.get(own, F.lit(0)), _YMD))

    hits = F.filter(F.transform(F.slice(top, 1, 6), one), lambda x: x.isNotNull())
    return F.when(F.size(top) >= 3, F.get(hits, F.lit(0)))


def header_lines(lines: Column) -> Column:
    """The first sixteen filled lines, up to where sections of orders begin."""
    ends = F.transform(F.slice(lines, 1, 16), lambda x: F.lower(x).rlike(r"(?:^|(?<![\p{L}\p{N}_]))\d+\.\s*(?:subscription|redemption)(?![\p{L}\p{N}_])") | F.lower(x).contains(ledger.HEADER))
    at = F.array_position(ends, True).cast("int")
    return F.slice(lines, F.lit(1), F.when(at > 0, at - 1).otherwise(16))


def generic_date(text: Column, lines: Column) -> Column:
    """A date written out in Korean, a labelled one, a date line, a short English one, or the first of any kind."""
    head = header_lines(lines)
    short = F.transform(F.filter(head, lambda x: ~F.lower(x).rlike(r"closing\s*date|prior\s*date|nav\s*date")), lambda x: dates.short_english(F.regexp_extract(x, _SHORT, 1)))
    joined = F.array_join(head, "\n")
    return F.coalesce(found(text, _KOREAN), found(joined, _LABELLED), found(joined, _DATE_LINE), F.when(joined.rlike(_SHORT), F.get(F.filter(short, lambda x: x.isNotNull()), F.lit(0))), found(text, _YMD))


def ledger_row_dates(lines: Column) -> Column:
    """The different dates of a section ledger's rows; null where the text is none."""
    return F.array_distinct(F.filter(F.transform(ledger.rows(lines), lambda r: r["base_date"]), lambda x: x.isNotNull()))


def report_row_dates(lines: Column) -> Column:
    """The different dates at the head of a report's rows; null where the text has no such header."""
    low = F.transform(lines, lambda x: F.lower(x))
    at = F.array_position(F.transform(low, lambda x: x.contains(REPORT_HEADERS[0]) | x.contains(REPORT_HEADERS[1])), True).cast("int")
    below = F.filter(F.slice(lines, at + 1, F.size(lines)), lambda x: ~x.startswith("[PAGE ") & ~F.lower(x).startswith("total"))
    first = F.transform(below, lambda x: F.get(F.filter(F.transform(F.split(x, r"\|"), squeeze), lambda c: c != ""), F.lit(0)))
    return F.when(at > 0, F.array_distinct(F.filter(F.transform(first, dates.normalize), lambda x: x.isNotNull())))


def document_date(text: Column) -> Column:
    """(date, source) of a document: below its title, in its ledger's or report's rows, labelled or first of all, its mail's.

    Rows that disagree, or that have no date, end the search: then there is no date.
    """
    cut = lambda t: F.filter(F.transform(F.split(t, r"\r\n|\n|\r"), squeeze), lambda x: x != "")
    # the first sixteen filled lines suffice, but for ledgers and reports
    top = F.regexp_extract(text, r"\A(?:\s*+\S[^\r\n]*+){0,16}", 0)

    def cascade(lines: Column) -> Column:
        one = lambda found: F.when(F.size(found) == 1, F.get(found, F.lit(0)))
        low = F.lower(text)
        has_ledger = low.contains("subscription") & low.contains("redemption") & low.contains(ledger.HEADER)
        has_report = low.contains(REPORT_HEADERS[0]) | low.contains(REPORT_HEADERS[1])
        as_pair = lambda date, source: F.struct(date.alias("date"), F.when(date.isNotNull(), source).alias("source"))
        rest = let(generic_date(text, lines), lambda g: F.when(g.isNotNull(), as_pair(g, "text")).otherwise(as_pair(found(text, _SEOUL), "mail")))
        alone = top.rlike(rf"(?m)^[\s|]*{_YMD}[\s|]*$")
        return let(F.when(alone, title_date(lines)), lambda t: F.when(t.isNotNull(), as_pair(t, "title")).when(has_ledger, as_pair(one(ledger_row_dates(cut(text))), "ledger")).when(has_report, as_pair(one(report_row_dates(cut(text))), "report")).otherwise(rest))

    return let(cut(top), cascade)
