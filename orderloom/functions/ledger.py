"""Section ledgers: rows of orders under numbered headings in plain text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import amounts, dates

# The header line of a ledger, in lower case.
HEADER = "fund name code no. of unit nav date nav amount(krw) bank"
#: A ledger's row: name, code, units, date, price, amount, and perhaps a bank.
LEDGER_ROW = r"^(.+?)\s+([A-Z0-9][A-Z0-9-]*)\s+([\d,.]+|-)\s+(\d{4}-\d{2}-\d{2}|\d{1,2}-[A-Za-z]{3}-\d{2})\s+([\d,.]+)\s+([\d,.]+|-)(?:\s+\S.*)?\z"
SECTION_SUB = r"(?i)^\s*\d+\.\s*(?:subscription|buy|설정|입금|투입|매입)\s*\z"
SECTION_RED = r"(?i)^\s*\d+\.\s*(?:redemption|sell|해지|출금|인출|환매)\s*\z"

def rows(lines: Column) -> Column:
    """The rows of a ledger under numbered headings, as an array (order_type, fund_name, fund_code, base_date, amount, line_no).

    A heading gives the direction of the rows behind it, and only those below a header line are read. Each line becomes
    a letter; the runs from heading to heading tell every line its heading: a fold without a window.
    """
    low = lambda x: F.lower(x)
    compacted = lambda x: F.regexp_replace(low(x), r"\s+", "")
    letter = (
        lambda x: F.when(x.rlike(SECTION_SUB) | (compacted(x).contains("거래종류") & compacted(x).contains("펀드설정")), "S")
        .when(x.rlike(SECTION_RED) | (compacted(x).contains("거래종류") & compacted(x).contains("펀드해지")), "R")
        .when(low(x).contains(HEADER), "H")
        .when(~low(x).startswith("total ") & x.rlike(LEDGER_ROW), "x")
        .otherwise(".")
    )
    marks = F.array_join(F.transform(lines, letter), "")
    runs = F.regexp_extract_all(marks, F.lit(r"^[^SR]+|[SR][^SR]*"), F.lit(0))
    told = F.flatten(F.transform(runs, lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda p: F.when((F.substring(t, p, F.lit(1)) == "x") & t.rlike("^[SR]") & (F.instr(t, "H") > 0) & (p > F.instr(t, "H")), F.substring(t, 1, 1)))))
    hits = F.filter(F.transform(F.arrays_zip(lines.alias("line"), told.alias("kind")), lambda z, i: F.struct(z["line"].alias("line"), z["kind"].alias("kind"), i.alias("line_no"))), lambda z: z["kind"].isNotNull())

    def row(z: Column) -> Column:
        part = lambda k: F.regexp_extract(z["line"], LEDGER_ROW, k)
        return F.struct(
            F.when(z["kind"] == "S", "SUB").otherwise("RED").alias("order_type"), part(1).alias("fund_name"), part(2).alias("fund_code"), dates.normalize(part(4)).alias("base_date"),
            amounts.parse(part(6)).alias("amount"), z["line_no"].alias("line_no"),
        )

    return F.transform(hits, row)


# Headings of plain-text sections, and words of their header lines.
SUB_HEADINGS = ["subscription", "buy", "설정", "입금", "투입", "매입"]
RED_HEADINGS = ["redemption", "sell", "해지", "출금", "인출", "환매"]
HEADER_WORDS = ["fund", "code", "unit", "nav", "date", "amount", "bank", "펀드", "코드", "좌수", "날짜", "금액", "결제일", "기준일", "은행"]
_DATE = r"^(?:\d{1,2}-[A-Za-z]{3}-\d{2}|\d{4}[-/.]\d{2}[-/.]\d{2})\z"


def _places(tokens: Column, test) -> Column:
    return F.filter(F.transform(tokens, lambda t, i: F.when(test(t), i)), lambda i: i.isNotNull())


def order_line(line: Column, header: Column) -> Column:
    """(fund_code, fund_name, amount, tail) of a line of plain text; null if it is none.

    The amount is the last number other than zero behind the date; a single one only counts where the date is of the
    long form and the header names amounts but no price. Without a date it is the last number. The code is the last
    token that looks like one before the date (else before the amount), the name all before it.
    """
    code = lambda t: t.rlike(r"^[A-Z0-9]{3,}\z")
    number = lambda t: t.rlike(amounts.TOKEN) & t.rlike("[1-9]")

    def parse(t: Column) -> Column:
        date = F.get(_places(t, lambda x: x.rlike(_DATE)), F.lit(0))
        behind = F.filter(_places(t, number), lambda i: date.isNull() | (i > date))
        long = F.get(t, date).rlike(r"^\d{4}") & header.rlike("amount|금액|settlement|execution|결제") & ~header.rlike("nav|기준가|price")
        last = F.get(behind, F.size(behind) - 1)
        at = F.when(date.isNull() | (F.size(behind) >= 2) | ((F.size(behind) == 1) & F.coalesce(long, F.lit(False))), last).otherwise(F.when(F.size(behind) == 0, F.element_at(F.concat(F.array(F.lit(None).cast("int")), _places(t, number)), -1)))
        codes = F.filter(_places(t, code), lambda i: i < F.coalesce(date, at))
        c = F.get(codes, F.size(codes) - 1)
        name = F.array_join(F.slice(t, F.lit(1), F.coalesce(c, F.lit(0))), " ")
        row = F.struct(F.get(t, c).alias("fund_code"), name.alias("fund_name"), F.get(t, at).alias("amount"), F.array_join(F.slice(t, at + 2, F.size(t)), "¦").alias("tail"))
        return F.when((F.size(t) >= 4) & at.isNotNull() & c.isNotNull() & (name != ""), row)

    return F.element_at(F.transform(F.array(F.split(line, " ")), parse), 1)


def plain_rows(lines: Column) -> Column:
    """The order rows of a section's filled lines: (order_type, fund_code, fund_name, amount, tail), below headings of one direction."""
    from .labels import section_label

    heading = lambda x: section_label(x)
    low = lambda x: F.lower(x)
    hits = lambda x: sum((F.when(low(x).contains(w), 1).otherwise(0) for w in HEADER_WORDS), F.lit(0))
    total = lambda x: F.lower(F.get(F.split(x, " "), F.lit(0))).rlike(r"^total\z|subtotal|(?:소계|합계|총계)\z|계[\[\](){}<>]*\z|\d개펀드")
    letter = lambda x: F.when(heading(x).isin(SUB_HEADINGS), "S").when(heading(x).isin(RED_HEADINGS), "R").when(low(x).contains("the order of subscription and redemption") | (hits(x) >= 4), "H").when(total(x), ".").otherwise("x")
    marks = F.array_join(F.transform(lines, letter), "")
    runs = F.regexp_extract_all(marks, F.lit(r"^[^SR]+|[SR][^SR]*"), F.lit(0))
    starts = lambda t, p: F.length(F.regexp_extract(F.substring(t, F.lit(1), p), "^(.*H)", 1))
    told = F.flatten(F.transform(runs, lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda p: F.struct(F.when((F.substring(t, p, F.lit(1)) == "x") & t.rlike("^[SR]"), F.substring(t, 1, 1)).alias("way"), (p - starts(t, p)).alias("up"), (starts(t, p) > 0).alias("headed")))))
    z = F.filter(F.transform(F.arrays_zip(lines.alias("line"), told.alias("k")), lambda z, i: F.struct(z["line"].alias("line"), z["k"].alias("k"), i.alias("i"))), lambda z: z["k"]["way"].isNotNull())
    header = lambda v: F.when(v["k"]["headed"], F.lower(F.get(lines, v["i"] - v["k"]["up"]))).otherwise("")
    rows = F.transform(z, lambda v: F.struct(F.when(v["k"]["way"] == "S", "SUB").otherwise("RED").alias("order_type"), order_line(v["line"], header(v)).alias("r")))
    return F.transform(F.filter(rows, lambda v: v["r"].isNotNull()), lambda v: F.struct(v["order_type"].alias("order_type"), v["r"]["fund_code"].alias("fund_code"), v["r"]["fund_name"].alias("fund_name"), v["r"]["amount"].alias("amount"), v["r"]["tail"].alias("tail")))
