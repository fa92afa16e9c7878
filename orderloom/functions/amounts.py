"""Amount expressions. Amounts are text with the scale that a document printed, compared as decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITE, strip

DECIMAL = "decimal(38,10)"
# Texts that stand for no amount.
EMPTY = ["", "-", "--", "N/A", "n/a", "null", "None"]
PATTERN = r"^([+-]?\d[\d,]*(?:\.\d+)?)\z"
#: Fractions that a spreadsheet leaves behind an integer: below a millionth, or above one minus a millionth.
LOW_TAIL, HIGH_TAIL = r"\.000000\d*\z", r"\.999999\d*[1-9]\d*\z"
# Units that a number may carry.
UNITS = {"억": 100_000_000, "만": 10_000, "천": 1_000}


def _bare(c: Column) -> Column:
    """The text of an amount without spaces; '' if it is none. Each step uses its input once, to keep the plan small."""
    return F.regexp_extract(F.replace(strip(c), F.lit(" "), F.lit("")), PATTERN, 1)


def parse(c: Column) -> Column:
    """The number of an amount text as decimal(38,10); null if it is none."""
    return F.replace(_bare(c), F.lit(","), F.lit("")).try_cast(DECIMAL)


def _text(d: Column) -> Column:
    return d.cast(DECIMAL).cast("string")


def snap(d: Column) -> Column:
    """A number within a millionth of an integer is that integer: spreadsheets leave such tails."""
    return F.when(_text(d).rlike(f"{LOW_TAIL}|{HIGH_TAIL}"), F.round(d, 0).cast(DECIMAL)).otherwise(d)


def group(digits: Column) -> Column:
    """Commas between the thousands of a number's whole part."""
    return F.regexp_replace(digits, r"(?<=\d)(?<!\.\d{0,30})(?=(?:\d{3})+(?:\.|\z))", ",")


def _tidy(text: Column) -> Column:
    """No zeros behind the last digit of a fraction, no sign for zero."""
    return F.regexp_replace(F.regexp_replace(text, r"\.0*\z|(?<=\.\d{1,30})0+\z", ""), r"^-(?=0\z)", "")


def render(d: Column, grouped: bool = True) -> Column:
    """A decimal as plain text."""
    return group(_tidy(_text(d))) if grouped else _tidy(_text(d))


def _forms(c: Column, grouped: bool) -> Column:
    text = _text(parse(c))
    low = _tidy(F.regexp_replace(text, LOW_TAIL, ""))
    return F.when(text.rlike(HIGH_TAIL), render(F.round(parse(c), 0), grouped)).otherwise(group(low) if grouped else low)


def canonical(c: Column) -> Column:
    """The one text of an amount, by which amounts are compared."""
    return _forms(c, True)


def plain(c: Column) -> Column:
    return _forms(c, False)


def source(c: Column) -> Column:
    """As `canonical`, but a fraction keeps the digits that the document printed."""
    kept = _bare(c).rlike(r"\.\d*[1-9]") & ~_text(parse(c)).rlike(f"{LOW_TAIL}|{HIGH_TAIL}")
    return F.when(kept, group(F.regexp_replace(F.regexp_replace(_bare(c), "[+,]", ""), r"^(-?)0+(?=\d)", "$1"))).otherwise(canonical(c))


def unsigned(c: Column) -> Column:
    return F.regexp_replace(canonical(c), r"^[+-]+", "")


def signed(c: Column, order_type: Column) -> Column:
    """The decimal with its sign: the one printed, else below zero for RED."""
    d, t = parse(c), _bare(c)
    return F.when(t.rlike("^[+-]"), d).when(order_type == "RED", -d).otherwise(d).cast(DECIMAL)


TOKEN = r"^[+-]?\d[\d,]*(?:\.\d+)?[억만천]?\z"


def token(c: Column) -> Column:
    """A document's cell without currency marks and spaces, if it is an amount; null else."""
    t = F.regexp_replace(F.translate(c, WHITE, ""), r"(?i)KRW|[₩￦원]", "")
    # most cells are text: their first letter tells
    return F.when(c.rlike(rf"^[{WHITE}]*(?i:krw|[₩￦원+\-\d])"), F.when(t.rlike(TOKEN), t))


def token_number(t: Column) -> Column:
    """The number of a token, its unit multiplied in."""
    unit = F.regexp_extract(t, "([억만천])\\z", 1)
    number = F.replace(F.regexp_replace(t, "[억만천]\\z", ""), F.lit(","), F.lit(""))
    factor = F.lit(1)
    for mark, value in UNITS.items():
        factor = F.when(unit == mark, F.lit(value)).otherwise(factor)
    return (number.try_cast("decimal(24,6)") * factor.cast("decimal(10,0)")).cast(DECIMAL)


def document_number(c: Column) -> Column:
    """The number of a document's cell: currency marks and spaces dropped, one of the units allowed."""
    return token_number(token(c))


def is_number(c: Column) -> Column:
    return document_number(c).isNotNull()


def is_zero(c: Column) -> Column:
    """A cell that is zero or says so with a dash."""
    return F.trim(c).isin("-", "--") | (F.coalesce(document_number(c), F.lit(1).cast(DECIMAL)) == 0)


def output(c: Column, order_type: Column) -> Column:
    """The amount as it leaves the system: the source text, unsigned for redemptions."""
    t = strip(c)
    text = F.coalesce(source(t), t)
    text = F.regexp_replace(text, r"^\+", "")
    return F.when(order_type == "RED", F.regexp_replace(text, "^-", "")).otherwise(text)
