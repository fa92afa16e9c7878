"""Date expressions on document text. Dates stay text (documents print impossible ones); `to_date` types them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months as reports abbreviate them.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
# Label words that mean the same day.
SAME_DAY = [
    "당일", "확정", "실행", "설정금액", "해지금액", "입금액", "출금액", "투입금액", "인출금액", "순유입", "순투입", "결제금액",
    "buy", "sell", "settlement amount", "execution amount", "subscription", "redemption",
]


def _pad(c: Column) -> Column:
    return F.lpad(c, 2, "0")


def ymd(y: Column, m: Column, d: Column) -> Column:
    return F.concat_ws("-", y, _pad(m), _pad(d))


def month_first(c: Column) -> Column:
    """MM-DD-YYYY as YYYY-MM-DD."""
    p = r"^\s*(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})\s*\z"
    return F.when(c.rlike(p), ymd(F.regexp_extract(c, p, 3), F.regexp_extract(c, p, 1), F.regexp_extract(c, p, 2)))


def short_english(c: Column) -> Column:
    """27-Nov-25 as 2025-11-27; years from 69 on belong to the last century."""
    p = r"(?i)^\s*(\d{1,2})-([a-z]{3})-(\d{2})\s*\z"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(c, p, 2)))
    year = F.regexp_extract(c, p, 3).try_cast("int")
    full = F.when(year >= 69, year + 1900).otherwise(year + 2000).cast("string")
    return F.when(c.rlike(p) & (month > 0), ymd(full, month.cast("string"), F.regexp_extract(c, p, 1)))


def year_first(c: Column) -> Column:
    """Eight digits in all are cut 4-2-2; else the first Y-M-D with '-', '/' or '.'."""
    digits = F.regexp_replace(c, r"[^0-9]", "")
    p = r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})"
    return F.when(F.length(digits) == 8, F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))).when(
        c.rlike(p), ymd(F.regexp_extract(c, p, 1), F.regexp_extract(c, p, 2), F.regexp_extract(c, p, 3))
    )


def normalize(c: Column) -> Column:
    """A date text of any of the three kinds as YYYY-MM-DD; the month-first kinds are tried first."""
    return F.coalesce(month_first(c), short_english(c), year_first(c))


def typed(c: Column) -> Column:
    """The date, null where the text is no date of the calendar."""
    return F.try_to_date(c, "yyyy-MM-dd")


def bucket_key(label: Column, column: Column, generic: Column | None = None) -> Column:
    """The settlement bucket that a column label names: T+n, a date, month and day, T0, or the column itself."""
    t = F.lower(label)
    plus = r"[td]\s*\+\s*(\d+)"
    chain = r"(익+)영업일"
    nth = r"제\s*(\d+)\s*영업일"
    iso = r"\d{4}-\d{2}-\d{2}"
    day = r"(\d{1,2})\s*월\s*(\d{1,2})\s*일"
    same = t.rlike("|".join(SAME_DAY))
    same = same if generic is None else same | generic
    return (
        F.when(t.rlike(plus), F.concat(F.lit("T+"), F.regexp_extract(t, plus, 1)))
        .when(t.rlike(chain), F.concat(F.lit("T+"), F.length(F.regexp_extract(t, chain, 1)).cast("string")))
        .when(t.rlike(nth), F.concat(F.lit("T+"), F.regexp_extract(t, nth, 1)))
        .when(F.contains(t, F.lit("t일")), F.lit("T0"))
        .when(t.rlike(iso), F.regexp_extract(t, iso, 0))
        .when(t.rlike(day), F.concat(F.lit("M"), _pad(F.regexp_extract(t, day, 1)), F.lit("D"), _pad(F.regexp_extract(t, day, 2))))
        .when(same, F.lit("T0"))
        .otherwise(F.concat(F.lit("COL_"), column.cast("string")))
    )


def days_ahead(label: Column, base: Column) -> Column:
    """The settlement day that a label names: n of T+n, else the calendar days from the base date to its month and day."""
    plus = r"(?i)t\s*\+\s*(\d+)"
    day = r"(\d{1,2})\s*월\s*(\d{1,2})\s*일"
    b = typed(base)
    there = F.try_to_date(F.concat_ws("-", F.year(b).cast("string"), _pad(F.regexp_extract(label, day, 1)), _pad(F.regexp_extract(label, day, 2))), "yyyy-MM-dd")
    return F.when(label.rlike(plus), F.regexp_extract(label, plus, 1).try_cast("int")).when(label.rlike(day), F.date_diff(there, b))


def future_key(label: Column, base: Column) -> Column:
    """What settlement a label names beside the base date's: a month and day, business days, or the label itself where it
    speaks of a schedule, its words of direction left out; null for the same day."""
    from . import labels

    day = r"(\d{1,2})\s*월\s*(\d{1,2})\s*일"
    low = F.lower(label)
    md = F.concat(_pad(F.regexp_extract(label, day, 1)), F.lit("-"), _pad(F.regexp_extract(label, day, 2)))
    business = r"(익+영업일|제\s*\d+\s*영업일)"
    words = "|".join(w for w in [*labels.SUB_WORDS, *labels.RED_WORDS] if w != "납입")
    return (
        F.when(label.rlike(day), F.when(md != F.substring(base, 6, 5), F.concat(F.lit("DATE:"), md)))
        .when(low.rlike(business), F.concat(F.lit("BUSINESS:"), F.regexp_extract(low, business, 1)))
        .when(labels.is_schedule(low), F.concat(F.lit("SCHEDULE:"), F.regexp_replace(F.regexp_replace(low, words, ""), r"\s+", "")))
    )


def noted_day(note: Column, amount: Column, number) -> Column:
    """The day of the month that a note gives for an amount: the one written before its own 'amount > day', else the
    only day in the note; number reads a note's amounts."""
    p = r"(?:([+-]?\d[\d,]*(?:\.\d+)?[억만천]?)\s*>\s*)?(\d{1,2})일"
    pairs = F.arrays_zip(F.regexp_extract_all(note, F.lit(p), F.lit(1)).alias("a"), F.regexp_extract_all(note, F.lit(p), F.lit(2)).alias("d"))
    own = F.get(F.filter(pairs, lambda z: F.coalesce(F.abs(number(z["a"]) - amount) < 0.5, F.lit(False))), F.lit(0))["d"].try_cast("int")
    days = F.array_distinct(F.transform(pairs, lambda z: z["d"].try_cast("int")))
    return F.coalesce(own, F.when(F.size(days) == 1, F.get(days, F.lit(0))))
