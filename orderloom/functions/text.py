"""Text expressions: spaces, labels, identities, reason codes. All run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode defines it, and a pattern of its runs (spelt out: faster than the Unicode mode of patterns).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = f"[{WHITE}]+"


def let(value: Column, use) -> Column:
    """use(value), the value computed once: expressions inside array functions aren't shared otherwise."""
    return F.element_at(F.transform(F.array(value), use), 1)


def squeeze(c: Column) -> Column:
    """White space runs become one space; the ends are cut. Null stays null."""
    return F.btrim(F.regexp_replace(c, SPACE, " "))


def strip(c: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.btrim(c, F.lit(WHITE))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def compact(c: Column) -> Column:
    """A label in lower case without white space."""
    return F.regexp_replace(F.lower(c), SPACE, "")


def bare(c: Column) -> Column:
    """Only digits, small ASCII letters and Hangul syllables; capitals are left out too, so fold the case first where it matters."""
    return F.regexp_replace(c, "[^0-9a-z가-힣]+", "")


def segments(c: Column) -> Column:
    """The parts of a label between slashes, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(c, "/"), lambda x: squeeze(x)), lambda x: x != "")


def name_key(c: Column) -> Column:
    """A loose key of a fund name: lower case, only ASCII letters and digits and Hangul syllables."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^0-9a-z가-힣]+", "")


def identity(code: Column, name: Column) -> Column:
    """What a fund is known by: its code alone where there is one, else its name. A struct of two strings."""
    k = F.coalesce(squeeze(code), F.lit(""))
    return F.struct(k.alias("code"), F.when(k == "", F.coalesce(squeeze(name), F.lit(""))).otherwise("").alias("name"))


def reason_code(c: Column) -> Column:
    """Upper case, runs of other characters as one underscore, at most 64 characters; null if nothing is left."""
    out = F.substring(F.regexp_replace(F.regexp_replace(F.upper(F.trim(c)), "[^0-9A-Z가-힣]+", "_"), "^_+|_+$", ""), 1, 64)
    return blank_to_null(out)


def looks_like_code(c: Column) -> Column:
    """Three or more capital letters and digits (a hyphen may stand between them), one digit at least."""
    return c.rlike(r"^(?=.*\d)[A-Z0-9]{2,}(?:-[A-Z0-9]+)?\z") & (F.length(c) >= 3)


def join_split_name(c: Column) -> Column:
    """A name that a layout cut in two, 'A / B', becomes 'A B'; other names stay."""
    cut = c.rlike(r"^[^\s\d/][^\d/]* / [^\s\d/][^\d/]*\z")
    return F.when(cut, F.regexp_replace(c, " / ", " ")).otherwise(c)


def contains_any(c: Column, words: list[str]) -> Column:
    """Does the text hold one of the words? One pattern, not one test a word: plans stay small."""
    return c.rlike("|".join(re.escape(w) for w in words))


def has_issue(issues: Column, code: str) -> Column:
    """Does a list of issues hold the code, alone or followed by ':' or '_'?"""
    return F.exists(issues, lambda x: (x == code) | x.startswith(code + ":") | x.startswith(code + "_"))


def without_issue(issues: Column, code: str) -> Column:
    return F.filter(issues, lambda x: ~((x == code) | x.startswith(code + ":") | x.startswith(code + "_")))
