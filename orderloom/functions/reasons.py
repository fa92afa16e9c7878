"""Slot names, and the codes that say which evidence a value came from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import amounts, labels, text

_BUSINESS = r"익+영업일|제\s*\d+\s*영업일"
# Words of labels over amounts that were carried out, and over those of the same day.
PROCESSED = ["정산액", "결제금액", "실행금액", "execution", "settlement", "결제일", "processed"]
SAME_DAY = ["당일", "확정", "당일이체", "당일투입", "당일인출", "설정금액", "해지금액", "입금액", "출금액", "buy", "sell", "subscription", "redemption"]


def slot_id(t_day: Column, kind: Column) -> Column:
    """T{day}_{SUB, RED or NET}."""
    return F.concat(F.lit("T"), t_day.cast("string"), F.lit("_"), kind)


def slot_kind(order_type: Column, signed: Column) -> Column:
    """NET for a column whose sign gives the direction, else the direction."""
    return F.when(signed, "NET").otherwise(order_type)


def section_direction(label: Column) -> Column:
    """The direction of a section's heading: a numbered 'subscription' or 'redemption', or a kind of transaction."""
    low = F.lower(F.trim(label))
    tight = F.regexp_replace(low, r"\s+", "")
    kind = tight.contains("거래종류")
    return (
        F.when(low.rlike(r"^(?:\d+\.\s*)?subscription\z"), "SUB").when(low.rlike(r"^(?:\d+\.\s*)?redemption\z"), "RED")
        .when(kind & tight.contains("펀드설정"), "SUB").when(kind & tight.contains("펀드해지"), "RED")
    )


def header_direction(label: Column) -> Column:
    return F.when(~labels.is_metadata(label), labels.direction(labels.semantic(label)))


def slot_reason(t_day: Column, slot: Column, label: Column) -> Column:
    n = text.squeeze(F.coalesce(label, F.lit("")))
    way = header_direction(n)
    section = section_direction(n).isNotNull() & ~labels.is_explicit(n)
    return (
        F.when(t_day >= 1, F.when(F.lower(n).rlike(_BUSINESS), "SLOT_BUSINESS_DAY_HEADER").otherwise("SLOT_TPLUS_SCHEDULE"))
        .when(labels.is_net(n) | F.coalesce(slot, F.lit("")).endswith("_NET"), "SLOT_T0_NET")
        .when(section, "SLOT_SECTION_DIRECTION")
        .when(way == "SUB", "SLOT_T0_EXPLICIT_SUB")
        .when(way == "RED", "SLOT_T0_EXPLICIT_RED")
        .otherwise("SLOT_OTHER_VERIFIED")
    )


def settle_reason(t_day: Column, label: Column) -> Column:
    n = labels.semantic(F.coalesce(label, F.lit("")))
    low = F.lower(n)
    return (
        F.when(labels.is_schedule(n), F.when(low.rlike(_BUSINESS), "SETTLE_BUSINESS_DAY_HEADER").otherwise("SETTLE_FUTURE_LABEL"))
        .when(text.contains_any(low, PROCESSED), "SETTLE_PROCESSED_RESULT")
        .when(text.contains_any(low, SAME_DAY), "SETTLE_SAME_DAY_LABEL")
        .when(t_day.isNotNull(), "SETTLE_TDAY_FALLBACK")
        .otherwise("SETTLE_OTHER_VERIFIED")
    )


def type_reason(amount: Column, label: Column) -> Column:
    a = F.coalesce(amounts.canonical(amount), F.lit(""))
    n = text.squeeze(F.coalesce(label, F.lit("")))
    way, section = header_direction(n), section_direction(n)
    low = F.lower(n)
    return (
        F.when(a.startswith("-"), "ORDER_SIGN_NEGATIVE")
        .when(a.startswith("+"), "ORDER_SIGN_POSITIVE")
        .when(section.isNotNull() & ~labels.is_explicit(n), F.concat(F.lit("ORDER_SECTION_"), section))
        .when(way.isNotNull(), F.concat(F.lit("ORDER_LABEL_"), way))
        .when(low.contains("transaction type") | low.contains("buy&sell") | (low == "구분"), "ORDER_TRANSACTION_TYPE")
        .otherwise("ORDER_OTHER_VERIFIED")
    )


def amount_reason(t_day: Column, amount: Column, label: Column) -> Column:
    n = text.squeeze(F.coalesce(label, F.lit("")))
    way = header_direction(n)
    return (
        F.when(labels.is_net(n), "AMOUNT_NET_COLUMN")
        .when((t_day >= 1) | labels.is_schedule(n), "AMOUNT_SCHEDULE_BUCKET")
        .when(way.isNotNull(), F.concat(F.lit("AMOUNT_EXPLICIT_"), way))
        .when(F.coalesce(amounts.canonical(amount), F.lit("")).startswith("-"), "AMOUNT_SIGNED_OUTFLOW")
        .otherwise("AMOUNT_OTHER_VERIFIED")
    )


def validated(given: Column, inferred: Column) -> Column:
    """The code given, unless it is missing or says nothing: then the inferred one."""
    code = text.reason_code(given)
    return F.when(code.isNull() | (code == "AMOUNT_OTHER_VERIFIED"), inferred).otherwise(code)
