"""What stays of the issues that a document's stages reported, once its orders and its text are known; its status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import amounts, dates, labels, text
from . import layout

# Words of labels under which a cell is an amount of the document, and words that it isn't one.
AMOUNT_WORDS = ["금액", "amount", "예상", "결제", "execution", "settlement", "입금", "출금", "설정", "해지", "buy", "sell", "subscription", "redemption"]
UNIT_WORDS = ["좌수", "unit", "share"]
#: Stage issues that go when the field is on every order and the matching 'missing' issue is gone (fixed values).
PARTIAL = {"BASE_DATE": "base_date", "T_DAY": "t_day", "TRANSFER_AMOUNT": "transfer_amount", "SETTLE_CLASS": "settle_class", "ORDER_TYPE": "order_type"}
# Issues about amounts of zero, and about a missing manager.
ZERO_ISSUES = ["TRANSFER_AMOUNT_ZERO", "FUND_WITH_ZERO_ALL_AMOUNTS", "FUND_NO_ORDER_EVIDENCE"]
MANAGER_ISSUES = ["NO_MANAGER_FILTER_APPLIED", "NO_MANAGER_INFO", "MANAGER_MISSING", "MANAGER_MISSING_IN_RAW_TEXT"]
AMBIGUOUS = ["FUND_NAME_AMBIGUOUS_IN_RAW_TEXT", "FUND_NAME_AMBIGUOUS_IN_MARKDOWN"]


def paid_funds(tabs: DataFrame) -> DataFrame:
    """(doc_id, codes, keys): the funds, by code and by loose name, for which a table row holds an amount other than zero."""
    pays = F.transform("classes", lambda c: (c["label"] == "") | (text.contains_any(c["low"], AMOUNT_WORDS) & ~text.contains_any(c["low"], UNIT_WORDS)))
    t = tabs.withColumn("pays", pays)
    own = F.filter("body", lambda z: F.exists(F.arrays_zip(z["row"].alias("c"), F.col("pays").alias("y")), lambda q: q["y"] & q["c"].rlike(r"^[+-]?[\d,]*\d(?:\.\d+)?\z") & q["c"].rlike("[1-9]")))
    cells = F.transform(own, lambda z: F.struct(F.get(z["row"], F.col("code_at") - 1).alias("code"), text.name_key(F.get(z["row"], F.col("name_at") - 1)).alias("key")))
    r = t.select("doc_id", layout.posexplode(cells).alias("p", "f")).where("p IS NOT NULL")
    return r.groupBy("doc_id").agg(F.collect_set("f.code").alias("codes"), F.collect_set(text.blank_to_null(F.col("f.key"))).alias("keys"))


def open_items(items: DataFrame, paid: DataFrame) -> DataFrame:
    """(doc_id, …_open): does a document hold an item that lacks a field, though its text has an amount for the fund and no
    item of the same bucket has the field? Facts of a bucket are aggregated and joined back, so a hot one isn't sorted."""
    n = items.select(
        "doc_id", text.squeeze(F.coalesce("fund_code", F.lit(""))).alias("code"), text.squeeze(F.coalesce("fund_name", F.lit(""))).alias("name"), dates.normalize(F.col("base_date")).alias("day"), "t_day",
        text.squeeze(F.coalesce("evidence_label", F.lit(""))).alias("label"), text.squeeze(F.coalesce("settle_class", F.lit(""))).alias("settle"), text.squeeze(F.coalesce("order_type", F.lit(""))).alias("kind"),
        amounts.canonical(F.col("transfer_amount")).alias("amount"),
    )

    def known(df: DataFrame, keys: list[str], field: Column, name: str) -> DataFrame:
        facts = df.groupBy("doc_id", *keys).agg(F.max(field).alias(name)).select(F.col("doc_id").alias("k_doc"), *(F.col(k).alias(f"k_{k}") for k in keys), name)
        on = [F.col("doc_id") == F.col("k_doc"), *(F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys)]
        return df.join(facts, on).drop("k_doc", *(f"k_{k}" for k in keys))

    bucket = ["code", "name", "day", "t_day", "label"]
    n = known(n, [*bucket, "settle"], F.col("amount").isNotNull(), "has_amount")
    n = known(n, [*bucket, "settle"], F.col("kind") != "", "has_kind")
    n = known(n, bucket, F.col("settle") != "", "has_settle")
    n = known(n, ["code", "name", "day", "label", "settle"], F.col("t_day").isNotNull(), "has_day")
    keys = ["day", "t_day", "label", "settle", "kind", "amount"]
    whole = n.where("code <> '' AND name <> ''").groupBy("doc_id", *keys).agg(F.collect_list(F.struct("code", "name")).alias("whole")).select(F.col("doc_id").alias("k_doc"), *(F.col(k).alias(f"k_{k}") for k in keys), "whole")
    n = n.join(whole, [F.col("doc_id") == F.col("k_doc"), *(F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys)], "left")
    near = F.filter(F.coalesce("whole", F.array().cast("array<struct<code:string,name:string>>")), lambda x: ((F.col("code") == "") | (x["code"] == F.col("code"))) & ((F.col("name") == "") | (x["name"] == F.col("name"))))
    n = n.withColumn("has_fund", F.when((F.col("code") == "") & (F.col("name") == ""), F.size(near) == 1).otherwise(F.size(near) > 0))
    n = n.join(paid, "doc_id", "left")
    unknown = (F.col("code") == "") & (text.name_key(F.col("name")) == "")
    backed = unknown | F.coalesce(F.array_contains("codes", F.col("code")), F.lit(False)) | F.coalesce(F.array_contains("keys", text.name_key(F.col("name"))), F.lit(False))
    money = F.col("amount").isNotNull() & (F.col("amount") != "0") & ~labels.is_non_amount(F.col("label"))
    any_of = lambda c: F.max(F.coalesce(c, F.lit(False)))
    return n.groupBy("doc_id").agg(
        (any_of(F.col("t_day").isNull() & labels.is_schedule(F.col("label"))) & any_of(F.col("t_day").isNull() & backed & ~F.col("has_day"))).alias("t_day_open"),
        any_of(F.col("amount").isNull() & backed & ~F.col("has_amount")).alias("amount_open"),
        any_of((F.col("kind") == "") & backed & ~F.col("has_kind")).alias("kind_open"),
        any_of((F.col("settle") == "") & money & labels.settle_class(F.lit(None).cast("string"), F.col("t_day"), F.col("label")).isNull() & ~F.col("has_settle")).alias("settle_open"),
        any_of(((F.col("code") == "") | (F.col("name") == "")) & money & ~F.col("has_fund")).alias("fund_open"),
    )


def reconciled(payloads: DataFrame, facts: DataFrame, blocking: list[str]) -> DataFrame:
    """(payload_id, kept): the issues of payloads (payload_id, issues, orders, in_scope, corroborated) that nothing disproves.

    in_scope says that managers are known and every order is one of theirs, corroborated that another reading of the
    document gives the same orders. Issues match by code, alone or followed by ':' or '_'.
    """
    f = facts.withColumnRenamed("doc_id", "payload_id")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    some = F.size("orders") > 0
    full = lambda c: some & F.forall("orders", lambda o: F.coalesce(o[c], F.lit("")) != "")
    j = payloads.join(f, "payload_id", "left").withColumn("kept", F.col("issues"))

    def drop(df: DataFrame, codes: list[str], when: Column) -> DataFrame:
        kept = F.col("kept")
        for c in codes:
            kept = text.without_issue(kept, c)
        return df.withColumn("kept", F.when(F.coalesce(when, F.lit(False)), kept).otherwise(F.col("kept")))

    fund = full("fund_code") & full("fund_name") & F.forall("orders", lambda o: ~F.coalesce(o["fund_code"], F.lit("")).isin("-") & ~F.coalesce(o["fund_name"], F.lit("")).isin("-"))
    j = drop(j, ["T_DAY_MISSING"], no(F.col("t_day_open")))
    j = drop(j, ["TRANSFER_AMOUNT_MISSING"], full("transfer_amount") & no(F.col("amount_open")))
    j = drop(j, ["ORDER_TYPE_MISSING"], full("order_type") & no(F.col("kind_open")))
    j = drop(j, ["SETTLE_CLASS_MISSING"], no(F.col("settle_open")) & F.forall("orders", lambda o: F.coalesce(o["settle_class"], F.lit("")) != ""))
    j = drop(j, ["BASE_DATE_MISSING"], full("base_date"))
    j = drop(j, ["FUND_METADATA_INCOMPLETE"], no(F.col("fund_open")) & fund)
    for stage, field in PARTIAL.items():
        j = drop(j, [f"{stage}_STAGE_PARTIAL"], full(field) & ~text.has_issue(F.col("kept"), f"{stage}_MISSING"))
    every = fund
    for field in PARTIAL.values():
        every = every & full(field)
    others = F.lit(False)
    for code in blocking:
        if code != "LLM_INVALID_RESPONSE_FORMAT":
            others = others | text.has_issue(F.col("kept"), code)
    j = drop(j, ["LLM_INVALID_RESPONSE_FORMAT"], every & ~others)
    paid = some & F.forall("orders", lambda o: F.coalesce(amounts.canonical(o["transfer_amount"]) != "0", F.lit(False)))
    j = drop(j, ZERO_ISSUES, paid)
    j = drop(j, MANAGER_ISSUES, some & F.col("in_scope"))
    pairs = F.transform("orders", lambda o: F.struct(F.coalesce(o["fund_code"], F.lit("")).alias("c"), F.coalesce(o["fund_name"], F.lit("")).alias("n")))
    j = drop(j, ["DUPLICATE_FUND_CODE_NAME_PAIRS"], F.size(F.array_distinct(pairs)) == F.size("orders"))
    coded = F.array_distinct(F.filter(pairs, lambda p: p["c"] != ""))
    j = drop(j, ["FUND_CODE_DUPLICATE"], (F.size(coded) > 0) & (F.size(F.array_distinct(F.transform(coded, lambda p: p["c"]))) == F.size(coded)))
    j = drop(j, ["ORDER_COVERAGE_ESTIMATE_MISMATCH"], F.col("corroborated"))
    j = drop(j, AMBIGUOUS, F.col("corroborated") & fund)
    return j.select("payload_id", "kept")


def document_status(payloads: DataFrame) -> DataFrame:
    """(payload_id, status, reason) of task payloads with n_orders: a document without orders is skipped, and why."""
    skip = (
        F.when(text.blank_to_null(F.col("non_instruction_reason")).isNotNull(), F.concat(F.lit("not an order instruction: "), F.coalesce("source_path", F.lit("")), F.lit(": "), F.col("non_instruction_reason")))
        .when(F.col("allow_empty_result"), "no trade in the document")
        .when(F.col("scope_excludes_all_funds"), "no order of the funds in scope")
        .otherwise("no order found")
    )
    has = F.coalesce("n_orders", F.lit(0)) > 0
    return payloads.select("payload_id", F.when(has, "COMPLETED").otherwise("SKIPPED").alias("status"), F.when(~has, skip).alias("reason"))


# What tells documents that hold no instruction.
TITLE_MARKERS = ["설정해지금액통보", "설정/해지금액통보"]
COVER_MARKERS = ["첨부파일과 같이", "송부드리니", "참고하시기 바랍니다", "업무에 참고", "감사합니다"]
ATTACHMENT_MARKERS = ["첨부", "attached", "attachment", "붙임"]
FOOTER_MARKERS = ["받기", "mac용 outlook", "outlook for mac"]
STRONG_MARKERS = [
    "운용지시서", "지시서", "order of subscription and redemption", "buy & sell report", "buy&sell report", "설정 및 해지내역", "설정/해지 내역", "설정해지내역서",
    "실적배당형 펀드별 설정 및 해지내역",
]


def non_instruction(docs: DataFrame) -> DataFrame:
    """(doc_id, why) of documents (doc_id, text, n_cells): 'notice' or 'cover' where they hold no instruction, null else."""
    low = F.lower("text")
    none = F.coalesce("n_cells", F.lit(0)) == 0
    count = lambda words: sum((F.when(low.contains(w), 1).otherwise(0) for w in words), F.lit(0))
    mail = low.contains("subject:") & low.contains("from:") & low.contains("to:") & low.contains("date:")
    body = F.filter(F.transform(F.split(F.regexp_extract("text", r"(?s)^(?:[^\n]*\S[^\n]*\n)*[^\S\n]*\n(.*)", 1), "\n"), lambda x: text.strip(x)), lambda x: x != "")
    heads = F.size(F.filter(body, lambda x: F.lower(x).rlike(r"^(?:to|from)\.")))
    short = (F.size(body) > 0) & (F.size(body) <= 6) & (text.contains_any(low, ATTACHMENT_MARKERS) | text.contains_any(low, FOOTER_MARKERS) | (heads >= 2))
    title = text.contains_any(F.regexp_replace(low, r"\s+", ""), TITLE_MARKERS)
    cover = mail & (((count(COVER_MARKERS) >= 2) & ~text.contains_any(low, STRONG_MARKERS)) | short)
    return docs.where("text IS NOT NULL").select("doc_id", F.when(none & title, "notice").when(none & cover, "cover").alias("why"))
