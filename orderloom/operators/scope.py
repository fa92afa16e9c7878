"""Whose funds a document is about: read off its manager column, or a line that names its manager."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from . import layout

#: A line that names the manager of the tables in its section, or, if it has none, of the next section's.
_LINE = r"(?i)^(?:external fund manager|운용사명|운용사|manager)\s*[:：=]\s*(.+?)\z"
# Cells that name no manager.
_NO_MANAGER = ["", "-", "--", "—", "n/a", "na", "null"]
# Words that make a section the likelier place of a manager's line, and words of quoted mails.
_WORDS = ["설정", "해지", "입금", "출금", "투입", "인출", "buy", "sell", "subscription", "redemption", "결제", "settlement", "기준일", "date"]
_QUOTED = ["forwarded message", "original message", "subject:", "from:", "sent:", "to:"]


def _line_scope(sects: DataFrame, target: str) -> DataFrame:
    """(doc_id, section_no, own, piped, score): does a line of the section name the target, has it tables, how likely is it the place?"""
    lines = F.transform(F.filter(F.split("section", "\n"), lambda x: ~x.contains(layout.CELL)), lambda x: F.regexp_extract(text.strip(x), _LINE, 1))
    named = F.get(F.filter(lines, lambda x: x != ""), F.lit(0))
    low = F.lower("section")
    count = lambda words, n: sum((F.when(low.contains(w), n).otherwise(0) for w in words), F.lit(0))
    rows = F.size(F.filter(F.split("section", "\n"), lambda x: x.contains(layout.CELL)))
    dates = F.least(F.size(F.regexp_extract_all("section", F.lit(r"\d{4}[-./]\d{1,2}[-./]\d{1,2}"), F.lit(0))) * 2, F.lit(12))
    return sects.select("doc_id", "section_no", named.contains(target).alias("own"), (rows > 0).alias("piped"), (rows * 4 + count(_WORDS, 3) + dates - count(_QUOTED, 15)).alias("score"))


def document_scope(docs: DataFrame, target: str) -> DataFrame:
    """(doc_id, manager_column_present, include_all_funds, fund_codes, fund_names, canonical_fund_names) of documents (doc_id, text).

    Funds are those of data rows whose manager cell holds the target. A table without managers belongs to the target if
    a line of its section says so, or one of an earlier section that had no table. Without any such fund the line of
    the likeliest section decides on all; without any word of managers all funds count.
    """
    sects = layout.sections(docs.select("doc_id", "text"))
    own = _line_scope(sects, target)
    w = W.partitionBy("doc_id").orderBy("section_no").rowsBetween(W.unboundedPreceding, -1)
    state = F.when(F.col("own").isNotNull(), F.struct(F.when(~F.col("piped"), F.col("own")).alias("v"))).when(F.col("piped"), F.struct(F.lit(None).cast("boolean").alias("v")))
    told = own.withColumn("before", F.last(state, ignorenulls=True).over(w)).select("doc_id", "section_no", "own", "score", F.coalesce("own", F.col("before.v"), F.lit(False)).alias("all"))
    t = layout.tables(layout.raw_rows(sects))
    cell = lambda z, at: F.coalesce(text.strip(F.get(z["own"], F.col(at) - 1)), F.lit(""))
    data = F.filter("body", lambda z: z["data"])
    fund = lambda z: F.struct(cell(z, "code_at").alias("code"), cell(z, "name_at").alias("name"), cell(z, "manager_at").alias("manager"))
    usable = (F.col("code_at").isNotNull() | F.col("name_at").isNotNull()) & F.exists("classes", lambda c: c["any"])
    rows = F.transform(F.when(usable, data), fund)
    t = t.select("doc_id", "section_no", F.array(F.struct(F.col("manager_at").isNotNull().alias("has"), rows.alias("rows"))).alias("t"))
    t = t.select("doc_id", "section_no", layout.posexplode("t").alias("p", "t")).where("t.rows IS NOT NULL").select("doc_id", "section_no", "t.*")
    t = t.withColumn("managed", F.col("has") & F.exists("rows", lambda r: ~F.lower(r["manager"]).isin(_NO_MANAGER)))
    j = t.join(told.select("doc_id", "section_no", "all"), ["doc_id", "section_no"])
    kept = F.filter("rows", lambda r: (F.col("has") & r["manager"].contains(target)) | (F.col("all") & ~F.col("managed")))
    kept = F.filter(kept, lambda r: ~layout.is_total_text(r["code"]) & ~layout.is_total_text(r["name"]))
    funds = j.select("doc_id", "managed", layout.posexplode(F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(None).cast("struct<code:string,name:string,manager:string>")))).alias("p", "r"))
    by_table = funds.groupBy("doc_id").agg(
        F.max("managed").alias("managed"), F.array_sort(F.collect_set(text.blank_to_null(F.col("r.code")))).alias("fund_codes"), F.array_sort(F.collect_set(text.blank_to_null(F.col("r.name")))).alias("fund_names"),
        F.array_sort(F.collect_set(text.blank_to_null(text.name_key(F.col("r.name"))))).alias("canonical_fund_names"),
    )
    by_line = told.groupBy("doc_id").agg(F.max(F.when(F.col("own").isNotNull(), F.struct("score", "section_no", "own"))).alias("line"))
    none = F.array().cast("array<string>")
    d = by_line.join(by_table, "doc_id", "left").withColumn("some", F.coalesce((F.size("fund_codes") > 0) | (F.size("fund_names") > 0), F.lit(False)))
    managed = F.coalesce("managed", F.lit(False))
    return d.select(
        "doc_id", (F.col("line").isNotNull() | managed).alias("manager_column_present"),
        F.when(F.col("some"), False).when(F.col("line").isNotNull(), F.col("line.own")).otherwise(~managed).alias("include_all_funds"),
        *(F.coalesce(c, none).alias(c) for c in ("fund_codes", "fund_names", "canonical_fund_names")),
    )
