"""Joins: documents' facts to their items, hints that must be unique, siblings, neighbours, parties by tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Texts of documents that say they hold no order.
NO_ORDER_MARKERS = [
    "지시없음", "지시 없음", "거래없음", "거래 없음", "설정해지 지시없음", "자금설정해지 지시없음", "no instruction", "no instructions", "no order", "no orders",
    "no transaction", "no transactions",
]
#: An example of a map of parties: name, tokens of the text (all must occur), tokens of the file name (one must).
PARTIES = [
    ("account-summary", ["특별계정", "자금", "집계"], []),
    ("transfer-order", ["order of fund transfers"], []),
    ("instruction", [], ["운용지시", "instr"]),
    ("fund-order", [], ["order", "fund"]),
    ("settlement", [], ["설정해지"]),
]


def fan_out(items: DataFrame, dated: DataFrame) -> DataFrame:
    """Items with their document's date where they have none; `taken` says so. One date a document: an equi-join."""
    j = items.join(dated, "doc_id", "left")
    return j.select("doc_id", "ord", F.coalesce("base_date", "document_date").alias("base_date"), (F.col("base_date").isNull() & F.col("document_date").isNotNull()).alias("taken"))


def match_unique(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of left with the right's value where exactly one row of right has their key."""
    one = right.groupBy(*keys).agg(F.min(value).alias(value), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    return left.join(one, keys)


def siblings(items: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(doc_id, ord, field, has): for each missing field of an item, whether another item of the same key has it.

    The key's facts are aggregated first (partial aggregation) and joined back, so a hot key isn't sorted in one task.
    """
    facts = items.groupBy(*keys).agg(*(F.max(F.col(f).isNotNull()).alias(f"_{f}") for f in fields))
    facts = facts.select(*(F.col(k).alias(f"k_{k}") for k in keys), *(f"_{f}" for f in fields))
    j = items.join(facts, [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys])
    missing = F.filter(F.array(*(F.when(F.col(f).isNull(), F.struct(F.lit(f).alias("field"), F.col(f"_{f}").alias("has"))) for f in fields)), lambda x: x.isNotNull())
    return j.select("doc_id", "ord", F.explode(missing).alias("x")).select("doc_id", "ord", "x.field", "x.has")


def neighbour(rows: DataFrame, column: str) -> DataFrame:
    """A blank cell takes the value of the row above, else of the row below, in its block."""
    w = W.partitionBy("doc_id", "section_no", "block_no").orderBy("row_no")
    c = F.col(column)
    return rows.select("doc_id", "section_no", "block_no", "row_no", F.coalesce(c, F.lag(c).over(w), F.lead(c).over(w)).alias(column), c.isNull().alias("borrowed"))


def resolve_party(payloads: DataFrame, parties: list[tuple[str, list[str], list[str]]]) -> DataFrame:
    """(payload_id, party, by): the first party of the map all of whose text tokens occur, else the first one of
    whose file-name tokens occurs; null if none.

    The map is configuration, bounded by hand, and becomes one expression: no join at all. Latin tokens of a file
    name must be whole words, Hangul ones may be parts.
    """
    text = F.lower(F.coalesce("raw_text", F.lit("")))
    name = F.lower(F.coalesce("file_name", F.lit("")))
    by_text, by_name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for party, tokens, names in reversed(parties):
        if tokens:
            hit = F.lit(True)
            for t in tokens:
                hit = hit & F.contains(text, F.lit(t))
            by_text = F.when(hit, party).otherwise(by_text)
        if names:
            hit = F.lit(False)
            for t in names:
                hit = hit | (name.rlike(rf"(?<![a-z0-9]){t}(?![a-z0-9])") if t.isascii() else F.contains(name, F.lit(t)))
            by_name = F.when(hit, party).otherwise(by_name)
    return payloads.select("payload_id", F.coalesce(by_text, by_name).alias("party"), F.when(by_text.isNotNull(), "text").when(by_name.isNotNull(), "name").alias("by"))
