"""The whole path: documents to orders in output form, with what is wrong about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import builders, coverage, layout, orders

# Issues that keep a document's orders back.
BLOCKING = [
    "LLM_INVALID_RESPONSE_FORMAT", "FUND_DISCOVERY_EMPTY", "TRANSACTION_SLOT_EMPTY", "TRANSFER_AMOUNT_EMPTY", "SETTLE_CLASS_EMPTY", "FUND_METADATA_INCOMPLETE", "TRANSFER_AMOUNT_MISSING",
    "TRANSFER_AMOUNT_CONFLICT", "SETTLE_CLASS_MISSING", "ORDER_TYPE_MISSING", "T_DAY_MISSING", "BASE_DATE_STAGE_PARTIAL", "T_DAY_STAGE_PARTIAL", "TRANSFER_AMOUNT_STAGE_PARTIAL",
    "SETTLE_CLASS_STAGE_PARTIAL", "ORDER_TYPE_STAGE_PARTIAL",
]


def document_orders(docs: DataFrame) -> DataFrame:
    """Orders of documents (doc_id, text), read off their reports, tables and ledgers, in output form, each once."""
    base = builders.dated(docs)
    found = builders.preferred(builders.buy_sell_orders(base), builders.table_orders(builders.recovered(docs)), builders.section_orders(base))
    return orders.output_form(found).distinct()


def gated(orders_df: DataFrame, issues: DataFrame) -> DataFrame:
    """Orders of documents without a blocking issue; issues: doc_id, issue."""
    blocked = issues.where(F.regexp_extract("issue", r"^[A-Z_]+", 0).isin(BLOCKING)).select("doc_id").distinct()
    return orders_df.join(blocked, "doc_id", "left_anti")


def summary(docs: DataFrame, expected: DataFrame) -> DataFrame:
    """Per document the orders found, the cells covered, and whether the count is the expected one; expected: doc_id, expected_order_count."""
    tabs = layout.tables(layout.raw_rows(layout.sections(docs)))
    n = document_orders(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_orders"))
    j = expected.join(n, "doc_id", "left").join(coverage.counts(tabs), "doc_id", "left")
    return j.select("doc_id", "expected_order_count", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.coalesce("n_cells", F.lit(0)).alias("n_cells"), F.coalesce(F.col("expected_order_count") == F.col("n_cells"), F.lit(False)).alias("agrees"))
