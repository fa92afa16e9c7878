"""Payloads of documents: repeated runs, orders inside them, and their merger over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import orders

def latest(payloads: DataFrame) -> DataFrame:
    """The last run of every payload; a run repeated in full counts once."""
    cols = payloads.columns
    return payloads.groupBy("payload_id").agg(F.max_by(F.struct(*[c for c in cols if c != "payload_id"]), F.struct("run_no", "finished_at")).alias("r")).select("payload_id", "r.*").select(*cols)


def exploded(payloads: DataFrame) -> DataFrame:
    """One row per order of a payload; `ord` orders them over all payloads, runs and places."""
    x = payloads.select("payload_id", "run_no", "file_name", "source_path", "model_name", F.col("base_date").alias("document_base_date"), "issues", F.posexplode("orders").alias("pos", "o"))
    key = F.format_string("%012d|%06d|%06d", F.col("payload_id"), F.col("run_no"), F.col("pos") + 1)
    return x.select("payload_id", "file_name", "source_path", "model_name", "document_base_date", "issues", key.alias("ord"), "o.*")


def dedupe_within(rows: DataFrame) -> DataFrame:
    return orders.dedupe_output(rows, ["payload_id"])


def merged(payloads: DataFrame) -> DataFrame:
    """Orders of all documents, equal ones once; the provenance is that of the first document in order."""
    rows = exploded(payloads).withColumn("first_payload", F.col("payload_id")).withColumn("first_file", F.col("file_name")).drop("payload_id")
    return orders.dedupe_output(rows, [])


def summary(payloads: DataFrame) -> DataFrame:
    """One row about all documents together; documents are in order of their id.

    Lists of all documents would grow with the data, so names are counted and the first is given; issue codes, reasons
    and models are few and listed in order of first appearance.
    """
    n = F.size("orders")
    order = F.struct("payload_id", "run_no")
    of = lambda c, first: payloads.select(F.explode(c).alias("u"), order.alias("k")).groupBy("u").agg(F.min("k").alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "u"))), lambda x: x["u"]), first[1]).alias(first[0]))
    reasons = F.when(F.trim(F.coalesce("reason", F.lit(""))) != "", F.array(F.trim("reason"))).otherwise(F.array().cast("array<string>"))
    got = payloads.agg(
        F.count(F.lit(1)).alias("file_count"),
        F.count_distinct("file_name").alias("n_file_names"),
        F.min_by("file_name", order).alias("first_file"),
        F.when(F.min("model_name") == F.max("model_name"), F.min("model_name")).otherwise("").alias("model_name"),
        F.when(F.sum(n) > 0, "COMPLETED").when(F.every(F.col("status") == "SKIPPED"), "SKIPPED").otherwise("FAILED").alias("status"),
        F.min_by("base_date", F.when(F.col("base_date").isNotNull(), order)).alias("first_base_date"),
        F.sum(n).alias("n_orders"),
    )
    # all three are one row
    return got.join(F.broadcast(of(F.col("issues"), ("issues", "|"))), F.lit(True)).join(F.broadcast(of(reasons, ("reasons", "; "))), F.lit(True))


def first_dates(payloads: DataFrame) -> DataFrame:
    """(payload_id, base_date): of each payload the first date that an order has, in the order of its orders."""
    own = F.filter("orders", lambda o: F.coalesce(o["base_date"], F.lit("")) != "")
    return payloads.select("payload_id", F.get(own, F.lit(0))["base_date"].alias("base_date"))


def flat(payloads: DataFrame) -> DataFrame:
    """Twelve text columns per order, as a CSV sink writes them."""
    x = exploded(payloads)
    return x.select(
        "file_name", "source_path", "model_name", F.coalesce("document_base_date", F.lit("")).alias("document_base_date"), F.array_join("issues", "|").alias("issues"),
        *(F.coalesce(c, F.lit("")).alias(c) for c in orders.OUTPUT),
    )
