"""From evidence to orders: candidates, their aggregation, de-duplication, and the output form.

Every grouping uses aggregates that combine before the shuffle (sums, min_by on an ordinal), so a fund or a document
that holds a large share of the rows costs no more than its number of distinct groups. First-seen order is an
explicit ordinal column `ord`; nothing depends on the order of rows in a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import amounts, dates, labels, text

FUND = ["id_code", "id_name"]
BUCKET = ["doc_id", *FUND, "settle_class", "base_date", "t_day"]


def first(value: Column, order: Column | str = "ord") -> Column:
    """The value of the row of smallest ordinal; null values are skipped."""
    return F.min_by(value, F.when(value.isNotNull(), F.col(order) if isinstance(order, str) else order))


def with_identity(df: DataFrame) -> DataFrame:
    k = text.identity(F.col("fund_code"), F.col("fund_name"))
    return df.withColumn("_k", k).withColumn("id_code", F.col("_k.code")).withColumn("id_name", F.col("_k.name")).drop("_k")


def candidates(items: DataFrame) -> DataFrame:
    """Stage items (doc_id, ord, fund_code, fund_name, base_date, t_day, evidence_label, transfer_amount, settle_class,
    order_type) made candidates. `drop_reason` says why a row is none; it is null for candidates."""
    label = F.col("evidence_label")
    out = (
        items.withColumn("fund_code", F.coalesce(text.squeeze(F.col("fund_code")), F.lit("")))
        .withColumn("fund_name", F.coalesce(text.squeeze(F.col("fund_name")), F.lit("")))
        .withColumn("evidence_label", text.squeeze(F.coalesce("evidence_label", F.lit(""))))
        .withColumn("base_date", dates.normalize(F.col("base_date")))
        .withColumn("canonical", amounts.canonical(F.col("transfer_amount")))
        .withColumn("settle_class", labels.settle_class(F.col("settle_class"), F.col("t_day"), label))
        .withColumn("order_type", labels.order_type(F.col("order_type"), F.col("transfer_amount"), label))
        .withColumn("evidence_kind", labels.evidence_kind(label))
        .withColumn("signed", amounts.signed(F.col("transfer_amount"), F.col("order_type")))
    )
    reason = (
        F.when((F.col("fund_code") == "") | (F.col("fund_name") == ""), "FUND_METADATA_INCOMPLETE")
        .when(labels.is_non_amount(label), "NON_AMOUNT_EVIDENCE_DROPPED")
        .when(F.col("canonical").isNull(), "TRANSFER_AMOUNT_MISSING")
        .when(F.col("canonical") == "0", "ZERO_AMOUNT")
        .when(F.col("settle_class").isNull(), "SETTLE_CLASS_MISSING")
        .when(F.col("order_type").isNull(), "ORDER_TYPE_MISSING")
    )
    k = F.col("fund_code")
    return out.withColumn("drop_reason", reason).withColumns({"id_code": k, "id_name": F.when(k == "", F.col("fund_name")).otherwise("")})


def live(df: DataFrame) -> DataFrame:
    """The rows of `candidates` that are candidates.

    The test goes through an exploded array: a plain filter would be pushed below the expressions that it tests and
    compute all of them twice.
    """
    kept = df.withColumn("_live", F.explode_outer(F.when(F.col("drop_reason").isNull(), F.array(F.lit(True)))))
    return kept.where("_live").drop("_live", "drop_reason")


def dedupe_evidence(df: DataFrame) -> DataFrame:
    """One candidate per piece of evidence; amounts that differ in their printed scale alone are the same."""
    keys = [*BUCKET, "order_type", "canonical", "evidence_label", "evidence_kind"]
    rest = [c for c in df.columns if c not in keys]
    got = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), "ord").alias("r"))
    return got.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def aggregate(df: DataFrame) -> DataFrame:
    """Candidates to orders.

    Per fund, settlement and day: net evidence decides where there is any (its one value; of several the one equal
    to the explicit sum, else the first, with a conflict noted); without net evidence both directions stay apart;
    a single direction is summed. Zero results vanish; the direction follows the sign of the result.
    """
    d = dedupe_evidence(df)
    net = F.col("evidence_kind") == "execution"

    def part(own: Column) -> list[Column]:
        of = lambda x: F.when(own, x)
        return [F.sum(of(F.col("signed"))), F.min_by(F.struct("fund_code", "fund_name"), of(F.col("ord"))), F.min(of(F.col("ord")))]

    parts = {"s": ~net & (F.col("order_type") == "SUB"), "r": ~net & (F.col("order_type") == "RED"), "o": ~net, "g": F.lit(True)}
    facts = [c.alias(f"{k}_{n}") for k, own in parts.items() for n, c in zip(("sum", "head", "ord"), part(own))]
    # a bucket's different net amounts are few: one a column of the document
    g = d.groupBy(*BUCKET).agg(F.collect_set(F.when(net, F.col("signed"))).alias("nets"), F.min_by("signed", F.when(net, F.col("ord"))).alias("net_first"), *facts)
    some = F.size("nets") > 0
    agrees = F.array_contains("nets", F.col("o_sum").cast(amounts.DECIMAL))
    chosen = F.when(~some, F.col("o_sum")).when(F.size("nets") == 1, F.get("nets", F.lit(0))).when(agrees, F.col("o_sum")).otherwise(F.col("net_first")).cast(amounts.DECIMAL)
    one = lambda k, amount, conflict: F.struct(F.col(f"{k}_head").alias("head"), amount.cast(amounts.DECIMAL).alias("amount"), conflict.alias("conflict"), F.col(f"{k}_ord").alias("ord"))
    apart = ~some & F.col("s_ord").isNotNull() & F.col("r_ord").isNotNull()
    both = F.array(one("s", F.col("s_sum"), F.lit(False)), one("r", F.col("r_sum"), F.lit(False)))
    whole = F.array(one("g", chosen, (F.size("nets") > 1) & ~F.coalesce(agrees, F.lit(False))))
    x = g.select(*BUCKET, F.explode(F.when(apart, both).otherwise(whole)).alias("x")).where("x.amount <> 0")
    amount = F.col("x.amount")
    return x.select(
        "doc_id", F.col("x.head.fund_code").alias("fund_code"), text.join_split_name(F.col("x.head.fund_name")).alias("fund_name"), "settle_class",
        F.when(amount < 0, "RED").otherwise("SUB").alias("order_type"), "base_date", "t_day", amounts.render(amounts.snap(amount)).alias("transfer_amount"), F.col("x.conflict").alias("conflict"), F.col("x.ord").alias("ord"),
    )


def dedupe_orders(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per signature, the one of smallest ordinal."""
    rest = [c for c in df.columns if c not in keys]
    got = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), "ord").alias("r"))
    return got.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def direction_hints(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose observations all name one direction, with it."""
    return df.where(F.col("order_type").isNotNull()).groupBy(*keys).agg(F.min("order_type").alias("order_type"), F.max("order_type").alias("_m")).where("order_type = _m").drop("_m")


def only_pending(df: DataFrame) -> DataFrame:
    """Pending rows go; the rest is relabelled pending."""
    return df.where("settle_class = 'CONFIRMED'").withColumn("settle_class", F.lit("PENDING"))


def output_form(df: DataFrame) -> DataFrame:
    """Orders in output codes: seven strings."""
    return df.select(
        *[c for c in df.columns if c not in ("fund_code", "fund_name", "settle_class", "order_type", "base_date", "t_day", "transfer_amount")],
        "fund_code",
        "fund_name",
        labels.output_settle(F.col("settle_class")).alias("settle_class"),
        labels.output_type(F.col("order_type")).alias("order_type"),
        "base_date",
        labels.output_t_day(F.col("settle_class"), F.col("t_day")).alias("t_day"),
        amounts.output(F.col("transfer_amount"), F.col("order_type")).alias("transfer_amount"),
    )


OUTPUT = ["fund_code", "fund_name", "settle_class", "order_type", "base_date", "t_day", "transfer_amount"]


def output_identity(df: DataFrame) -> DataFrame:
    """Adds i_...: the seven trimmed strings by which output orders are compared; amounts in canonical form."""
    for c in OUTPUT:
        v = F.coalesce(F.trim(F.col(c)), F.lit(""))
        df = df.withColumn(f"i_{c}", F.coalesce(amounts.canonical(v), v) if c == "transfer_amount" else v)
    return df


def dedupe_output(df: DataFrame, within: list[str], order: str = "ord") -> DataFrame:
    """One output order per identity within `within`: the first one, with the amount text that it printed."""
    d = output_identity(df)
    keys = [*within, *(f"i_{c}" for c in OUTPUT)]
    rest = [c for c in df.columns if c not in within]
    got = d.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r"), F.count(F.lit(1)).alias("copies"))
    return got.select(*within, *(F.col(f"r.{c}").alias(c) for c in rest), "copies")


def sort_position(df: DataFrame, within: list[str]) -> DataFrame:
    """Adds `position`: settlement 2 before 1, type 3 before 1, numeric codes before others, then day and amount.

    The window is one document; a document's orders are bounded by its size.
    """
    from pyspark.sql import Window as W

    code = F.trim(F.col("fund_code"))
    numeric = code.rlike(r"^\d+\z")
    keys = [
        F.when(F.col("settle_class") == "2", 0).otherwise(1),
        F.when(F.col("order_type") == "3", 0).otherwise(1),
        F.when(numeric, 0).otherwise(1),
        F.when(numeric, code.try_cast("bigint")),
        code,
        F.coalesce("t_day", F.lit("")),
        amounts.parse(F.col("transfer_amount")),
        F.col("ord"),
    ]
    return df.withColumn("position", F.row_number().over(W.partitionBy(*within).orderBy(*keys)))
