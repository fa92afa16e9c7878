"""Order rows read off recovered tables, section ledgers and buy-and-sell reports, without any model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import amounts, base_date, dates, labels, ledger, text
from . import layout

ORDER = ["fund_code", "fund_name", "settle_class", "order_type", "base_date", "t_day", "transfer_amount"]


def dated(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) with their base date and where it stands (base_date.document_date): no join, no second reading."""
    d = docs.withColumn("_d", base_date.document_date(F.col("text")))
    return d.withColumn("base_date", F.col("_d.date")).withColumn("date_source", F.col("_d.source")).drop("_d")


def recovered(docs: DataFrame) -> DataFrame:
    """The tables of dated documents, as a structured document shows them, with the columns' specs."""
    sects = layout.sections(dated(docs).drop("date_source"))
    sects = sects.withColumn("lossless", layout.web(F.col("section")))
    shown = layout.pruned(layout.tables(layout.raw_rows(sects)))
    cols = ["doc_id", "section_no", "block_no", "base_date", "header", "body"]
    return with_specs(shown.select(*cols).unionByName(layout.schedules(sects).select(*cols)))


def code_at(header: Column, body: Column) -> Column:
    """The place of the fund code: by its label; beside a fund name and net amounts also a manager's code or a column
    'fund' whose first cells look like codes."""
    low = lambda x: F.lower(x)
    named = labels._first(header, lambda x: x.contains("펀드코드") | low(x).contains("fund code") | text.compact(x).isin("수탁코드", "종목코드"))
    fits = lambda n: lambda x, i: _sampled(body, i, n)
    manager = F.array_position(F.transform(header, lambda x, i: (x.contains("운용사코드") | text.compact(x).contains("managercode")) & fits(10)(x, i)), True).cast("int")
    fund = F.array_position(F.transform(header, lambda x, i: text.compact(x).isin("펀드", "fund") & fits(5)(x, i)), True).cast("int")
    allowed = F.exists(header, lambda x: x.contains("펀드명") | low(x).contains("fund name")) & F.exists(header, lambda x: labels.is_net(x))
    return F.coalesce(named, F.when(allowed, F.coalesce(F.when(manager > 0, manager), F.when(fund > 0, fund))))


def _sampled(body: Column, i: Column, n: int) -> Column:
    """Do the first n filled cells of a column all look like codes? False for none."""
    own = F.slice(F.filter(F.transform(body, lambda r: text.squeeze(F.get(r, i))), lambda c: F.coalesce(c, F.lit("")) != ""), 1, n)
    return (F.size(own) > 0) & F.forall(own, lambda c: c.rlike(r"^[A-Z0-9]{3,}\z"))


def name_at(header: Column, body: Column) -> Column:
    """The place of the fund name: by its label, or a column 'fund' whose first cells aren't all codes."""
    named = labels._first(header, lambda x: x.contains("펀드명") | F.lower(x).contains("fund name"))
    filled = lambda i: F.exists(body, lambda r: F.coalesce(F.get(r, i), F.lit("")) != "")
    fund = F.array_position(F.transform(header, lambda x, i: text.compact(x).isin("펀드", "fund") & filled(i) & ~_sampled(body, i, 5)), True).cast("int")
    return F.coalesce(named, F.when(fund > 0, fund))


_SPEC = ["at", "label", "direction", "net", "rank", "future", "plus", "signed"]


def with_specs(tabs: DataFrame) -> DataFrame:
    """Adds `specs`: the columns that hold orders, each with day, direction and how its sign is read; tabs: header, body, base_date.

    Where rows give the direction (`context`), columns have a rank, and only those of the lowest rank of a day count;
    else a day that has a net column drops its other columns. The day is n of T+n; other future settlements are
    numbered by their first appearance from left to right; what names the base date or no date is day 0. `noise`
    says that some label has leading parts that mean nothing: such a table is no authority.
    """
    t = tabs.withColumn("names", F.transform("header", labels.semantic))
    t = t.withColumn("noise", F.exists(F.arrays_zip("header", "names"), lambda z: text.squeeze(z["header"]) != z["names"]))
    t = t.withColumn("context", F.transform("names", labels.is_context_header))
    has = F.exists("context", lambda x: x)
    base = F.coalesce(F.col("base_date"), F.lit(""))
    plus = r"t\s*\+\s*(\d+)"

    def spec(x: Column, i: Column) -> Column:
        return F.struct(
            i.alias("at"), x.alias("label"), F.when(~labels.is_metadata(x), labels.direction(x)).alias("direction"), labels.is_net(x).alias("net"),
            F.when(has, labels.order_rank(x)).alias("rank"), dates.future_key(x, base).alias("future"), F.regexp_extract(F.lower(x), plus, 1).try_cast("int").alias("plus"),
        )

    t = t.withColumn("specs", F.transform("names", spec))
    signed = lambda s: s["rank"].isNull() & (s["net"] | (s["direction"].isNull() & s["future"].isNotNull()))
    used = lambda s: (s["label"] != "") & (s["direction"].isNotNull() | s["rank"].isNotNull() | s["net"] | s["future"].isNotNull())
    fields = _SPEC[:-1]
    t = t.withColumn("specs", F.transform(F.filter("specs", used), lambda s: F.struct(*(s[k].alias(k) for k in fields), signed(s).alias("signed"))))
    t = t.withColumn("_f", F.array_distinct(F.transform(F.filter("specs", lambda s: s["plus"].isNull() & s["future"].isNotNull()), lambda s: s["future"])))
    day = lambda s: F.coalesce(s["plus"], F.when(s["future"].isNull(), F.lit(0)).otherwise(F.array_position("_f", s["future"]).cast("int")))
    t = t.withColumn("specs", F.transform("specs", lambda s: F.struct(*(s[k].alias(k) for k in _SPEC), day(s).alias("t_day"))))
    of_day = lambda s, test: F.filter("specs", lambda o: (o["t_day"] == s["t_day"]) & test(o))
    best = lambda s: F.array_min(F.transform(of_day(s, lambda o: o["rank"].isNotNull()), lambda o: o["rank"]))
    t = t.withColumn("specs", F.transform("specs", lambda s: F.struct(*(s[k].alias(k) for k in [*_SPEC, "t_day"]), best(s).alias("best"), F.exists("specs", lambda o: (o["t_day"] == s["t_day"]) & o["signed"]).alias("netted"))))
    stays = lambda s: F.coalesce(s["rank"] == s["best"], F.lit(False)) | (s["best"].isNull() & (s["signed"] | ~s["netted"]))

    def final(s: Column) -> Column:
        total = text.bare(F.lower(s["label"])).contains("펀드계")
        ranked = s["best"].isNotNull()
        return F.struct(
            s["at"].alias("at"), s["label"].alias("label"), s["t_day"].alias("t_day"), F.when(~ranked & ~s["signed"], s["direction"]).alias("direction"),
            F.when(ranked, total).otherwise(s["signed"]).alias("signed"), (ranked & ~total).alias("by_row"), labels.is_pending_request(s["label"]).alias("pending"),
        )

    t = t.withColumn("specs", F.transform(F.filter("specs", stays), final)).drop("_f")
    t = t.withColumn("code_at", code_at(F.col("names"), F.col("body"))).withColumn("name_at", name_at(F.col("names"), F.col("body")))
    return t.withColumn("note_at", labels._first(F.col("names"), lambda x: text.compact(x).rlike("비고|remark|note")))


def context_direction(row: Column, context: Column) -> Column:
    """The direction that a row's context cells name: the first cell that names one."""
    named = F.transform(F.filter(F.arrays_zip(row.alias("cell"), context.alias("is")), lambda z: z["is"]), lambda z: F.when(~labels.is_metadata(z["cell"]), labels.direction(z["cell"])))
    return F.get(F.filter(named, lambda x: x.isNotNull()), F.lit(0))


def is_summary(value: Column) -> Column:
    """A cell that is a total and nothing else, spaces and marks aside, or counts funds."""
    t = F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", "")
    return t.isin("합계", "총계", "소계", "subtotal", "grandtotal", "total") | layout.is_total_text(value)


def cells_of(tabs: DataFrame) -> DataFrame:
    """One row per amount cell of an order column: tables unpivoted, zeros and totals left out; tabs as `recovered` gives them.

    Everything about a cell, its table's facts too, is put into the struct that is exploded. A filter on a column from
    below an explosion would be pushed down through the table's whole derivation and compute all of it again.
    """
    code = text.blank_to_null(text.squeeze(F.get("row", F.col("code_at") - 1)))
    name = text.blank_to_null(text.squeeze(F.get("row", F.col("name_at") - 1)))
    t = tabs.select("doc_id", "section_no", "block_no", "base_date", "noise", "context", "specs", "code_at", "name_at", "note_at", layout.posexplode("body").alias("p", "row"))
    r = t.select(
        "doc_id", "section_no", "block_no", (F.col("p") + 1).alias("row_no"), "row", "specs",
        F.struct(
            code.alias("fund_code"), name.alias("fund_name"), F.col("code_at").isNotNull().alias("has_code"), "noise", "base_date",
            context_direction(F.col("row"), F.col("context")).alias("row_direction"), F.get("row", F.col("note_at") - 1).alias("note"),
        ).alias("f"),
    )
    fact = lambda k: F.col("f")[k]
    own = fact("fund_code").isNotNull() | (~fact("has_code") & fact("fund_name").isNotNull() & ~fact("fund_name").isin("/", "-"))
    total = is_summary(F.coalesce(fact("fund_code"), F.lit(""))) | is_summary(F.coalesce(fact("fund_name"), F.lit("")))
    # numbers are read, and zeros and totals dropped, inside the array: only amounts are exploded, and each is read once
    cell = F.transform(F.when(own & ~total, F.col("specs")), lambda s: F.struct(s.alias("s"), amounts.token(F.get("row", s["at"])).alias("cell")))
    paid = F.transform(F.filter(cell, lambda z: z["cell"].rlike("[1-9]")), lambda z: F.struct(z["s"].alias("s"), z["cell"].alias("cell"), amounts.token_number(z["cell"]).alias("amount"), F.col("f").alias("f")))
    z = r.select("doc_id", "section_no", "block_no", "row_no", layout.posexplode(paid).alias("q", "z")).where("z.amount <> 0").select("doc_id", "section_no", "block_no", "row_no", "z")
    z = z.select("doc_id", "section_no", "block_no", "row_no", (F.col("z.s.at") + 1).alias("col_no"), "z.cell", "z.amount", "z.f.*", "z.s.*").drop("at")
    noted = dates.noted_day(F.col("note"), F.col("amount"), amounts.document_number) - F.substring("base_date", 9, 2).try_cast("int")
    z = z.withColumn("t_day", F.when(F.col("pending"), F.when(noted > 0, noted)).otherwise(F.col("t_day"))).drop("note")
    sign = F.when(F.col("amount") < 0, "RED").otherwise("SUB")
    by_row = F.when(F.col("cell").rlike("^[+-]"), sign).otherwise(F.col("row_direction"))
    return z.withColumn("order_type", F.when(F.col("by_row"), by_row).when(F.col("signed"), sign).otherwise(F.col("direction")))


def orders_of(cells: DataFrame) -> DataFrame:
    """Amount cells as orders, those that have a day, a direction and a base date."""
    value = F.when(F.col("signed"), F.col("amount")).when(F.col("order_type") == "RED", -F.abs("amount")).otherwise(F.abs("amount")).cast(amounts.DECIMAL)
    o = cells.where("t_day IS NOT NULL AND order_type IS NOT NULL AND base_date IS NOT NULL")
    return o.select(
        "doc_id", "section_no", "block_no", "row_no", "col_no", F.coalesce("fund_code", F.lit("")).alias("fund_code"), F.coalesce("fund_name", F.lit("-")).alias("fund_name"),
        F.when(F.col("t_day") == 0, "CONFIRMED").otherwise("PENDING").alias("settle_class"), "order_type", "base_date", "t_day",
        amounts.render(amounts.snap(value)).alias("transfer_amount"), "label",
    )


def table_orders(tabs: DataFrame) -> DataFrame:
    """Tables with a fund code to orders, one per amount cell; a table whose labels carry noise gives none."""
    return orders_of(cells_of(tabs).where("has_code AND NOT noise")).drop("label")


def row_local_orders(tabs: DataFrame) -> DataFrame:
    """Orders of tables that name funds but have no codes, with the number of the row among the document's such rows.

    Only rows that give an order are numbered.
    """
    o = orders_of(cells_of(tabs).where("NOT has_code"))
    w = W.partitionBy("doc_id").orderBy("section_no", "block_no", "row_no")
    return o.withColumn("fund_row", F.dense_rank().over(w))


def section_orders(docs: DataFrame) -> DataFrame:
    """The orders of section ledgers (doc_id, text, base_date): documents without a ledger's header aren't cut at all."""
    low = F.lower("text")
    d = docs.where(low.contains(ledger.HEADER)).select("doc_id", "base_date", F.transform(F.split("text", "\n"), text.squeeze).alias("lines"))
    r = d.select("doc_id", F.col("base_date").alias("_b"), F.explode(ledger.rows(F.col("lines"))).alias("z")).select("doc_id", "_b", "z.*")
    r = r.withColumn("base_date", F.coalesce("base_date", "_b")).where("amount <> 0 AND base_date IS NOT NULL").where(~is_summary(F.col("fund_name")))
    return r.select(
        "doc_id", "line_no", "fund_code", "fund_name", F.lit("CONFIRMED").alias("settle_class"), "order_type", "base_date", F.lit(0).alias("t_day"),
        amounts.render(F.when(F.col("order_type") == "RED", -F.col("amount")).otherwise(F.col("amount"))).alias("transfer_amount"),
    )


def buy_sell_orders(docs: DataFrame) -> DataFrame:
    """A BUY & SELL report: two amounts a row, a blank date takes the one above; total rows are left out."""
    sects = layout.sections(docs.where(F.upper("text").contains("BUY & SELL REPORT")).select("doc_id", "text"))
    fits = lambda r: (F.size(r) >= 9) & F.get(r, F.lit(3)).rlike(r"^\d{4,}\z") & ~layout.is_total(r)
    rows = layout.raw_rows(sects).select("doc_id", "section_no", "block_no", F.filter("rows", fits).alias("rows"))
    rows = rows.withColumn("days", layout.fill_runs(F.transform("rows", lambda r: F.coalesce(dates.normalize(F.get(r, F.lit(0))), F.lit("")))))
    rows = rows.select("doc_id", "section_no", "block_no", layout.posexplode(F.arrays_zip(F.col("rows").alias("r"), F.col("days").alias("day"))).alias("row_no", "z")).where("row_no IS NOT NULL")
    cell = lambda k: F.get("z.r", F.lit(k))
    legs = F.array(F.struct(F.lit("SUB").alias("order_type"), amounts.parse(cell(6)).alias("v")), F.struct(F.lit("RED").alias("order_type"), (-amounts.parse(cell(8))).alias("v")))
    o = rows.select("doc_id", "row_no", cell(3).alias("fund_code"), text.squeeze(cell(4)).alias("fund_name"), text.blank_to_null(F.col("z.day")).alias("base_date"), F.explode(legs).alias("x"))
    return o.where("x.v <> 0").select(
        "doc_id", "row_no", "fund_code", "fund_name", F.lit("CONFIRMED").alias("settle_class"), "x.order_type", "base_date", F.lit(0).alias("t_day"), amounts.render(F.col("x.v")).alias("transfer_amount")
    )


def preferred(report: DataFrame, tables: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per document one of its readings: a report's rows where it is one; else the ledger's if they are more than the
    tables', or as many with the same funds, days and amounts and another direction; else the tables'.

    One union and one aggregation by document: a document's orders are bounded by its text.
    """
    pair = F.struct(*ORDER)
    core = ["fund_code", "fund_name", "settle_class", "base_date", "t_day"]
    n = None
    for k, s in enumerate((report, tables, ledger)):
        tagged = s.select("doc_id", *ORDER, F.lit(k).alias("_k"))
        n = tagged if n is None else n.unionByName(tagged)
    part = lambda k, x: F.array_sort(F.collect_list(F.when(F.col("_k") == k, x)))
    bare = F.struct(*core, F.regexp_replace("transfer_amount", "^-", "").alias("a"))
    g = n.groupBy("doc_id").agg(*(part(k, pair).alias(f"s{k}") for k in range(3)), part(1, bare).alias("c1"), part(2, bare).alias("c2"))
    more = F.size("s2") > F.size("s1")
    turned = (F.col("s1") != F.col("s2")) & (F.col("c1") == F.col("c2"))
    chosen = F.when(F.size("s0") > 0, F.col("s0")).when(more | ((F.size("s2") > 0) & turned), F.col("s2")).otherwise(F.col("s1"))
    return g.select("doc_id", F.explode(chosen).alias("o")).select("doc_id", "o.*")


def seeds(tabs: DataFrame) -> DataFrame:
    """The funds of a document's tables that have an amount: (doc_id, fund_code, fund_name), each once."""
    return cells_of(tabs).where("fund_code IS NOT NULL AND fund_name IS NOT NULL").select("doc_id", "fund_code", "fund_name").distinct()
