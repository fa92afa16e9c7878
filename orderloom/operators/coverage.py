"""How many orders a document should give, and whether what was extracted agrees with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import amounts, dates, labels, ledger, text
from ..functions.text import let
from . import layout

_COLUMN = ["at", "label", "bucket", "net", "counts", "mixed", "rank", "direction", "pending"]


def _columns(tabs: DataFrame) -> DataFrame:
    """Adds `specs`: what each labelled column counts for, and `whole`: is there a column of amounts that counts no units?"""
    t = tabs.withColumn("has_context", F.exists("classes", lambda c: c["context"]))
    generic = lambda c: c["plain"] | c["core"]

    def spec(c: Column, i: Column) -> Column:
        return F.struct(
            i.alias("at"), c["label"].alias("label"), dates.bucket_key(c["label"], i, generic(c)).alias("bucket"), c["net"].alias("net"), (c["any"] | c["plain"]).alias("counts"), c["mixed"].alias("mixed"),
            F.when(F.col("has_context"), labels.coverage_rank(c["label"])).alias("rank"), labels.bare_direction(c["label"]).alias("direction"), c["pending"].alias("pending"),
        )

    t = t.withColumn("specs", F.filter(F.transform("classes", spec), lambda s: (s["label"] != "") & (s["counts"] | s["net"])))
    t = t.withColumn("whole", F.exists("specs", lambda s: s["counts"] & ~s["mixed"]))
    return t.withColumn("note_at", labels.remarks_at(F.col("header")))


def row_buckets(row: Column, own: Column, total: Column, specs: Column, whole: Column, classes: Column, note_at: Column) -> Column:
    """The settlement buckets for which a row holds an amount, sorted: T0, T+1, a date, a day of the month, each with the
    direction unless a net amount of the bucket says it by its sign."""
    note = F.get(row, note_at - 1)
    cell = F.transform(specs, lambda s: F.struct(s.alias("s"), F.get(row, s["at"]).alias("v")))
    paid = F.filter(cell, lambda z: z["v"].rlike(amounts.TOKEN) & z["v"].rlike("[1-9]"))
    noted = lambda z: F.when(z["s"]["pending"], dates.noted_day(note, amounts.document_number(z["v"]), amounts.document_number))
    bucket = lambda z: F.coalesce(F.concat(F.lit("DAY"), F.lpad(noted(z).cast("string"), 2, "0")), z["s"]["bucket"])
    placed = F.transform(paid, lambda z: F.struct(z["s"].alias("s"), bucket(z).alias("b")))
    said = F.transform(F.filter(F.arrays_zip(row.alias("c"), classes.alias("y")), lambda q: q["y"]["context"]), lambda q: labels.bare_direction(q["c"]))
    side = F.get(F.filter(said, lambda d: d.isNotNull()), F.lit(0))

    def keys(x: Column) -> Column:
        p = x["p"]
        best = lambda z: F.array_min(F.transform(F.filter(p, lambda o: (o["b"] == z["b"]) & o["s"]["rank"].isNotNull()), lambda o: o["s"]["rank"]))
        ranked = F.transform(p, lambda z: F.struct(z["s"].alias("s"), z["b"].alias("b"), best(z).alias("best")))
        net = lambda z: F.exists(p, lambda o: (o["b"] == z["b"]) & o["s"]["net"]) & z["best"].isNull()
        kept = F.filter(ranked, lambda z: (z["best"].isNull() | F.coalesce(z["best"] == z["s"]["rank"], F.lit(False))) & (z["s"]["counts"] | z["s"]["net"]))
        support = lambda z: F.exists(p, lambda o: (o["s"]["at"] != z["s"]["at"]) & ~o["s"]["mixed"] & o["s"]["counts"])
        kept = F.filter(kept, lambda z: ~z["s"]["mixed"] | support(z) | ~whole | layout.continuation_shape(layout.kind(own), total, classes))
        way = lambda z: F.when(~net(z), F.coalesce(z["s"]["direction"], x["side"]))
        return F.array_sort(F.array_distinct(F.transform(kept, lambda z: F.concat_ws("_", z["b"], way(z)))))

    return let(F.struct(placed.alias("p"), side.alias("side")), keys)


def row_code(row: Column, at: Column) -> Column:
    """A row's fund code: a cell that looks like one; '' else."""
    v = F.coalesce(F.get(row, at - 1), F.lit(""))
    return F.when(v.rlike(r"^[A-Z0-9]{3,}\z") & ~layout.is_total_text(v), v).otherwise("")


def row_name(row: Column, at: Column) -> Column:
    """A row's fund name: a cell that is neither code nor total; '' else."""
    v = F.coalesce(F.get(row, at - 1), F.lit(""))
    return F.when(v.rlike(r"^[A-Z0-9]{3,}\z") | layout.is_total_text(v), "").otherwise(v)


def identity_at(tabs: DataFrame) -> Column:
    """The places (from 0) of columns that tell funds apart: by their labels, unless six tenths of their cells are amounts
    and the label isn't a strong one; where none is left, the labels before the first column of amounts."""
    cells = lambda j: F.filter(F.transform("body", lambda z: F.get(z["own"], j)), lambda v: v != "")
    money = lambda c: F.size(F.filter(c, lambda v: v.rlike(amounts.TOKEN)))
    words = lambda j: let(cells(j), lambda c: (F.size(c) > 0) & (money(c) < F.size(c) * 0.6))
    named = F.filter(F.transform("classes", lambda c, j: F.when(c["identity"] & (c["strong"] | words(j)), j)), lambda j: j.isNotNull())
    stop = F.array_position(F.transform("classes", lambda c: c["any"] & ~c["plain"]), True).cast("int")
    lead = F.transform(F.slice("classes", F.lit(1), F.when(stop > 0, stop - 1).otherwise(F.size("classes"))), lambda c, j: F.when((c["label"] != "") & ~c["any"] & ~c["units"], j))
    return F.when(F.size(named) > 0, named).otherwise(F.filter(lead, lambda j: j.isNotNull()))


def covered(tabs: DataFrame) -> DataFrame:
    """(doc_id, fund_code, fund_name, fund, bucket), distinct: a fund and a settlement bucket for which a table holds an amount.

    Rows that are data, continuations or subtotals of orders count. A row that lacks code or name takes them from the
    row above, else below, if that one holds amounts of the same buckets and is no total. `fund` is code and name as
    far as known, else the row's cells of identity.
    """
    t = _columns(tabs).withColumn("id_at", identity_at(tabs))
    f = lambda k: F.col(k)
    told = lambda z: row_buckets(z["row"], z["own"], z["total"], f("specs"), f("whole"), f("classes"), f("note_at"))
    counts = lambda z: z["data"] | z["continues"] | (z["kept"] & z["total"])
    t = t.withColumn("rows", F.transform("body", lambda z: F.struct(z["row"].alias("row"), z["total"].alias("total"), counts(z).alias("counts"), told(z).alias("b"), row_code(z["row"], f("code_at")).alias("code"), row_name(z["row"], f("name_at")).alias("name"))))

    def merged(z: Column, i: Column) -> Column:
        near = lambda k: F.when(~k["total"] & (k["b"] == z["b"]) & ((k["code"] != "") | (k["name"] != "")), k)
        above, below = F.when(i > 0, near(F.get("rows", F.greatest(i - 1, F.lit(0))))), near(F.get("rows", i + 1))
        fill = lambda k: F.when(z[k] != "", z[k]).otherwise(F.coalesce(text.blank_to_null(above[k]), text.blank_to_null(below[k]), F.lit("")))
        told_by = F.filter(F.transform("id_at", lambda j: F.get(z["row"], j)), lambda v: v != "")
        lead = F.filter(F.slice(z["row"], 1, 5), lambda v: (v != "") & ~v.rlike(amounts.TOKEN) & ~text.contains_any(F.lower(v), labels.UNIT_LABELS))
        direct = F.when(F.size(told_by) > 0, told_by).otherwise(lead)
        both = F.filter(F.array(fill("code"), fill("name")), lambda v: v != "")
        return F.struct(fill("code").alias("fund_code"), fill("name").alias("fund_name"), F.array_join(F.when(F.size(both) > 0, both).otherwise(direct), "¦").alias("fund"), F.when(z["counts"], z["b"]).alias("b"))

    t = t.withColumn("cells", F.filter(F.transform("rows", merged), lambda m: (F.size(m["b"]) > 0) & (m["fund"] != "")))
    r = t.select("doc_id", layout.posexplode("cells").alias("p", "m")).where("p IS NOT NULL")
    b = r.select("doc_id", "m.fund_code", "m.fund_name", "m.fund", layout.posexplode("m.b").alias("q", "bucket")).where("q IS NOT NULL").drop("q")
    return b.distinct()


def plain_covered(docs: DataFrame) -> DataFrame:
    """As `covered`, for sections without any table row: a flattened schedule's rows, else rows of plain text under
    headings of one direction; docs: doc_id, text.

    A schedule's fund is code and name, a plain row's its code, amount and what stands behind the amount.
    """
    s = layout.sections(docs.select("doc_id", "text")).where(~F.col("section").contains(layout.CELL))
    lines = F.filter(F.transform(F.split("section", "\n"), text.squeeze), lambda x: x != "")

    def of_table(t: Column) -> Column:
        facts = labels.classes(t["header"])
        columns = F.filter(F.transform(facts, lambda c, i: F.struct(i.alias("at"), c["relevant"].alias("on"), dates.bucket_key(c["label"], i, c["plain"] | c["core"]).alias("b"))), lambda c: c["on"])
        paid = lambda r: F.transform(F.filter(columns, lambda c: F.get(r, c["at"]).rlike(r"^[^1-9]*[1-9]")), lambda c: c["b"])
        one = lambda r: F.transform(paid(r), lambda b: F.struct(F.get(r, F.lit(0)).alias("fund_code"), F.get(r, F.lit(2)).alias("fund_name"), F.concat_ws("¦", F.get(r, F.lit(0)), F.get(r, F.lit(2))).alias("fund"), b.alias("bucket")))
        return F.flatten(F.transform(t["body"], one))

    plain = lambda x: F.transform(ledger.plain_rows(x), lambda z: F.struct(z["fund_code"].alias("fund_code"), z["fund_name"].alias("fund_name"), F.concat_ws("¦", z["fund_code"], z["amount"], z["tail"]).alias("fund"), F.concat(F.lit("T0_"), z["order_type"]).alias("bucket")))
    rows = let(lines, lambda x: let(layout.schedule(x), lambda t: F.when(t.isNotNull(), of_table(t)).otherwise(plain(x))))
    r = s.select("doc_id", layout.posexplode(rows).alias("p", "z")).where("p IS NOT NULL")
    return r.select("doc_id", "z.fund_code", "z.fund_name", "z.fund", "z.bucket").distinct()


def counts(tabs: DataFrame, docs: DataFrame | None = None, scope: DataFrame | None = None, restricted: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_cells): how many orders a document should give; docs adds plain text, scope leaves funds out (in_scope)."""
    c = covered(tabs)
    if docs is not None:
        c = c.unionByName(plain_covered(docs))
    if scope is not None:
        c = in_scope(c, scope, restricted)
    return c.select("doc_id", "fund", "bucket").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_cells"))


#: A scope leaves funds out only if the document has a manager column; without one nothing says whose funds they are.
_LIMITS = "target_fund_scope.manager_column_present AND NOT target_fund_scope.include_all_funds"


def scope_members(payloads: DataFrame) -> DataFrame:
    """(doc_id, kind, value): the funds that a document's scope names, for documents whose scope leaves funds out."""
    s = payloads.where(_LIMITS)
    lists = [("code", "fund_codes"), ("name", "fund_names"), ("key", "canonical_fund_names")]

    def marked(kind: str, field: str) -> Column:
        return F.transform(F.coalesce(F.col(f"target_fund_scope.{field}"), F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))

    parts = F.flatten(F.array(*(marked(k, f) for k, f in lists)))
    return s.select(F.col("payload_id").alias("doc_id"), F.explode(parts).alias("m")).select("doc_id", "m.kind", "m.value").distinct()


def limited(payloads: DataFrame) -> DataFrame:
    """The documents whose scope leaves funds out."""
    return payloads.where(_LIMITS).select(F.col("payload_id").alias("doc_id"))


def in_scope(rows: DataFrame, members: DataFrame, restricted: DataFrame | None = None) -> DataFrame:
    """Rows (doc_id, fund_code, fund_name, …) whose fund is named by the scope by code, name or loose key.

    With `restricted` (doc_id), documents that aren't in it keep all rows. The three ways are one semi-join on
    (doc_id, kind, value): each row is exploded into its up to three keys, marked by a row number of its own.
    """
    keyed = rows.withColumn(
        "_keys",
        F.array(
            F.struct(F.lit("code").alias("kind"), F.col("fund_code").alias("value")),
            F.struct(F.lit("name").alias("kind"), F.col("fund_name").alias("value")),
            F.struct(F.lit("key").alias("kind"), text.name_key(F.col("fund_name")).alias("value")),
        ),
    )
    cols = rows.columns
    named = members.groupBy("doc_id").agg(F.collect_set(F.struct("kind", "value")).alias("_m"))
    j = keyed.join(named, "doc_id", "left")
    hit = F.arrays_overlap("_keys", "_m")
    if restricted is not None:
        j = j.join(restricted.withColumn("_r", F.lit(True)), "doc_id", "left")
        return j.where(F.coalesce(hit, F.lit(False)) | F.col("_r").isNull()).select(*cols)
    return j.where(hit).select(*cols)
