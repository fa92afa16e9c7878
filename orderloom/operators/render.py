"""Documents as structured text, what it lost against the source, and the text that a model is given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import layout

# The mark between structured text and the raw text behind it, and the fences of plain text.
BACKUP = "\n\nRaw text backup:\n```text\n"
FENCE, FENCE_END = "```text\n", "\n```"
# The classes of lost tokens, in the order in which they are reported.
LOSSES = [("labels", "html_label_missing"), ("rows", "html_table_shape_collapsed"), ("inherited", "html_inherited_context_missing"), ("kinds", "html_row_kind_missing"), ("codes", "html_fund_code_missing")]
UNVERIFIED = "html_markdown_unverified"


def fenced(block: Column) -> Column:
    """Plain lines as a fenced block; blank ones at the ends go, an empty block vanishes."""
    t = F.regexp_replace(block, r"^\s+|\s+\z", "")
    return F.when(t != "", F.concat(F.lit(FENCE), t, F.lit(FENCE_END)))


def document_markdown(docs: DataFrame) -> DataFrame:
    """(doc_id, markdown) of documents (doc_id, text): sections under headings, tables as tables, the rest fenced.

    A section is cut into runs of table lines and runs of others by one pattern; each run keeps its number. Tables are
    recovered with them and joined back by document, section and table, so text is read once for both.
    """
    sects = layout.sections(docs.select("doc_id", "text"))
    body = F.regexp_replace("section", r"^[^\n]*\n?", "")
    runs = F.regexp_extract_all(body, F.lit(r"(?md)(?:^.* \| .*$\n?)++|(?:^(?!.* \| ).*$\n?)++"), F.lit(0))
    r = sects.select("doc_id", "section_no", F.get(F.split("section", "\n"), F.lit(0)).alias("top"), layout.posexplode(F.filter(runs, lambda x: x.rlike(r"\S"))).alias("run_no", "run"))
    r = r.withColumn("piped", F.coalesce(F.col("run").contains(layout.CELL), F.lit(False)))
    rows = r.select("doc_id", F.col("section_no"), F.coalesce(F.col("run_no"), F.lit(-1)).alias("block_no"), "top", "run", "piped", F.when(F.col("piped"), F.transform(F.split(F.regexp_replace("run", r"\n\z", ""), "\n"), layout.cells)).otherwise(F.array(F.array(F.lit("")))).alias("rows"))
    t = layout.pruned(layout.tables(rows))
    lines = F.split(F.regexp_replace("run", r"\n\z", ""), "\n")
    before = fenced(F.array_join(F.slice(lines, F.lit(1), F.coalesce(F.col("header_at") - 1, F.lit(0))), "\n"))
    table = layout.render_table(F.concat(F.array(F.transform("header", lambda h, j: F.when(h == "", F.concat(F.lit("col_"), (j + 1).cast("string"))).otherwise(h))), F.col("body")))
    is_table = F.col("piped") & F.col("header_at").isNotNull() & F.exists("header", lambda h: h != "") & (F.size("body") > 0)
    part = F.when(is_table, F.concat_ws("\n\n", before, table)).otherwise(fenced(F.col("run")))
    p = t.select("doc_id", "section_no", "block_no", "top", F.array(F.struct(part.alias("x"))).alias("x")).select("doc_id", "section_no", "block_no", "top", layout.posexplode("x").alias("q", "x")).drop("q")
    s = p.groupBy("doc_id", "section_no").agg(F.min("top").alias("top"), F.array_sort(F.collect_list(F.when(F.col("x.x").isNotNull(), F.struct("block_no", F.col("x.x").alias("part"))))).alias("parts"))
    whole = F.concat_ws("\n\n", layout.heading(F.col("top"), F.col("section_no")), F.array_join(F.transform("parts", lambda q: q["part"]), "\n\n"))
    d = s.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section_no", F.regexp_replace(whole, r"\s+\z", "").alias("w")))).alias("w"))
    return d.select("doc_id", F.array_join(F.transform("w", lambda q: q["w"]), layout.MARKDOWN_DELIMITER).alias("markdown"))


def loss_reasons(markdown: Column, audit: Column, is_html: Column) -> Column:
    """Which classes of an HTML source's tokens its structured text lacks; without an audit an HTML source is unverified.

    audit: a struct of arrays (labels, rows, inherited, kinds, codes); null if there is none.
    """
    lost = lambda k: F.exists(F.filter(F.transform(F.coalesce(audit[k], F.array().cast("array<string>")), lambda x: text.strip(x)), lambda x: x != ""), lambda x: ~F.contains(markdown, x))
    found = F.filter(F.array(*(F.when(lost(k), code) for k, code in LOSSES)), lambda x: x.isNotNull())
    return F.when(audit.isNotNull(), found).when(is_html, F.array(F.lit(UNVERIFIED))).otherwise(F.array().cast("array<string>"))


def audit_of(tabs: DataFrame) -> DataFrame:
    """(doc_id, audit): the tokens of a document's tables that its structured text must hold: labels, rows, rows whose
    cells were filled from above, kinds of rows, and its first, middle and last fund code."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    own = F.filter("body", lambda z: z["kept"])
    kind = lambda z: F.get(F.filter(F.transform(z["row"], lambda c: F.when(F.lower(text.bare(c)).isin("입금", "출금", "환매신청", "설정", "해지"), c)), lambda c: c.isNotNull()), F.lit(0))
    codes = F.filter(F.transform(own, lambda z: F.get(z["row"], F.col("code_at") - 1)), lambda c: F.coalesce(c, F.lit("")) != "")
    t = tabs.select(
        "doc_id", "section_no", "block_no", F.array(F.struct(
            F.filter("header", lambda h: h != "").alias("labels"), F.transform(own, lambda z: line(z["row"])).alias("rows"), F.transform(F.filter(own, lambda z: z["own"] != z["row"]), lambda z: line(z["row"])).alias("inherited"),
            F.filter(F.transform(own, kind), lambda k: k.isNotNull()).alias("kinds"), codes.alias("codes"),
        )).alias("a"),
    ).select("doc_id", "section_no", "block_no", layout.posexplode("a").alias("p", "a")).where("a.labels IS NOT NULL")
    placed = lambda k: F.array_sort(F.collect_list(F.struct("section_no", "block_no", F.col(f"a.{k}").alias("x"))))
    flat = lambda k: F.array_distinct(F.flatten(F.transform(placed(k), lambda q: q["x"]))).alias(k)
    g = t.groupBy("doc_id").agg(*(flat(k) for k in ("labels", "rows", "inherited", "kinds", "codes")))
    n = F.size("codes")
    three = F.when(n <= 3, F.col("codes")).otherwise(F.array(F.get("codes", F.lit(0)), F.get("codes", F.floor(n / 2).cast("int")), F.element_at("codes", -1)))
    return g.select("doc_id", F.struct("labels", "rows", "inherited", "kinds", three.alias("codes")).alias("audit"))


def model_context(markdown: Column, raw: Column, size: int = 12_000, tail: int = 2_000) -> Column:
    """Structured text with the raw text behind it; a long raw text keeps `size` characters and its last `tail`."""
    cut = F.when(F.length(raw) > size + tail, F.concat(F.substring(raw, 1, size), F.lit("\n...\n"), F.substring(raw, -tail, tail))).otherwise(raw)
    return F.when(F.coalesce(raw, F.lit("")) != "", F.concat(markdown, F.lit(BACKUP), cut, F.lit(FENCE_END))).otherwise(markdown)


def structured_view(context: Column) -> Column:
    """The structured part of `model_context`."""
    return F.substring_index(context, BACKUP, 1)
