"""Queries on documents: layout recovery, orders read off tables, coverage, and what was extracted against it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import amounts, labels, text
from ..operators import builders, coverage, issues, joins, layout, merge, orders, scope, sets
from . import sql as S
from . import table_sql as T
from .order_queries import _DEDUPED, _ITEMS, _ORDERS, _live, items
from .pipeline import BLOCKING
from .tables import spread, table


def docs(spark: SparkSession, sf_dir: str, field: str = "raw_text") -> DataFrame:
    return spread(table(spark, sf_dir, "task_payloads").select(F.col("payload_id").alias("doc_id"), F.col(field).alias("text")), "doc_id")


def tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.tables(layout.raw_rows(layout.sections(docs(spark, sf_dir))))


def recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return builders.recovered(docs(spark, sf_dir))


def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = layout.sections(docs(spark, sf_dir))
    return s.select("doc_id", "section_no", layout.marker(F.col("section")).alias("kind"), F.size(F.split("section", "\n")).alias("n_lines"))


def pipe_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = layout.raw_rows(layout.sections(docs(spark, sf_dir)))
    return r.select("doc_id", "section_no", "block_no", F.size("rows").alias("n_rows"), F.array_max(F.transform("rows", F.size)).alias("width"))


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.long_cells(layout.raw_rows(layout.sections(docs(spark, sf_dir))))


def table_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tabs(spark, sf_dir).select("doc_id", "section_no", "block_no", F.array(F.struct("header_at", "data_at", "header", "code_at", "name_at", "manager_at")).alias("h"))
    t = t.select("doc_id", "section_no", "block_no", layout.posexplode("h").alias("p", "h")).where("h.header_at IS NOT NULL")
    return t.select("doc_id", "section_no", "block_no", "h.header_at", "h.data_at", F.array_join("h.header", "¦").alias("header"), "h.code_at", "h.name_at", "h.manager_at")


def body_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.body_rows(tabs(spark, sf_dir)).select("doc_id", "section_no", "block_no", "row_no", "code", "name", "manager", "total", "data", "kept")


def fill_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and managers of body rows, blank ones filled from the row above (merged cells)."""
    b = layout.body_rows(tabs(spark, sf_dir))
    part = lambda at: text.blank_to_null(text.squeeze(layout.cell_at(F.col("row"), F.col(at))))
    return b.select("doc_id", "section_no", "block_no", "row_no", part("code_at").alias("code"), part("manager_at").alias("manager"), "total")


def structured_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as the structured text shows them: rows and columns of orders only."""
    t = layout.pruned(tabs(spark, sf_dir)).select("doc_id", "section_no", "block_no", layout.posexplode(F.concat(F.array("header"), "body")).alias("row_no", "row")).where("row IS NOT NULL")
    return t.select("doc_id", "section_no", "block_no", "row_no", F.array_join("row", "¦").alias("cells"))


def neighbour_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a code take the one of the row above, else of the row below, in their block."""
    return joins.neighbour(layout.body_rows(tabs(spark, sf_dir)).select("doc_id", "section_no", "block_no", "row_no", "code"), "code")


def document_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return builders.dated(docs(spark, sf_dir).where("text IS NOT NULL")).select("doc_id", "base_date", F.col("date_source").alias("source"))


def amount_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = builders.cells_of(recovered(spark, sf_dir))
    return c.select("doc_id", "section_no", "block_no", "row_no", "col_no", "fund_code", "fund_name", "label", "t_day", "signed", "by_row", "order_type", F.col("amount").cast("decimal(20,4)").cast("string").alias("amount"))


def table_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return builders.table_orders(recovered(spark, sf_dir))


def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.counts(tabs(spark, sf_dir), docs(spark, sf_dir))


def coverage_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose tables give another number of orders than they were loaded with."""
    p = table(spark, sf_dir, "task_payloads").select(F.col("payload_id").alias("doc_id"), "expected_order_count")
    got = p.join(coverage.counts(tabs(spark, sf_dir), docs(spark, sf_dir)), "doc_id", "left").withColumn("n_cells", F.coalesce("n_cells", F.lit(0)).cast("long"))
    return got.where("expected_order_count IS NULL OR expected_order_count <> n_cells")


def scope_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted orders that a document's fund scope lets through; documents without a limiting scope keep all."""
    p = table(spark, sf_dir, "task_payloads")
    o = table(spark, sf_dir, "order_extractions").select(F.col("payload_id").alias("doc_id"), "order_id", "fund_code", "fund_name")
    return coverage.in_scope(o, coverage.scope_members(p), coverage.limited(p)).select("doc_id", "order_id")


def fund_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return builders.seeds(recovered(spark, sf_dir))


def missing_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Funds of a document's tables that its stage items don't hold."""
    have = items(spark, sf_dir).select("doc_id", F.coalesce(text.squeeze(F.col("fund_code")), F.lit("")).alias("fund_code")).distinct()
    return builders.seeds(recovered(spark, sf_dir)).join(have, ["doc_id", "fund_code"], "left_anti").select("doc_id", "fund_code", "fund_name")


def hint_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with the direction that the document's own tables give their fund and amount, where it is one."""
    c = builders.cells_of(recovered(spark, sf_dir)).where("fund_code IS NOT NULL")
    hints = orders.direction_hints(c.withColumn("unsigned", amounts.render(F.abs("amount"))), ["doc_id", "fund_code", "unsigned"])
    own = _live(spark, sf_dir).withColumn("unsigned", amounts.unsigned(F.col("transfer_amount"))).select("doc_id", "ord", F.col("id_code").alias("fund_code"), "unsigned", F.col("order_type").alias("own_type"))
    return own.join(hints, ["doc_id", "fund_code", "unsigned"], "left").select("doc_id", "ord", "fund_code", "own_type", F.col("order_type").alias("hinted_type"))


def fan_out_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fund of a document with the document's date; items without a date take it."""
    i = items(spark, sf_dir).select("doc_id", "ord", "base_date")
    return joins.fan_out(i, builders.dated(docs(spark, sf_dir)).select("doc_id", F.col("base_date").alias("document_date")))


def sibling_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that lack an amount, a date or a settlement, and whether a sibling of the same fund and slot has it."""
    return joins.siblings(orders.with_identity(items(spark, sf_dir)), ["doc_id", "id_code", "id_name", "slot_id"], ["transfer_amount", "base_date", "settle_class"])


def slot_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items matched to table cells on fund, day and direction, kept only where exactly one cell fits."""
    cells = builders.table_orders(recovered(spark, sf_dir))
    i = _live(spark, sf_dir).select("doc_id", "ord", F.col("id_code").alias("fund_code"), "t_day", "order_type", "canonical")
    return joins.match_unique(i, cells.select("doc_id", "fund_code", "t_day", "order_type", F.col("transfer_amount").alias("cell_amount")), ["doc_id", "fund_code", "t_day", "order_type"], "cell_amount")


def corroborated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: do the orders from evidence equal, as multisets, those read off its tables?"""
    a = orders.aggregate(_live(spark, sf_dir))
    b = builders.table_orders(recovered(spark, sf_dir))
    keys = ["fund_code", "settle_class", "order_type", "base_date", "t_day", "transfer_amount"]
    return sets.multiset_difference(a, b, "doc_id", keys)


def corroborated_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As `corroborated`, date and day ignored."""
    a = orders.aggregate(_live(spark, sf_dir))
    b = builders.table_orders(recovered(spark, sf_dir))
    return sets.multiset_difference(a, b, "doc_id", ["fund_code", "order_type", "transfer_amount"])


def family_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the funds of the evidence and of the tables: shared, missing, added."""
    a = _live(spark, sf_dir).select("doc_id", F.col("id_code").alias("fund"))
    b = builders.cells_of(recovered(spark, sf_dir)).where("fund_code IS NOT NULL").select("doc_id", F.col("fund_code").alias("fund"))
    return sets.overlap(a, b, "doc_id", "fund")


def stage_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, whether the stage's output lost, added, repeated or left incomplete families of its input."""
    out = orders.with_identity(items(spark, sf_dir))
    given = table(spark, sf_dir, "order_extractions").select(F.col("payload_id").alias("doc_id"), "fund_code", "fund_name")
    return sets.stage_findings(orders.with_identity(given), out, "doc_id", ["id_code", "id_name"], ["base_date", "t_day", "transfer_amount"])


def markdown_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = layout.sections(docs(spark, sf_dir, "markdown_text"), layout.MARKDOWN_DELIMITER)
    return layout.long_cells(layout.markdown_rows(s)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_cells"), F.count_distinct("section_no", "block_no").alias("n_blocks"))


def markdown_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the raw tables that the structured text lost."""
    rows = layout.raw_rows(layout.sections(docs(spark, sf_dir)))
    return layout.missing_tokens(rows, docs(spark, sf_dir, "markdown_text").where("text IS NOT NULL"))


def rendered_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = layout.raw_rows(layout.sections(docs(spark, sf_dir)))
    return r.select("doc_id", "section_no", "block_no", layout.render_table(F.col("rows")).alias("table_text"))


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = layout.sections(docs(spark, sf_dir))
    return s.select("doc_id", "section_no", layout.heading(F.get(F.split("section", "\n"), F.lit(0)), F.col("section_no")).alias("heading"))


def packed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of the structured text packed into chunks of at most 12,000 characters: count and longest."""
    d = docs(spark, sf_dir, "markdown_text").where("text IS NOT NULL")
    parts = F.filter(F.split("text", layout.MARKDOWN_DELIMITER), lambda x: F.trim(x) != "")
    c = d.select("doc_id", layout.pack_sections(parts, 12_000, layout.MARKDOWN_DELIMITER).alias("chunks"))
    return c.select("doc_id", F.size("chunks").alias("n_chunks"), F.array_max(F.transform("chunks", F.length)).alias("longest"))


def counterparty_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The party of each document: tokens of its text first, then of its file name, in the order of the map."""
    p = table(spark, sf_dir, "task_payloads").select("payload_id", "file_name", "raw_text")
    return joins.resolve_party(p, joins.PARTIES)


def no_order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "task_payloads").where("raw_text IS NOT NULL")
    body = F.size(F.filter(F.split("raw_text", "\n"), lambda x: F.trim(x) != ""))
    return p.select("payload_id", text.contains_any(F.lower("raw_text"), joins.NO_ORDER_MARKERS).alias("no_order"), (body <= 6).alias("short"))


#: The manager whose funds the scope queries look for.
TARGET = "누리벗"


def document_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The funds of one manager in each document, as the document's own tables tell."""
    d = scope.document_scope(docs(spark, sf_dir), TARGET)
    lists = ("fund_codes", "fund_names", "canonical_fund_names")
    return d.select("doc_id", "manager_column_present", "include_all_funds", *(F.array_join(c, "¦").alias(c) for c in lists))


def document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each task payload, by the orders that its tables give."""
    n = builders.table_orders(recovered(spark, sf_dir)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_orders")).withColumnRenamed("doc_id", "payload_id")
    return issues.document_status(table(spark, sf_dir, "task_payloads").join(n, "payload_id", "left"))


def non_instruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return issues.non_instruction(d.join(coverage.counts(tabs(spark, sf_dir), d), "doc_id", "left"))


def issue_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issues of each payload's last run that its orders, items and tables don't disprove."""
    p = merge.latest(table(spark, sf_dir, "document_payloads")).select("payload_id", "issues", "orders")
    s = table(spark, sf_dir, "task_payloads").select("payload_id", F.col("target_fund_scope").alias("s"))
    has = lambda field, v: F.coalesce(F.array_contains(F.col(f"s.{field}"), v), F.lit(False))
    named = lambda o: has("fund_codes", o["fund_code"]) | has("fund_names", o["fund_name"]) | has("canonical_fund_names", text.name_key(o["fund_name"]))
    p = p.join(s, "payload_id", "left").withColumn("in_scope", F.coalesce(F.col("s.manager_column_present") & (F.col("s.include_all_funds") | F.forall("orders", named)), F.lit(False))).drop("s")
    keys = ["fund_code", "settle_class", "order_type", "base_date", "t_day", "transfer_amount"]
    own = p.select(F.col("payload_id").alias("doc_id"), F.explode("orders").alias("o")).select("doc_id", *(F.col(f"o.{k}").alias(k) for k in keys))
    read = orders.output_form(builders.table_orders(recovered(spark, sf_dir))).select("doc_id", *keys)
    same = sets.multiset_difference(own, read, "doc_id", keys).select(F.col("doc_id").alias("payload_id"), ((F.col("only_left") == 0) & (F.col("only_right") == 0)).alias("corroborated"))
    facts = issues.open_items(items(spark, sf_dir), issues.paid_funds(tabs(spark, sf_dir)))
    kept = issues.reconciled(p.join(same, "payload_id", "left"), facts, BLOCKING)
    return kept.select("payload_id", F.array_join("kept", "|").alias("kept"))


def open_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with items that lack what their own tables have."""
    return issues.open_items(items(spark, sf_dir), issues.paid_funds(tabs(spark, sf_dir)))


def row_local_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of tables that name funds but give no code, each with the number of its row in the document."""
    return builders.row_local_orders(recovered(spark, sf_dir)).drop("label")


QUERIES = {
    f.__name__: f
    for f in (
        section_split, pipe_blocks, table_cells, table_headers, body_rows, fill_down, structured_tables, neighbour_identity, document_dates, amount_unpivot, table_orders, coverage_counts, coverage_gap,
        scope_orders, fund_seeds, missing_seeds, hint_join, fan_out_dates, sibling_complete, slot_match, corroborated, corroborated_core, family_overlap, stage_partial,
        markdown_cells, markdown_loss, rendered_tables, headings, packed_chunks, counterparty_match, no_order_documents,
        document_scope, document_status, non_instruction, issue_reconcile, open_items, row_local_orders,
    )
}


_B = "doc_id, section_no, block_no"
_LATEST_RUN = "l AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY payload_id ORDER BY run_no DESC, finished_at DESC) AS rn FROM document_payloads) WHERE rn = 1)"
_SCHEDULED = r"regexp_matches(lower(label), '예정|청구|예상|t\+|익+영업일|제\s*[0-9]+\s*영업일|[0-9]{1,2}\s*월\s*[0-9]{1,2}\s*일|[0-9]{1,2}[/-][0-9]{1,2}|[0-9]{4}-[0-9]{2}-[0-9]{2}')"


def _is(code: str) -> str:
    return f"(i = '{code}' OR starts_with(i, '{code}:') OR starts_with(i, '{code}_'))"


_OPEN = f"""{T.READ}, {_ITEMS},
pa AS (SELECT b.doc_id, b.section_no, b.block_no, b.row_no FROM bod b JOIN col c USING (doc_id, section_no, block_no, col_no) WHERE regexp_full_match(b.v, '[+-]?[0-9,]*[0-9](\\.[0-9]+)?') AND regexp_matches(b.v, '[1-9]') AND (c.label = '' OR {T.words("c.low", "금액", "amount", "예상", "결제", "execution", "settlement", "입금", "출금", "설정", "해지", "buy", "sell", "subscription", "redemption")} AND NOT {T.words("c.low", "좌수", "unit", "share")}) GROUP BY ALL),
pf AS (SELECT DISTINCT b.doc_id, CASE WHEN b.col_no = c.code_at THEN b.v END AS code, CASE WHEN b.col_no = c.name_at THEN nullif({S.name_key("b.v")}, '') END AS key FROM bod b JOIN pa USING (doc_id, section_no, block_no, row_no) JOIN cat c USING (doc_id, section_no, block_no) WHERE b.col_no = c.code_at OR b.col_no = c.name_at),
it AS (SELECT doc_id, ord, coalesce({S.squeeze("fund_code")}, '') AS code, coalesce({S.squeeze("fund_name")}, '') AS name, {S.normalize_date("base_date")} AS day, t_day, coalesce({S.squeeze("evidence_label")}, '') AS label, coalesce({S.squeeze("settle_class")}, '') AS settle, coalesce({S.squeeze("order_type")}, '') AS kind, {S.canonical("transfer_amount")} AS amount, row_number() OVER () AS n FROM i),
i2 AS (SELECT *, bool_or(amount IS NOT NULL) OVER (PARTITION BY doc_id, code, name, day, t_day, label, settle) AS has_amount, bool_or(kind <> '') OVER (PARTITION BY doc_id, code, name, day, t_day, label, settle) AS has_kind, bool_or(settle <> '') OVER (PARTITION BY doc_id, code, name, day, t_day, label) AS has_settle, bool_or(t_day IS NOT NULL) OVER (PARTITION BY doc_id, code, name, day, label, settle) AS has_day,
 code = '' AND {S.name_key("name")} = '' OR EXISTS (SELECT 1 FROM pf WHERE pf.doc_id = it.doc_id AND (pf.code = it.code AND it.code <> '' OR pf.key = {S.name_key("it.name")})) AS backed,
 (SELECT count(*) FROM it z WHERE z.doc_id = it.doc_id AND z.code <> '' AND z.name <> '' AND z.day IS NOT DISTINCT FROM it.day AND z.t_day IS NOT DISTINCT FROM it.t_day AND z.label = it.label AND z.settle = it.settle AND z.kind = it.kind AND z.amount IS NOT DISTINCT FROM it.amount AND (it.code = '' OR z.code = it.code) AND (it.name = '' OR z.name = it.name)) AS whole FROM it),
i3 AS (SELECT *, amount IS NOT NULL AND amount <> '0' AND NOT {T.words("lower(label)", "좌수", "unit", "share", "nav대비", "ratio", "%", "합산", "누계", "총합", "subtotal", "total")} AS money FROM i2),
opn AS (SELECT doc_id, bool_or(t_day IS NULL AND {_SCHEDULED}) AND bool_or(t_day IS NULL AND backed AND NOT has_day) AS t_day_open, bool_or(amount IS NULL AND backed AND NOT has_amount) AS amount_open, bool_or(kind = '' AND backed AND NOT has_kind) AS kind_open,
 bool_or(settle = '' AND money AND NOT has_settle AND t_day IS NULL AND NOT {_SCHEDULED} AND NOT {T.words("lower(label)", "당일", "확정", "실행", "설정금액", "해지금액", "입금액", "출금액", "buy", "sell", "subscription", "redemption", "order", "instruction", "운용지시", "지시서")}) AS settle_open,
 bool_or((code = '' OR name = '') AND money AND CASE WHEN code = '' AND name = '' THEN whole <> 1 ELSE whole = 0 END) AS fund_open FROM i3 GROUP BY doc_id)"""
_MARKERS = ["지시없음", "지시 없음", "거래없음", "거래 없음", "설정해지 지시없음", "자금설정해지 지시없음", "no instruction", "no instructions", "no order", "no orders", "no transaction", "no transactions"]


def _difference(keys: list[str]) -> str:
    on = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in ["doc_id", *keys])
    cols = ", ".join(["doc_id", *keys])
    return f"""ca AS (SELECT {cols}, count(*) AS n FROM o GROUP BY {cols}), cb AS (SELECT {cols}, count(*) AS n FROM tor GROUP BY {cols}),
df AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb FROM ca a FULL JOIN cb b ON {on})
SELECT doc_id, CAST(sum(greatest(na - nb, 0)) AS BIGINT) AS only_left, CAST(sum(greatest(nb - na, 0)) AS BIGINT) AS only_right, CAST(sum(least(na, nb)) AS BIGINT) AS shared FROM df GROUP BY doc_id"""


MD = r"(?m)(?:^\|.*$\n?)+"
SQL = {
    "section_split": f"WITH {T.sections('raw_text', T.RAW)} SELECT doc_id, section_no, nullif(regexp_extract(section, '^\\s*\\[(PAGE|SHEET|HTML|EML|MHT)\\b[^\\]\\n]*\\]', 1), '') AS kind, CAST(len(string_split(section, chr(10))) AS INTEGER) AS n_lines FROM sec",
    "pipe_blocks": f"WITH {T.CELLS} SELECT {_B}, CAST(max(row_no) AS INTEGER) AS n_rows, CAST(max(col_no) AS INTEGER) AS width FROM cel GROUP BY {_B}",
    "table_cells": f"WITH {T.CELLS} SELECT {_B}, row_no, col_no, cell FROM cel",
    "table_headers": f"WITH {T.GRID}, {T.LABELS} SELECT t.doc_id, t.section_no, t.block_no, t.header_at, t.data_at, string_agg(h.label, '¦' ORDER BY h.col_no) AS header, any_value(c.code_at) AS code_at, any_value(c.name_at) AS name_at, any_value(c.manager_at) AS manager_at FROM tab t JOIN hdr h USING (doc_id, section_no, block_no) JOIN cat c USING (doc_id, section_no, block_no) GROUP BY t.doc_id, t.section_no, t.block_no, t.header_at, t.data_at",
    "body_rows": f"WITH {T.ROWS} SELECT {_B}, row_no, code, name, manager, total, data, kept FROM rws",
    "fill_down": f"WITH {T.ROWS} SELECT {_B}, row_no, filled_code AS code, filled_manager AS manager, total FROM rws",
    "neighbour_identity": f"WITH {T.ROWS} SELECT {_B}, row_no, coalesce(code, lag(code) OVER w, lead(code) OVER w) AS code, code IS NULL AS borrowed FROM rws WINDOW w AS (PARTITION BY {_B} ORDER BY row_no)",
    "document_dates": f"WITH {T.DATES} SELECT doc_id, base_date, source FROM dd",
    "structured_tables": f"WITH {T.PRUNED} SELECT {_B}, row_no, string_agg(v, '¦' ORDER BY col_no) AS cells FROM pce GROUP BY {_B}, row_no UNION ALL SELECT {_B}, 0, string_agg(label, '¦' ORDER BY col_no) FROM pco GROUP BY {_B}",
    "amount_unpivot": f"WITH {T.UNPIVOT} SELECT {_B}, row_no, col_no, fund_code, fund_name, label, t_day, signed, by_row, order_type, CAST(CAST(amount AS DECIMAL(20,4)) AS VARCHAR) AS amount FROM am",
    "table_orders": f"WITH {T.TABLE_ORDERS} SELECT * FROM tor",
    "coverage_counts": f"WITH {T.COVERED} SELECT doc_id, count(*) AS n_cells FROM cov GROUP BY doc_id",
    "coverage_gap": f"WITH {T.COVERED}, n AS (SELECT doc_id, count(*) AS n_cells FROM cov GROUP BY doc_id) SELECT payload_id AS doc_id, expected_order_count, coalesce(n_cells, 0) AS n_cells FROM task_payloads LEFT JOIN n ON n.doc_id = payload_id WHERE expected_order_count IS NULL OR expected_order_count <> coalesce(n_cells, 0)",
    "scope_orders": f"SELECT o.payload_id AS doc_id, order_id FROM order_extractions o LEFT JOIN task_payloads p ON p.payload_id = o.payload_id WHERE p.target_fund_scope IS NULL OR NOT coalesce(p.target_fund_scope.manager_column_present, false) OR coalesce(p.target_fund_scope.include_all_funds, false) OR coalesce(list_contains(p.target_fund_scope.fund_codes, o.fund_code), false) OR coalesce(list_contains(p.target_fund_scope.fund_names, o.fund_name), false) OR coalesce(list_contains(p.target_fund_scope.canonical_fund_names, {S.name_key('o.fund_name')}), false)",
    "fund_seeds": f"WITH {T.UNPIVOT} SELECT DISTINCT doc_id, fund_code, fund_name FROM am WHERE fund_code IS NOT NULL AND fund_name IS NOT NULL",
    "missing_seeds": f"WITH {T.UNPIVOT}, h AS (SELECT DISTINCT payload_id AS doc_id, coalesce({S.squeeze('fund_code')}, '') AS fund_code FROM resolved_items) SELECT DISTINCT doc_id, fund_code, fund_name FROM am WHERE fund_code IS NOT NULL AND fund_name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = am.doc_id AND h.fund_code = am.fund_code)",
    "hint_join": f"WITH {T.UNPIVOT}, {_DEDUPED.partition('d AS (')[0].rstrip().rstrip(',')}, hi AS (SELECT doc_id, fund_code, {S.render('CAST(abs(amount) AS DECIMAL(38,10))')} AS u, min(order_type) AS h FROM am WHERE order_type IS NOT NULL AND fund_code IS NOT NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT order_type) = 1) SELECT c.doc_id, c.ord, c.id_code AS fund_code, c.order_type AS own_type, h AS hinted_type FROM c LEFT JOIN hi ON hi.doc_id = c.doc_id AND hi.fund_code = c.id_code AND hi.u = ltrim(c.canonical, '+-') WHERE drop_reason IS NULL",
    "fan_out_dates": f"WITH {_ITEMS}, {T.DATES} SELECT i.doc_id, i.ord, coalesce(i.base_date, dd.base_date) AS base_date, i.base_date IS NULL AND dd.base_date IS NOT NULL AS taken FROM i LEFT JOIN dd ON dd.doc_id = i.doc_id",
    "sibling_complete": f"""WITH {_ITEMS}, k AS (SELECT *, coalesce({S.squeeze("fund_code")}, '') AS id_code, CASE WHEN coalesce({S.squeeze("fund_code")}, '') = '' THEN coalesce({S.squeeze("fund_name")}, '') ELSE '' END AS id_name FROM i),
s AS (SELECT *, bool_or(transfer_amount IS NOT NULL) OVER w AS a, bool_or(base_date IS NOT NULL) OVER w AS b, bool_or(settle_class IS NOT NULL) OVER w AS c FROM k WINDOW w AS (PARTITION BY doc_id, id_code, id_name, slot_id))
SELECT doc_id, ord, f AS field, has FROM (SELECT doc_id, ord, 'transfer_amount' AS f, a AS has FROM s WHERE transfer_amount IS NULL UNION ALL SELECT doc_id, ord, 'base_date', b FROM s WHERE base_date IS NULL UNION ALL SELECT doc_id, ord, 'settle_class', c FROM s WHERE settle_class IS NULL)""",
    "slot_match": f"WITH {T.TABLE_ORDERS}, {_DEDUPED.partition('d AS (')[0].rstrip().rstrip(',')}, u AS (SELECT doc_id, fund_code, t_day, order_type, min(transfer_amount) AS cell_amount FROM tor GROUP BY 1, 2, 3, 4 HAVING count(*) = 1) SELECT c.doc_id, c.ord, c.id_code AS fund_code, c.t_day, c.order_type, c.canonical, u.cell_amount FROM c JOIN u ON u.doc_id = c.doc_id AND u.fund_code = c.id_code AND u.t_day = c.t_day AND u.order_type = c.order_type WHERE drop_reason IS NULL",
    "corroborated": f"WITH {T.TABLE_ORDERS}, {_ORDERS}, {_difference(['fund_code', 'settle_class', 'order_type', 'base_date', 't_day', 'transfer_amount'])}",
    "corroborated_core": f"WITH {T.TABLE_ORDERS}, {_ORDERS}, {_difference(['fund_code', 'order_type', 'transfer_amount'])}",
    "family_overlap": f"WITH {T.UNPIVOT}, {_DEDUPED.partition('d AS (')[0].rstrip().rstrip(',')}, x AS (SELECT DISTINCT doc_id, id_code AS fund FROM c WHERE drop_reason IS NULL), y AS (SELECT DISTINCT doc_id, fund_code AS fund FROM am WHERE fund_code IS NOT NULL), z AS (SELECT coalesce(x.doc_id, y.doc_id) AS doc_id, x.fund IS NOT NULL AS l, y.fund IS NOT NULL AS r FROM x FULL JOIN y ON x.doc_id = y.doc_id AND x.fund = y.fund) SELECT doc_id, count(*) FILTER (l AND r) AS shared, count(*) FILTER (l AND NOT r) AS only_left, count(*) FILTER (r AND NOT l) AS only_right FROM z GROUP BY doc_id",
    "markdown_cells": rf"""WITH {T.sections("markdown_text", T.STRUCTURED)}, {T.blocks(MD)}, p AS (SELECT *, string_split_regex(regexp_replace(regexp_replace(trim(line), '^\|\s*', ''), '\s*\|$', ''), '\s*\|\s*') AS parts FROM lin WHERE NOT regexp_full_match(line, '[|\s:\-]+')) SELECT doc_id, CAST(sum(len(parts)) AS BIGINT) AS n_cells, count(DISTINCT concat(section_no, '/', block_no)) AS n_blocks FROM p GROUP BY doc_id""",
    "markdown_loss": f"WITH {T.CELLS}, u AS (SELECT DISTINCT doc_id, cell FROM cel WHERE cell <> '') SELECT doc_id, CAST(count(*) AS INTEGER) AS n_cells, CAST(count(*) FILTER (NOT contains(markdown_text, cell)) AS INTEGER) AS n_missing FROM u JOIN task_payloads ON payload_id = doc_id WHERE markdown_text IS NOT NULL GROUP BY doc_id",
    "rendered_tables": f"WITH {T.CELLS}, l AS (SELECT {_B}, row_no, concat('| ', string_agg(replace(cell, '|', '\\|'), ' | ' ORDER BY col_no), ' |') AS line, concat('| ', string_agg('---', ' | '), ' |') AS dashes FROM cel GROUP BY {_B}, row_no) SELECT {_B}, concat_ws(chr(10), arg_min(line, row_no), arg_min(dashes, row_no), coalesce(string_agg(line, chr(10) ORDER BY row_no) FILTER (row_no > 1), '')) AS table_text FROM l GROUP BY {_B}",
    "no_order_documents": f"SELECT payload_id, {S.contains_any('lower(raw_text)', _MARKERS)} AS no_order, len(list_filter(string_split(raw_text, chr(10)), lambda z: trim(z, ' ') <> '')) <= 6 AS short FROM task_payloads WHERE raw_text IS NOT NULL",
    "document_scope": f"""WITH {T.BODY}, rr AS (SELECT b.doc_id, b.section_no, b.block_no, b.row_no, any_value(c.manager_at) AS m_at, coalesce(max(CASE WHEN d.col_no = c.code_at THEN trim(d.own) END), '') AS code, coalesce(max(CASE WHEN d.col_no = c.name_at THEN trim(d.own) END), '') AS name, coalesce(max(CASE WHEN d.col_no = c.manager_at THEN trim(d.own) END), '') AS manager
 FROM bro b JOIN bod d USING (doc_id, section_no, block_no, row_no) JOIN cat c USING (doc_id, section_no, block_no) WHERE b.data AND (c.code_at IS NOT NULL OR c.name_at IS NOT NULL) AND EXISTS (SELECT 1 FROM col k WHERE k.doc_id = b.doc_id AND k.section_no = b.section_no AND k.block_no = b.block_no AND k.pays) GROUP BY b.doc_id, b.section_no, b.block_no, b.row_no),
mg AS (SELECT doc_id, bool_or(m_at IS NOT NULL AND lower(manager) NOT IN ('', '-', '--', '—', 'n/a', 'na', 'null')) AS managed FROM rr GROUP BY doc_id),
hit AS (SELECT * FROM rr WHERE m_at IS NOT NULL AND contains(manager, '누리벗') AND NOT {T.total_text("code")} AND NOT {T.total_text("name")}),
fu AS (SELECT doc_id, string_agg(DISTINCT nullif(code, ''), '¦' ORDER BY nullif(code, '')) AS codes, string_agg(DISTINCT nullif(name, ''), '¦' ORDER BY nullif(name, '')) AS names, string_agg(DISTINCT nullif({S.name_key("name")}, ''), '¦' ORDER BY nullif({S.name_key("name")}, '')) AS keys FROM hit GROUP BY doc_id)
SELECT s.doc_id, coalesce(mg.managed, false) AS manager_column_present, CASE WHEN fu.doc_id IS NOT NULL THEN false ELSE NOT coalesce(mg.managed, false) END AS include_all_funds, coalesce(fu.codes, '') AS fund_codes, coalesce(fu.names, '') AS fund_names, coalesce(fu.keys, '') AS canonical_fund_names
 FROM (SELECT DISTINCT doc_id FROM sec) s LEFT JOIN mg USING (doc_id) LEFT JOIN fu USING (doc_id)""",
    "document_status": f"""WITH {T.TABLE_ORDERS}, n AS (SELECT DISTINCT doc_id FROM tor) SELECT payload_id, CASE WHEN n.doc_id IS NULL THEN 'SKIPPED' ELSE 'COMPLETED' END AS status,
 CASE WHEN n.doc_id IS NULL THEN CASE WHEN non_instruction_reason <> '' THEN concat('not an order instruction: ', source_path, ': ', non_instruction_reason) WHEN allow_empty_result THEN 'no trade in the document' WHEN scope_excludes_all_funds THEN 'no order of the funds in scope' ELSE 'no order found' END END AS reason FROM task_payloads LEFT JOIN n ON n.doc_id = payload_id""",
    "non_instruction": f"""WITH {T.COVERED}, n AS (SELECT DISTINCT doc_id FROM cov), t AS (SELECT payload_id AS doc_id, lower(raw_text) AS low, list_filter(list_transform(string_split(regexp_extract(raw_text, '(?s)^(?:[^\\n]*\\S[^\\n]*\\n)*[^\\S\\n]*\\n(.*)', 1), chr(10)), lambda z: trim(z)), lambda z: z <> '') AS body FROM task_payloads WHERE raw_text IS NOT NULL),
m AS (SELECT *, contains(low, 'subject:') AND contains(low, 'from:') AND contains(low, 'to:') AND contains(low, 'date:') AS mail, contains(low, '첨부파일과 같이')::INT + contains(low, '송부드리니')::INT + contains(low, '참고하시기 바랍니다')::INT + contains(low, '업무에 참고')::INT + contains(low, '감사합니다')::INT AS cover FROM t)
SELECT m.doc_id, CASE WHEN n.doc_id IS NOT NULL THEN NULL WHEN contains(regexp_replace(low, '\\s+', '', 'g'), '설정해지금액통보') OR contains(regexp_replace(low, '\\s+', '', 'g'), '설정/해지금액통보') THEN 'notice'
 WHEN mail AND (cover >= 2 AND NOT (contains(low, '지시서') OR contains(low, 'order of subscription and redemption') OR contains(low, 'buy & sell report') OR contains(low, 'buy&sell report') OR contains(low, '설정 및 해지내역') OR contains(low, '설정/해지 내역') OR contains(low, '설정해지내역서'))
 OR len(body) BETWEEN 1 AND 6 AND (contains(low, '첨부') OR contains(low, 'attached') OR contains(low, 'attachment') OR contains(low, '붙임') OR contains(low, '받기') OR contains(low, 'mac용 outlook') OR contains(low, 'outlook for mac') OR len(list_filter(body, lambda z: starts_with(lower(z), 'to.') OR starts_with(lower(z), 'from.'))) >= 2)) THEN 'cover' END AS why FROM m LEFT JOIN n USING (doc_id)""",
    "open_items": f"WITH {_OPEN} SELECT * FROM opn",
    "issue_reconcile": f"""WITH {_OPEN}, {T.TABLE_ORDERS.partition(T.READ)[2].lstrip(", ").replace("{", "{")}, {_LATEST_RUN},
ow AS (SELECT payload_id AS doc_id, o.fund_code, o.settle_class, o.order_type, o.base_date, o.t_day, o.transfer_amount FROM (SELECT payload_id, unnest(orders) AS o FROM l)),
rd AS (SELECT doc_id, fund_code, {S.output_codes("settle_class", "order_type", "t_day")}, base_date, {S.output_amount("transfer_amount", "order_type")} AS transfer_amount FROM tor),
sg AS (SELECT doc_id, fund_code, settle_class, order_type, base_date, t_day, transfer_amount, sum(w) AS w FROM (SELECT *, 1 AS w FROM ow UNION ALL BY NAME SELECT *, -1 AS w FROM rd) GROUP BY ALL),
cb AS (SELECT doc_id, bool_and(w = 0) AS corroborated FROM sg GROUP BY doc_id),
f0 AS (SELECT l.payload_id, l.issues, l.orders, len(l.orders) > 0 AS n, coalesce(cb.corroborated, false) AS corroborated, coalesce(p.target_fund_scope.manager_column_present AND (p.target_fund_scope.include_all_funds OR len(list_filter(l.orders, lambda o: NOT (coalesce(list_contains(p.target_fund_scope.fund_codes, o.fund_code), false) OR coalesce(list_contains(p.target_fund_scope.fund_names, o.fund_name), false) OR coalesce(list_contains(p.target_fund_scope.canonical_fund_names, {S.name_key("o.fund_name")}), false)))) = 0), false) AS in_scope,
 coalesce(opn.t_day_open, false) AS d, coalesce(opn.amount_open, false) AS a, coalesce(opn.kind_open, false) AS k, coalesce(opn.settle_open, false) AS s, coalesce(opn.fund_open, false) AS f FROM l LEFT JOIN opn ON opn.doc_id = l.payload_id LEFT JOIN cb ON cb.doc_id = l.payload_id LEFT JOIN task_payloads p ON p.payload_id = l.payload_id),
f1 AS (SELECT *, {", ".join(f"n AND len(list_filter(orders, lambda o: coalesce(o.{c}, '') = '')) = 0 AS full_{c}" for c in ("base_date", "t_day", "transfer_amount", "settle_class", "order_type"))}, n AND len(list_filter(orders, lambda o: coalesce(o.fund_code, '') IN ('', '-') OR coalesce(o.fund_name, '') IN ('', '-'))) = 0 AS full_fund FROM f0),
f2 AS (SELECT *, list_filter(issues, lambda i: NOT ({_is("T_DAY_MISSING")} AND NOT d OR {_is("TRANSFER_AMOUNT_MISSING")} AND full_transfer_amount AND NOT a OR {_is("ORDER_TYPE_MISSING")} AND full_order_type AND NOT k OR {_is("SETTLE_CLASS_MISSING")} AND NOT s AND (full_settle_class OR NOT n) OR {_is("BASE_DATE_MISSING")} AND full_base_date OR {_is("FUND_METADATA_INCOMPLETE")} AND NOT f AND full_fund)) AS i1 FROM f1),
f3 AS (SELECT *, list_filter(i1, lambda i: NOT ({" OR ".join(f"{_is(c + '_STAGE_PARTIAL')} AND full_{c.lower()} AND len(list_filter(i1, lambda j: {_is(c + '_MISSING').replace('i,', 'j,').replace('i =', 'j =')})) = 0" for c in ("BASE_DATE", "T_DAY", "TRANSFER_AMOUNT", "SETTLE_CLASS", "ORDER_TYPE"))})) AS i2 FROM f2),
f4 AS (SELECT *, list_filter(i2, lambda i: NOT ({_is("LLM_INVALID_RESPONSE_FORMAT")} AND full_fund AND full_base_date AND full_t_day AND full_transfer_amount AND full_settle_class AND full_order_type AND len(list_filter(i2, lambda j: regexp_matches(j, '^(FUND_DISCOVERY_EMPTY|TRANSACTION_SLOT_EMPTY|TRANSFER_AMOUNT_EMPTY|SETTLE_CLASS_EMPTY|FUND_METADATA_INCOMPLETE|TRANSFER_AMOUNT_MISSING|TRANSFER_AMOUNT_CONFLICT|SETTLE_CLASS_MISSING|ORDER_TYPE_MISSING|T_DAY_MISSING|(BASE_DATE|T_DAY|TRANSFER_AMOUNT|SETTLE_CLASS|ORDER_TYPE)_STAGE_PARTIAL)($|:|_)'))) = 0 OR {_is("ORDER_COVERAGE_ESTIMATE_MISMATCH")} AND corroborated)) AS kept FROM f3)
SELECT payload_id, array_to_string(kept, '|') AS kept FROM f4""",
    "headings": f"WITH {T.sections('raw_text', T.RAW)}, h AS (SELECT *, string_split(section, chr(10))[1] AS f FROM sec) SELECT doc_id, section_no, CASE WHEN starts_with(f, '[PAGE ') AND suffix(trim(f), ']') THEN concat('## Page ', trim(f)[7:-2]) WHEN starts_with(f, '[SHEET ') AND suffix(trim(f), ']') THEN concat('## Sheet ', trim(f)[8:-2]) WHEN starts_with(f, '[HTML ') AND suffix(trim(f), ']') THEN concat('## HTML ', trim(f)[7:-2]) WHEN starts_with(f, '[EML ') AND suffix(trim(f), ']') THEN concat('## EML ', trim(f)[6:-2]) WHEN starts_with(f, '[MHT ') AND suffix(trim(f), ']') THEN concat('## MHT ', trim(f)[6:-2]) ELSE concat('## Section ', section_no) END AS heading FROM h",
    "counterparty_match": r"""WITH t AS (SELECT payload_id, lower(coalesce(raw_text, '')) AS t, lower(coalesce(file_name, '')) AS f FROM task_payloads),
m AS (SELECT *, CASE WHEN contains(t, '특별계정') AND contains(t, '자금') AND contains(t, '집계') THEN 'account-summary' WHEN contains(t, 'order of fund transfers') THEN 'transfer-order' END AS a,
 CASE WHEN contains(f, '운용지시') OR regexp_matches(f, '(^|[^a-z0-9])instr($|[^a-z0-9])') THEN 'instruction' WHEN regexp_matches(f, '(^|[^a-z0-9])(order|fund)($|[^a-z0-9])') THEN 'fund-order' WHEN contains(f, '설정해지') THEN 'settlement' END AS b FROM t)
SELECT payload_id, coalesce(a, b) AS party, CASE WHEN a IS NOT NULL THEN 'text' WHEN b IS NOT NULL THEN 'name' END AS "by" FROM m""",
    "stage_partial": f"""WITH {_ITEMS}, k AS (SELECT doc_id, coalesce({S.squeeze("fund_code")}, '') AS c, CASE WHEN coalesce({S.squeeze("fund_code")}, '') = '' THEN coalesce({S.squeeze("fund_name")}, '') ELSE '' END AS n, base_date IS NULL OR t_day IS NULL OR transfer_amount IS NULL AS bad FROM i),
g AS (SELECT payload_id AS doc_id, coalesce({S.squeeze("fund_code")}, '') AS c, CASE WHEN coalesce({S.squeeze("fund_code")}, '') = '' THEN coalesce({S.squeeze("fund_name")}, '') ELSE '' END AS n FROM order_extractions),
u AS (SELECT doc_id, c, n, true AS g, false AS o, 0 AS bad FROM g UNION ALL SELECT doc_id, c, n, false, true, bad::INT FROM k), f AS (SELECT doc_id, c, n, bool_or(g) AS g, bool_or(o) AS o, sum(bad) AS bad FROM u GROUP BY doc_id, c, n)
SELECT doc_id, count(*) FILTER (g AND NOT o) AS missing, count(*) FILTER (o AND NOT g) AS added, CAST(sum(bad) AS BIGINT) AS incomplete FROM f GROUP BY doc_id""",
    "row_local_orders": f"""WITH {T.UNPIVOT}, v AS (SELECT *, CASE WHEN signed THEN amount WHEN order_type = 'RED' THEN -abs(amount) ELSE abs(amount) END AS value FROM am WHERE NOT has_code AND order_type IS NOT NULL AND base_date IS NOT NULL)
SELECT doc_id, section_no, block_no, row_no, col_no, '' AS fund_code, coalesce(fund_name, '-') AS fund_name, CASE WHEN t_day = 0 THEN 'CONFIRMED' ELSE 'PENDING' END AS settle_class, order_type, base_date, t_day, {S.render(S.snap("value"))} AS transfer_amount,
 CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY section_no, block_no, row_no) AS INTEGER) AS fund_row FROM v""",
    "packed_chunks": """WITH p AS (SELECT payload_id AS doc_id, list_transform(list_filter(string_split(markdown_text, '\n\n<!-- SECTION -->\n\n'), lambda z: trim(z, ' ') <> ''), lambda z: [z]) AS parts FROM task_payloads WHERE markdown_text IS NOT NULL),
c AS (SELECT doc_id, CASE WHEN len(parts) = 0 THEN CAST([] AS VARCHAR[]) ELSE list_reduce(parts, lambda a, x: CASE WHEN length(a[len(a)]) + 20 + length(x[1]) <= 12000 THEN list_concat(a[1:len(a) - 1], [concat(a[len(a)], '\n\n<!-- SECTION -->\n\n', x[1])]) ELSE list_concat(a, x) END) END AS c FROM p)
SELECT doc_id, CAST(len(c) AS INTEGER) AS n_chunks, CAST(list_max(list_transform(c, lambda z: length(z))) AS INTEGER) AS longest FROM c""",
}
