"""Queries on answers, stages, lines, sources and streams."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, jsons, reasons, text
from ..operators import builders, layout, render, stages
from ..sources import html, mail
from ..streaming import landing
from . import pipeline
from . import sql as S
from . import table_sql as T
from .document_queries import docs, recovered, tabs
from .order_queries import _ITEMS, items
from .tables import table

_ANSWER = {
    "spark": "CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN concat('<think>{{\"k\": 1}}</think>Here: ', props, ' done') WHEN 2 THEN concat('```json\n', props, '\n```') ELSE concat('no object here ', event_id) END",
}


def json_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object in answers that wrap it in thoughts, fences and prose."""
    e = table(spark, sf_dir, "events").select("event_id", "props", F.expr(_ANSWER["spark"]).alias("answer"))
    return e.select("event_id", jsons.recover(F.col("answer")).alias("object"))


def stage_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = stages.batches(items(spark, sf_dir).select("doc_id", "ord", "slot_id"), "t_day")
    return b.groupBy("doc_id", "batch").agg(F.count(F.lit(1)).alias("n_items"))


def stage_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stage over all items with the deterministic backend: items out, and how many lack the stage's field."""
    i = items(spark, sf_dir).select("doc_id", "ord", "fund_code", "slot_id", "settle_class")
    out = stages.unpacked(stages.run_stage(i, "settle_class"), "ord string, fund_code string, slot_id string, settle_class string")
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"), F.count_if(F.col("settle_class").isNull()).alias("n_missing"))


def date_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that hold a date, with whether the line before, itself or the two after speak of a base date."""

    def found(lines: Column) -> Column:
        near = lambda i: F.exists(F.slice(lines, F.greatest(i, F.lit(1)), F.when(i > 0, 4).otherwise(3)), lambda x: x.rlike("기준일|Date:"))
        hits = F.filter(F.transform(lines, lambda x, i: F.struct((i + 1).alias("line_no"), F.regexp_extract(x, r"\d{4}-\d{2}-\d{2}", 0).alias("date"), i.alias("i"))), lambda h: h["date"] != "")
        return F.transform(hits, lambda h: F.struct(h["line_no"].alias("line_no"), h["date"].alias("date"), near(h["i"]).alias("near_label")))

    d = docs(spark, sf_dir).where("text IS NOT NULL")
    return d.select("doc_id", layout.posexplode(text.let(F.split("text", "\n"), found)).alias("p", "h")).where("p IS NOT NULL").select("doc_id", "h.*")


def bucket_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settlement bucket of every label, and the days ahead that it names."""
    t = table(spark, sf_dir, "resolved_items").where("evidence_label IS NOT NULL AND base_date IS NOT NULL").select("evidence_label", "base_date").distinct()
    label = F.concat("evidence_label", F.when(F.dayofmonth(F.to_date("base_date")) % 3 == 0, F.concat(F.lit(" ("), F.month(F.date_add(F.to_date("base_date"), 2)).cast("string"), F.lit("월 "), F.dayofmonth(F.date_add(F.to_date("base_date"), 2)).cast("string"), F.lit("일)"))).otherwise(""))
    t = t.withColumn("label", label)
    return t.select("label", "base_date", dates.bucket_key(F.col("label"), F.lit(3)).alias("bucket"), dates.days_ahead(F.col("label"), F.col("base_date")).alias("days"))


def html_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables written as HTML and read back: cells that survive, per document."""
    r = layout.raw_rows(layout.sections(docs(spark, sf_dir)))
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<html><body><table>"), F.array_join(F.transform("rows", lambda row: F.concat(F.lit("<tr><td>"), F.array_join(F.transform(row, esc), "</td><td>"), F.lit("</td></tr>"))), ""), F.lit("</table></body></html>"))

    @F.pandas_udf("array<string>")
    def read(pages):
        return pages.map(lambda p: [c.text for b in html.blocks(p) for row in b.rows for c in row])

    width = F.array_max(F.transform("rows", F.size))
    want = F.flatten(F.transform("rows", lambda row: F.concat(F.transform(row, lambda c: text.squeeze(c)), F.array_repeat(F.lit(""), width - F.size(row)))))
    x = r.select("doc_id", want.alias("want"), read(page).alias("got"))
    return x.groupBy("doc_id").agg(F.sum(F.size("want")).alias("n_cells"), F.sum(F.when(F.col("want") == F.col("got"), F.size("want")).otherwise(F.size(F.filter(F.zip_with("want", "got", lambda a, b: F.when(a == b, 1)), lambda v: v.isNotNull())))).alias("n_same"))


def mail_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails rebuilt as MIME messages and read by the mail source: their day in Seoul, beside the one written."""
    p = table(spark, sf_dir, "task_payloads").where("content_type = 'message/rfc822' AND raw_text IS NOT NULL").select("payload_id", "file_name", "raw_text")

    @F.pandas_udf("string")
    def day(texts):
        def one(t):
            for line in mail.read_eml(mail.rebuild(t), "").split("\n"):
                if not line or line.startswith("Date (Asia/Seoul): "):
                    return line[19:] or None
            return None

        return texts.map(one)

    return p.select("payload_id", day("raw_text").alias("day"), text.blank_to_null(F.regexp_extract("raw_text", r"(?md)^Date \(Asia/Seoul\): (\d{4}-\d{2}-\d{2})$", 1)).alias("written_day"))


def _scratch(spark: SparkSession) -> str:
    """A new folder below the one that all executors share; a session on one machine without one gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="orderloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"


def stream_first_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_extractions as a stream, equal orders once: a count per settlement class."""
    out = _scratch(spark)
    first = landing.first_orders(landing.table_stream(spark, sf_dir, "order_extractions"), delay=None)
    landing.drain(first.select("settle_class", "order_type"), f"{out}/rows", f"{out}/state")
    return spark.read.parquet(f"{out}/rows").groupBy("settle_class", "order_type").agg(F.count(F.lit(1)).alias("n"))


def stream_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per type and day as a stream, the last days included."""
    out = _scratch(spark)
    landing.drain_whole(landing.windowed_counts(landing.table_stream(spark, sf_dir, "events"), "ts", "event_type", delay=None), f"{out}/rows", f"{out}/state")
    return spark.read.parquet(f"{out}/rows")


def document_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole path over task_payloads.raw_text."""
    return pipeline.document_orders(docs(spark, sf_dir))


def blocking_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the payloads whose runs report no blocking issue."""
    p = table(spark, sf_dir, "document_payloads")
    issues = p.select(F.col("payload_id").alias("doc_id"), F.explode("issues").alias("issue"))
    o = table(spark, sf_dir, "order_extractions").select(F.col("payload_id").alias("doc_id"), "order_id")
    return pipeline.gated(o, issues)


def table_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each label heads a column, and what it stands for, over all tables."""
    z = tabs(spark, sf_dir).select(layout.posexplode("classes").alias("c", "z")).where("c IS NOT NULL")
    return z.groupBy("z.label", "z.any", "z.net", "z.context", "z.identity", "z.strong", "z.mixed", "z.relevant").agg(F.count(F.lit(1)).alias("n"))


def reason_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which evidence each item's day, settlement, direction and amount come from, counted."""
    i = items(spark, sf_dir)
    d, s, a, e = (F.col(c) for c in ("t_day", "slot_id", "transfer_amount", "evidence_label"))
    r = i.select(reasons.slot_reason(d, s, e).alias("slot"), reasons.settle_reason(d, e).alias("settle"), reasons.type_reason(a, e).alias("type"), reasons.amount_reason(d, a, e).alias("amount"))
    return r.groupBy("slot", "settle", "type", "amount").agg(F.count(F.lit(1)).alias("n"))


def slot_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slots that tables give each fund: their names, by day and direction or net."""
    c = builders.cells_of(recovered(spark, sf_dir)).where("order_type IS NOT NULL AND t_day IS NOT NULL AND fund_code IS NOT NULL")
    return c.select("doc_id", "fund_code", reasons.slot_id(F.col("t_day"), reasons.slot_kind(F.col("order_type"), F.col("signed"))).alias("slot_id")).distinct()


def document_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.document_markdown(docs(spark, sf_dir))


def markdown_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which classes of its tables' tokens a document's stored structured text lacks."""
    p = table(spark, sf_dir, "task_payloads").where("markdown_text IS NOT NULL").select(F.col("payload_id").alias("doc_id"), "markdown_text", (F.col("content_type") == "text/html").alias("html"))
    j = p.join(render.audit_of(tabs(spark, sf_dir)), "doc_id", "left")
    return j.select("doc_id", F.array_join(render.loss_reasons(F.col("markdown_text"), F.col("audit"), F.coalesce("html", F.lit(False))), "|").alias("reasons"))


def model_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that a model is given for each document: its length, and whether the structured part comes back."""
    p = table(spark, sf_dir, "task_payloads").where("markdown_text IS NOT NULL").select("payload_id", "markdown_text", render.model_context(F.col("markdown_text"), F.col("raw_text")).alias("c"))
    return p.select("payload_id", F.length("c").alias("n_chars"), (render.structured_view(F.col("c")) == F.col("markdown_text")).alias("same"))


def stage_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage items once each, reasons aside: how many of each document."""
    return stages.distinct_items(items(spark, sf_dir)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"), F.count("reason_code").alias("n_reasons"))


def stale_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of items of one fund, date and label the best; those that tie are told."""
    i = items(spark, sf_dir).withColumn("fund", F.coalesce(text.squeeze(F.col("fund_code")), F.lit("")))
    best = stages.settled_slots(i.select("doc_id", "fund", "base_date", "evidence_label", "ord", "t_day", "slot_id", "transfer_amount", "settle_class", "order_type"), ["doc_id", "fund", "base_date"])
    return best.select("doc_id", "fund", "base_date", "evidence_label", "ord", "tied")


def retry_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the deterministic stage changes of the items that it gets, by kind of change."""
    i = items(spark, sf_dir).select("doc_id", "ord", "slot_id", "settle_class").distinct()
    out = stages.unpacked(stages.run_stage(i, "settle_class"), "ord string, slot_id string, settle_class string")
    return stages.compared(i, out, ["doc_id", "ord"], ["slot_id", "settle_class"]).groupBy("doc_id", "delta").agg(F.count(F.lit(1)).alias("n"))


def slots_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose items fill exactly the slots that their tables give."""
    i = items(spark, sf_dir).select("doc_id", F.coalesce(text.squeeze(F.col("fund_code")), F.lit("")).alias("fund"), "t_day", F.regexp_extract(F.coalesce("slot_id", F.lit("")), "_(.*)", 1).alias("kind")).distinct()
    c = builders.cells_of(recovered(spark, sf_dir)).where("order_type IS NOT NULL AND t_day IS NOT NULL AND fund_code IS NOT NULL")
    e = c.select("doc_id", F.col("fund_code").alias("fund"), "t_day", reasons.slot_kind(F.col("order_type"), F.col("signed")).alias("kind")).distinct()
    return stages.complete_slots(i, e, ["fund"])


QUERIES = {
    f.__name__: f
    for f in (json_recover, stage_batches, stage_settle, date_context, bucket_keys, html_round_trip, mail_headers, stream_first_orders, stream_event_counts, document_orders, blocking_gate, table_roles, reason_kinds, slot_names, document_markdown, markdown_audit, model_contexts, stage_distinct, stale_siblings, retry_delta, slots_complete)
}
SQL = {
    "json_recover": "SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN props END AS object FROM events",
    "stage_batches": "WITH r AS (SELECT payload_id AS doc_id, count(*) OVER (PARTITION BY payload_id) AS n, row_number() OVER (PARTITION BY payload_id) AS i FROM resolved_items) SELECT doc_id, CAST(floor((i - 1) / CASE WHEN n > 6 THEN 6 ELSE 12 END) AS INTEGER) AS batch, count(*) AS n_items FROM r GROUP BY 1, 2",
    "stage_settle": "SELECT payload_id AS doc_id, count(*) AS n_items, count(*) FILTER (settle_class IS NULL AND slot_id NOT LIKE 'T%') AS n_missing FROM resolved_items GROUP BY 1",
    "date_context": r"WITH l AS (SELECT payload_id AS doc_id, unnest(string_split(raw_text, chr(10))) AS line, generate_subscripts(string_split(raw_text, chr(10)), 1) AS line_no FROM task_payloads WHERE raw_text IS NOT NULL), w AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, regexp_extract(line, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AS date, bool_or(regexp_matches(line, '기준일|Date:')) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS near_label FROM l) SELECT * FROM w WHERE date <> ''",
    "mail_headers": r"SELECT payload_id, nullif(regexp_extract(raw_text, '(?m)^Date \(Asia/Seoul\): ([0-9]{4}-[0-9]{2}-[0-9]{2})$', 1), '') AS day, nullif(regexp_extract(raw_text, '(?m)^Date \(Asia/Seoul\): ([0-9]{4}-[0-9]{2}-[0-9]{2})$', 1), '') AS written_day FROM task_payloads WHERE content_type = 'message/rfc822' AND raw_text IS NOT NULL",
    "blocking_gate": f"SELECT payload_id AS doc_id, order_id FROM order_extractions o WHERE NOT EXISTS (SELECT 1 FROM (SELECT payload_id AS p, unnest(issues) AS issue FROM document_payloads) WHERE p = o.payload_id AND regexp_extract(issue, '^[A-Z_]+') IN ({', '.join(repr(x) for x in S.BLOCKING)}))",
    "table_roles": f"WITH {T.GRID}, {T.LABELS} SELECT label, pays AS \"any\", net, context, identity, strong, mixed, relevant, count(*) AS n FROM col GROUP BY ALL",
    "document_orders": f"WITH {T.TABLE_ORDERS} SELECT DISTINCT doc_id, fund_code, fund_name, {S.output_codes('settle_class', 'order_type', 't_day')}, base_date, {S.output_amount('transfer_amount', 'order_type')} AS transfer_amount FROM tor",
    "stream_event_counts": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_first_orders": f"""WITH m AS (SELECT *, {S.output_codes("settle_class", "order_type", "t_day").replace(" AS settle_class", " AS s").replace(" AS order_type", " AS k").replace(" AS t_day", " AS d")}, {S.output_amount("transfer_amount", "order_type")} AS e FROM order_extractions),
o AS (SELECT DISTINCT coalesce(trim(fund_code), ''), coalesce(trim(fund_name), ''), s AS settle_class, k AS order_type, coalesce(trim(base_date), ''), coalesce(trim(d), ''), coalesce({S.canonical("e")}, trim(e), '') FROM m)
SELECT settle_class, order_type, count(*) AS n FROM o GROUP BY 1, 2""",
    "bucket_keys": r"""WITH t AS (SELECT DISTINCT evidence_label, base_date, TRY_CAST(base_date AS DATE) AS b FROM resolved_items WHERE evidence_label IS NOT NULL AND base_date IS NOT NULL),
l AS (SELECT DISTINCT concat(evidence_label, CASE WHEN day(b) % 3 = 0 THEN concat(' (', month(b + 2), '월 ', day(b + 2), '일)') ELSE '' END) AS label, base_date, b FROM t),
m AS (SELECT *, lower(label) AS low, TRY_CAST(regexp_extract(label, '(?i)t\s*\+\s*([0-9]+)', 1) AS INTEGER) AS plus, TRY_CAST(regexp_extract(label, '([0-9]{1,2})\s*월\s*[0-9]{1,2}\s*일', 1) AS INTEGER) AS mm, TRY_CAST(regexp_extract(label, '[0-9]{1,2}\s*월\s*([0-9]{1,2})\s*일', 1) AS INTEGER) AS dd FROM l)
SELECT label, base_date, CASE WHEN plus IS NOT NULL THEN concat('T+', plus) WHEN contains(low, '익영업일') THEN concat('T+', 1) WHEN mm IS NOT NULL THEN concat('M', lpad(CAST(mm AS VARCHAR), 2, '0'), 'D', lpad(CAST(dd AS VARCHAR), 2, '0'))
 WHEN regexp_matches(low, '당일|확정|실행|설정금액|해지금액|입금액|출금액|투입금액|인출금액|순유입|순투입|결제금액|buy|sell|settlement amount|execution amount|subscription|redemption') THEN 'T0' ELSE 'COL_3' END AS bucket,
 CASE WHEN plus IS NOT NULL THEN plus WHEN mm IS NOT NULL THEN CAST(date_diff('day', b, make_date(year(b), mm, dd)) AS INTEGER) END AS days FROM m""",
    "reason_kinds": f"""WITH {_ITEMS}, l AS (SELECT t_day, coalesce(slot_id, '') AS slot_id, lower(coalesce({S.squeeze("evidence_label")}, '')) AS e, coalesce({S.canonical("transfer_amount")}, '') AS a FROM i),
m AS (SELECT *, regexp_matches(e, '예정|청구|예상|t\\+|익+영업일|제\\s*[0-9]+\\s*영업일|[0-9]{{1,2}}\\s*월\\s*[0-9]{{1,2}}\\s*일|[0-9]{{1,2}}[/-][0-9]{{1,2}}') AS sched, regexp_matches(e, '익+영업일|제\\s*[0-9]+\\s*영업일') AS biz, {T.words("e", "순유입", "순투입", "증감금액", "증감액", "펀드계", "정산액", "당일이체금액", "이체예상금액", "이체예정금액", "실행금액", "결제금액", "execution", "settlement amount")} AS net,
 CASE WHEN {T._meta.replace("(low,", "(e,")} THEN NULL ELSE {T.direction("e")} END AS way, {T.words("e", "설정금액", "해지금액", "입금액", "출금액", "투입금액", "인출금액", "buy", "sell", "subscription", "redemption")} AS expl FROM l)
SELECT CASE WHEN t_day >= 1 THEN CASE WHEN biz THEN 'SLOT_BUSINESS_DAY_HEADER' ELSE 'SLOT_TPLUS_SCHEDULE' END WHEN net OR suffix(slot_id, '_NET') THEN 'SLOT_T0_NET' WHEN way IS NOT NULL THEN concat('SLOT_T0_EXPLICIT_', way) ELSE 'SLOT_OTHER_VERIFIED' END AS slot,
 CASE WHEN sched THEN CASE WHEN biz THEN 'SETTLE_BUSINESS_DAY_HEADER' ELSE 'SETTLE_FUTURE_LABEL' END WHEN {T.words("e", "정산액", "결제금액", "실행금액", "execution", "settlement", "결제일", "processed")} THEN 'SETTLE_PROCESSED_RESULT' WHEN {T.words("e", "당일", "확정", "설정금액", "해지금액", "입금액", "출금액", "buy", "sell", "subscription", "redemption")} THEN 'SETTLE_SAME_DAY_LABEL' WHEN t_day IS NOT NULL THEN 'SETTLE_TDAY_FALLBACK' ELSE 'SETTLE_OTHER_VERIFIED' END AS settle,
 CASE WHEN starts_with(a, '-') THEN 'ORDER_SIGN_NEGATIVE' WHEN way IS NOT NULL THEN concat('ORDER_LABEL_', way) WHEN contains(e, 'transaction type') OR contains(e, 'buy&sell') OR e = '구분' THEN 'ORDER_TRANSACTION_TYPE' ELSE 'ORDER_OTHER_VERIFIED' END AS type,
 CASE WHEN net THEN 'AMOUNT_NET_COLUMN' WHEN t_day >= 1 OR sched THEN 'AMOUNT_SCHEDULE_BUCKET' WHEN way IS NOT NULL THEN concat('AMOUNT_EXPLICIT_', way) WHEN starts_with(a, '-') THEN 'AMOUNT_SIGNED_OUTFLOW' ELSE 'AMOUNT_OTHER_VERIFIED' END AS amount, count(*) AS n FROM m GROUP BY 1, 2, 3, 4""",
    "slot_names": f"WITH {T.UNPIVOT} SELECT DISTINCT doc_id, fund_code, concat('T', t_day, '_', CASE WHEN signed THEN 'NET' ELSE order_type END) AS slot_id FROM am WHERE order_type IS NOT NULL AND fund_code IS NOT NULL",
    "model_contexts": "SELECT payload_id, CAST(length(markdown_text) + CASE WHEN coalesce(raw_text, '') = '' THEN 0 ELSE 31 + CASE WHEN length(raw_text) > 14000 THEN 14005 ELSE length(raw_text) END END AS INTEGER) AS n_chars, true AS same FROM task_payloads WHERE markdown_text IS NOT NULL",
    "stage_distinct": f"WITH {_ITEMS}, d AS (SELECT doc_id, fund_code, fund_name, base_date, t_day, slot_id, evidence_label, transfer_amount, settle_class, order_type, count(reason_code) > 0 AS has FROM i GROUP BY ALL) SELECT doc_id, count(*) AS n_items, count(*) FILTER (has) AS n_reasons FROM d GROUP BY doc_id",
    "stale_siblings": f"""WITH {_ITEMS}, s AS (SELECT *, coalesce({S.squeeze("fund_code")}, '') AS fund, [coalesce((regexp_extract(coalesce(evidence_label, ''), '(?i)t\\s*\\+\\s*([0-9]+)', 1) = CAST(t_day AS VARCHAR))::INT, -1), (transfer_amount IS NOT NULL)::INT, coalesce(starts_with(slot_id, concat('T', CAST(t_day AS VARCHAR), '_')) AND t_day IS NOT NULL, false)::INT, (t_day IS NOT NULL)::INT + (slot_id IS NOT NULL)::INT + (transfer_amount IS NOT NULL)::INT + (settle_class IS NOT NULL)::INT + (order_type IS NOT NULL)::INT] AS sc FROM i),
m AS (SELECT *, max(sc) OVER (PARTITION BY doc_id, fund, base_date, evidence_label) AS top FROM s) SELECT doc_id, fund, base_date, evidence_label, min(ord) AS ord, count(*) > 1 AS tied FROM m WHERE sc = top GROUP BY doc_id, fund, base_date, evidence_label""",
    "retry_delta": f"WITH {_ITEMS}, d AS (SELECT DISTINCT doc_id, ord, slot_id, settle_class FROM i) SELECT doc_id, CASE WHEN settle_class IS NULL AND starts_with(slot_id, 'T') THEN 'filled' ELSE 'same' END AS delta, count(*) AS n FROM d GROUP BY 1, 2",
    "slots_complete": f"""WITH {T.UNPIVOT}, {_ITEMS}, a AS (SELECT DISTINCT doc_id, coalesce({S.squeeze("fund_code")}, '') AS fund, t_day, regexp_extract(coalesce(slot_id, ''), '_(.*)', 1) AS kind FROM i), b AS (SELECT DISTINCT doc_id, fund_code AS fund, t_day, CASE WHEN signed THEN 'NET' ELSE order_type END AS kind FROM am WHERE order_type IS NOT NULL AND fund_code IS NOT NULL),
n AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AS both_have FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.fund IS NOT DISTINCT FROM b.fund AND a.t_day IS NOT DISTINCT FROM b.t_day AND a.kind IS NOT DISTINCT FROM b.kind) SELECT doc_id, bool_and(both_have) AS complete FROM n GROUP BY doc_id""",
    "html_round_trip": f"WITH {T.CELLS}, w AS (SELECT doc_id, section_no, block_no, max(row_no) * max(col_no) AS n FROM cel GROUP BY ALL) SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_cells, CAST(sum(n) AS BIGINT) AS n_same FROM w GROUP BY doc_id",
    "markdown_audit": f"""WITH {T.BODY}, md AS (SELECT payload_id AS doc_id, markdown_text AS m, coalesce(content_type = 'text/html', false) AS html FROM task_payloads WHERE markdown_text IS NOT NULL),
kr AS (SELECT b.doc_id, b.section_no, b.block_no, b.row_no, concat('| ', string_agg(replace(d.v, '|', '\\|'), ' | ' ORDER BY d.col_no), ' |') AS line, bool_or(d.own <> d.v) AS inherited, arg_min(d.v, d.col_no) FILTER (lower(regexp_replace(d.v, '[^0-9a-z가-힣]+', '', 'g')) IN ('입금', '출금', '환매신청', '설정', '해지')) AS kind, max(CASE WHEN d.col_no = c.code_at THEN nullif(d.v, '') END) AS code
 FROM bro b JOIN bod d USING (doc_id, section_no, block_no, row_no) JOIN cat c USING (doc_id, section_no, block_no) WHERE b.kept GROUP BY b.doc_id, b.section_no, b.block_no, b.row_no),
co AS (SELECT doc_id, list(code ORDER BY p) AS codes FROM (SELECT doc_id, code, min((section_no, block_no, row_no)) AS p FROM kr WHERE code IS NOT NULL GROUP BY doc_id, code) GROUP BY doc_id),
la AS (SELECT md.doc_id, bool_or(trim(h.label) <> '' AND NOT contains(md.m, trim(h.label))) AS l FROM md JOIN hdr h USING (doc_id) GROUP BY md.doc_id),
ra AS (SELECT md.doc_id, bool_or(NOT contains(md.m, line)) AS r, bool_or(inherited AND NOT contains(md.m, line)) AS i, coalesce(bool_or(NOT contains(md.m, trim(kind))), false) AS k FROM md JOIN kr USING (doc_id) GROUP BY md.doc_id),
ca AS (SELECT md.doc_id, len(list_filter(CASE WHEN len(codes) <= 3 THEN codes ELSE [codes[1], codes[len(codes) // 2 + 1], codes[len(codes)]] END, lambda z: NOT contains(md.m, trim(z)))) > 0 AS c FROM md JOIN co USING (doc_id))
SELECT md.doc_id, CASE WHEN la.doc_id IS NULL THEN CASE WHEN md.html THEN 'html_markdown_unverified' ELSE '' END ELSE concat_ws('|', CASE WHEN l THEN 'html_label_missing' END, CASE WHEN r THEN 'html_table_shape_collapsed' END, CASE WHEN i THEN 'html_inherited_context_missing' END, CASE WHEN k THEN 'html_row_kind_missing' END, CASE WHEN c THEN 'html_fund_code_missing' END) END AS reasons
 FROM md LEFT JOIN la USING (doc_id) LEFT JOIN ra USING (doc_id) LEFT JOIN ca USING (doc_id)""",
}
