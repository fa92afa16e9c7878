"""Queries on evidence and orders: resolved_items, order_extractions, document_payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import amounts, dates, labels, text
from ..operators import merge, orders
from . import sql as S
from .tables import table

_ORD = ["slot_id", "evidence_label", "transfer_amount", "settle_class", "order_type", "t_day", "base_date", "fund_code", "fund_name", "reason_code"]


def _stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """resolved_items as stage items; the ordinal is the staging time and then the row's own text."""
    t = table(spark, sf_dir, "resolved_items")
    return t.select(
        F.col("payload_id").alias("doc_id"),
        F.concat_ws("|", _stamp("staged_at"), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _ORD)).alias("ord"),
        "fund_code", "fund_name", "base_date", "t_day", "slot_id", "evidence_label", "transfer_amount", "settle_class", "order_type", "reason_code",
    )


_ITEMS = f"""i AS (SELECT payload_id AS doc_id, concat_ws('|', strftime(staged_at, '%Y-%m-%d %H:%M:%S.%f'), {", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in _ORD)}) AS ord,
 fund_code, fund_name, base_date, t_day, slot_id, evidence_label, transfer_amount, settle_class, order_type, reason_code FROM resolved_items)"""
_CANDIDATES = f"""{_ITEMS},
n AS (SELECT doc_id, ord, slot_id, coalesce({S.squeeze("fund_code")}, '') AS fund_code, coalesce({S.squeeze("fund_name")}, '') AS fund_name, {S.normalize_date("base_date")} AS base_date, t_day,
 {S.squeeze("coalesce(evidence_label, '')")} AS evidence_label, transfer_amount, {S.canonical("transfer_amount")} AS canonical,
 {S.settle_class("settle_class", "t_day", "evidence_label")} AS settle_class, {S.order_type("order_type", "transfer_amount", "evidence_label")} AS order_type, {S.evidence_kind("evidence_label")} AS evidence_kind FROM i),
c AS (SELECT *, {S.signed("transfer_amount", "order_type")} AS signed, fund_code AS id_code, CASE WHEN fund_code = '' THEN fund_name ELSE '' END AS id_name,
 CASE WHEN fund_code = '' OR fund_name = '' THEN 'FUND_METADATA_INCOMPLETE' WHEN {S.contains_any("lower(evidence_label)", S.NON_AMOUNT)} THEN 'NON_AMOUNT_EVIDENCE_DROPPED' WHEN canonical IS NULL THEN 'TRANSFER_AMOUNT_MISSING'
 WHEN canonical = '0' THEN 'ZERO_AMOUNT' WHEN settle_class IS NULL THEN 'SETTLE_CLASS_MISSING' WHEN order_type IS NULL THEN 'ORDER_TYPE_MISSING' END AS drop_reason FROM n)"""
_KEYS = "doc_id, id_code, id_name, settle_class, base_date, t_day"
_DEDUPED = f"""{_CANDIDATES},
d AS (SELECT {_KEYS}, order_type, canonical, evidence_label, evidence_kind, min(ord) AS ord, arg_min(signed, ord) AS signed, arg_min(fund_code, ord) AS fund_code, arg_min(fund_name, ord) AS fund_name
 FROM c WHERE drop_reason IS NULL GROUP BY {_KEYS}, order_type, canonical, evidence_label, evidence_kind)"""
_ORDERS = f"""{_DEDUPED},
f AS (SELECT *, min(CASE WHEN evidence_kind <> 'execution' THEN order_type END) OVER w AS t1, max(CASE WHEN evidence_kind <> 'execution' THEN order_type END) OVER w AS t2, bool_or(evidence_kind = 'execution') OVER w AS has_net
 FROM d WINDOW w AS (PARTITION BY {_KEYS})),
s AS (SELECT *, CASE WHEN t1 < t2 AND NOT has_net THEN order_type ELSE '' END AS side FROM f),
g AS (SELECT {_KEYS}, side, list(DISTINCT signed) FILTER (evidence_kind = 'execution') AS nets, arg_min(signed, ord) FILTER (evidence_kind = 'execution') AS net_first, sum(signed) FILTER (evidence_kind <> 'execution') AS explicit_sum,
 arg_min(fund_code, ord) AS fund_code, arg_min(fund_name, ord) AS fund_name, min(ord) AS ord FROM s GROUP BY {_KEYS}, side),
a AS (SELECT *, CASE WHEN nets IS NULL THEN explicit_sum WHEN len(nets) = 1 THEN nets[1] WHEN list_contains(nets, explicit_sum) THEN explicit_sum ELSE net_first END AS amount,
 coalesce(len(nets) > 1 AND NOT coalesce(list_contains(nets, explicit_sum), false), false) AS conflict FROM g),
o AS (SELECT doc_id, ord, fund_code, CASE WHEN regexp_full_match(fund_name, '[^\\s0-9/][^0-9/]* / [^\\s0-9/][^0-9/]*') THEN replace(fund_name, ' / ', ' ') ELSE fund_name END AS fund_name, settle_class,
 CASE WHEN amount < 0 THEN 'RED' ELSE 'SUB' END AS order_type, base_date, t_day, {S.render(S.snap("CAST(amount AS DECIMAL(38,10))"))} AS transfer_amount, conflict FROM a WHERE amount <> 0)"""


def candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = orders.candidates(items(spark, sf_dir))
    return c.select("doc_id", "ord", "id_code", "id_name", "base_date", "t_day", "settle_class", "order_type", "evidence_kind", "canonical", "drop_reason")


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders.live(orders.candidates(items(spark, sf_dir)))


def evidence_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders.dedupe_evidence(_live(spark, sf_dir)).select(*orders.BUCKET, "order_type", "canonical", "evidence_label", "evidence_kind", "ord")


def candidate_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders.aggregate(_live(spark, sf_dir)).drop("ord")


def net_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose evidence, every label read as one of net amounts, contradicts itself within a bucket."""
    net = items(spark, sf_dir).withColumn("evidence_label", F.lit("정산액"))
    return orders.aggregate(orders.live(orders.candidates(net))).where("conflict").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_conflicts"))


def drop_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = orders.candidates(items(spark, sf_dir)).where("drop_reason IS NOT NULL")
    return c.groupBy("doc_id", "drop_reason").agg(F.count(F.lit(1)).alias("n_rows"))


def order_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a document by their full signature, the first kept."""
    c = _live(spark, sf_dir).select("doc_id", *orders.FUND, "base_date", "t_day", "settle_class", "order_type", "canonical", "ord", "fund_name")
    return orders.dedupe_orders(c, ["doc_id", *orders.FUND, "base_date", "t_day", "settle_class", "order_type", "canonical"])


def direction_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _live(spark, sf_dir).withColumn("unsigned", amounts.unsigned(F.col("transfer_amount")))
    return orders.direction_hints(c, ["doc_id", "id_code", "unsigned"])


def output_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of resolved_items in output codes: the whole path from evidence to rows."""
    return orders.output_form(orders.aggregate(_live(spark, sf_dir)).drop("ord", "conflict"))


def only_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders.output_form(orders.only_pending(orders.aggregate(_live(spark, sf_dir))).drop("ord", "conflict"))


def sort_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders.output_form(orders.aggregate(_live(spark, sf_dir)).drop("conflict"))
    return orders.sort_position(o, ["doc_id"]).select("doc_id", "fund_code", "order_type", "transfer_amount", "position")


def amount_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("transfer_amount")
    t = table(spark, sf_dir, "order_extractions").where("transfer_amount IS NOT NULL")
    return t.select("order_id", amounts.canonical(c).alias("canonical"), amounts.source(c).alias("source"), amounts.plain(c).alias("plain"), amounts.unsigned(c).alias("unsigned"))


def contract_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders.output_form(table(spark, sf_dir, "order_extractions").select("order_id", *orders.OUTPUT))


_UNIT_TEXT = "concat(CASE p_partkey % 3 WHEN 0 THEN 'KRW ' WHEN 1 THEN '₩' ELSE '' END, CAST(p_size AS {0}), CASE p_partkey % 5 WHEN 0 THEN '.5억' WHEN 1 THEN '만' WHEN 2 THEN '천원' WHEN 3 THEN '억5천' ELSE ' 원' END)"


def amount_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").select("p_partkey", F.expr(_UNIT_TEXT.format("STRING")).alias("cell"))
    return t.select("p_partkey", "cell", amounts.document_number(F.col("cell")).cast("decimal(18,2)").cast("string").alias("number"), amounts.is_zero(F.col("cell")).alias("zero"))


_DATE_TEXT = {
    "spark": "CASE o_orderkey % 5 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'yyyyMMdd') WHEN 2 THEN date_format(o_orderdate, 'yyyy.M.d') WHEN 3 THEN date_format(o_orderdate, 'MM-dd-yyyy') ELSE date_format(o_orderdate, 'd-MMM-yy') END",
    "duck": "CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y%m%d') WHEN 2 THEN strftime(o_orderdate, '%Y.%-m.%-d') WHEN 3 THEN strftime(o_orderdate, '%m-%d-%Y') ELSE strftime(o_orderdate, '%-d-%b-%y') END",
}


def date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_DATE_TEXT["spark"]).alias("written"))
    return t.select("o_orderkey", "written", dates.normalize(F.col("written")).alias("normal"), dates.typed(dates.normalize(F.col("written"))).isNotNull().alias("valid"))


def label_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("evidence_label")
    t = table(spark, sf_dir, "resolved_items").where("evidence_label IS NOT NULL").groupBy("evidence_label").agg(F.count(F.lit(1)).alias("n"))
    return t.select("evidence_label", "n", labels.direction(c).alias("direction"), labels.evidence_kind(c).alias("kind"), labels.is_schedule(c).alias("schedule"), labels.is_non_amount(c).alias("non_amount"))


def settle_and_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settlement and direction where the label alone, or the day and the sign alone, must tell."""
    t = table(spark, sf_dir, "resolved_items").groupBy("evidence_label", "t_day", "settle_class", "order_type").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("string")
    return t.select(
        "evidence_label", "t_day", F.col("settle_class").alias("given_settle"), F.col("order_type").alias("given_type"), "n",
        labels.settle_class(F.col("settle_class"), F.col("t_day"), F.col("evidence_label")).alias("settle"),
        labels.settle_class(none, F.col("t_day"), none).alias("settle_by_day"),
        labels.order_type(F.col("order_type"), none, F.col("evidence_label")).alias("type"),
    )


def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "funds")
    return t.select("fund_id", text.name_key(F.col("fund_name")).alias("key"), text.compact(F.col("fund_name")).alias("compact"), text.squeeze(F.col("manager_name")).alias("manager"))


def reason_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "resolved_items").groupBy(text.reason_code(F.concat(F.lower("reason_code"), F.lit(" - "), F.coalesce("slot_id", F.lit("")))).alias("code"))
    return t.agg(F.count(F.lit(1)).alias("n"))


def payload_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output orders of each document, equal ones once, with the number of copies."""
    return merge.dedupe_within(merge.exploded(table(spark, sf_dir, "document_payloads"))).select("payload_id", *orders.OUTPUT, "copies")


def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.latest(table(spark, sf_dir, "document_payloads")).select("payload_id", "run_no", "status", "base_date", F.size("orders").alias("n_orders"))


def merge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders over all documents, equal ones once, with the first document that holds each."""
    return merge.merged(merge.latest(table(spark, sf_dir, "document_payloads"))).select(*orders.OUTPUT, "first_payload", "first_file", "copies")


def merged_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.summary(merge.latest(table(spark, sf_dir, "document_payloads")))


def flat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.flat(merge.latest(table(spark, sf_dir, "document_payloads")))


def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = merge.latest(table(spark, sf_dir, "document_payloads"))
    return t.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n_documents"))


def first_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.first_dates(merge.latest(table(spark, sf_dir, "document_payloads")))


_LATEST = """l AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY payload_id ORDER BY run_no DESC, finished_at DESC) AS rn FROM document_payloads) WHERE rn = 1)"""
_FLAT_SQL = """x AS (SELECT payload_id, run_no, file_name, source_path, model_name, base_date AS document_base_date, issues, i AS ord, orders[i] AS o FROM (SELECT *, unnest(generate_series(1, len(orders))) AS i FROM {0}))"""
_OUT_IDS = ", ".join(f"coalesce(trim(o.{c}), '') AS i_{c}" for c in orders.OUTPUT[:-1]) + f", coalesce({S.canonical('o.transfer_amount')}, trim(o.transfer_amount), '') AS i_amount"
_O_COLS = ", ".join(f"arg_min(o, k).{c} AS {c}" for c in orders.OUTPUT[:-1]) + ", arg_min(o, k).transfer_amount AS transfer_amount"
_RUN_KEY = "printf('%012d|%06d|%06d', payload_id, run_no, ord)"

QUERIES = {
    f.__name__: f
    for f in (
        candidate_rows, evidence_dedupe, candidate_aggregate, net_conflict, drop_issues, order_dedupe, direction_hints, output_orders, only_pending, sort_positions,
        amount_forms, contract_codes, amount_units, date_forms, label_classes, settle_and_type, name_keys, reason_codes,
        payload_dedupe, latest_runs, merge_documents, merged_payload, flat_rows, issue_counts, first_dates,
    )
}

_FORM = f"fund_code, fund_name, {S.output_codes('settle_class', 'order_type', 't_day')}, base_date, {S.output_amount('transfer_amount', 'order_type')} AS transfer_amount"
SQL = {
    "candidate_rows": f"WITH {_CANDIDATES} SELECT doc_id, ord, id_code, id_name, base_date, t_day, settle_class, order_type, evidence_kind, canonical, drop_reason FROM c",
    "evidence_dedupe": f"WITH {_DEDUPED} SELECT {_KEYS}, order_type, canonical, evidence_label, evidence_kind, ord FROM d",
    "candidate_aggregate": f"WITH {_ORDERS} SELECT * EXCLUDE (ord) FROM o",
    "net_conflict": f"WITH {_ORDERS.replace('slot_id, evidence_label, transfer_amount, settle_class, order_type, reason_code FROM resolved_items', chr(39) + '정산액' + chr(39) + ' AS evidence_label, slot_id, transfer_amount, settle_class, order_type, reason_code FROM resolved_items')} SELECT doc_id, count(*) AS n_conflicts FROM o WHERE conflict GROUP BY doc_id",
    "drop_issues": f"WITH {_CANDIDATES} SELECT doc_id, drop_reason, count(*) AS n_rows FROM c WHERE drop_reason IS NOT NULL GROUP BY doc_id, drop_reason",
    "order_dedupe": f"WITH {_CANDIDATES} SELECT doc_id, id_code, id_name, base_date, t_day, settle_class, order_type, canonical, min(ord) AS ord, arg_min(fund_name, ord) AS fund_name FROM c WHERE drop_reason IS NULL GROUP BY ALL",
    "direction_hints": f"WITH {_CANDIDATES} SELECT doc_id, id_code, ltrim(canonical, '+-') AS unsigned, min(order_type) AS order_type FROM c WHERE drop_reason IS NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT order_type) = 1",
    "output_orders": f"WITH {_ORDERS} SELECT doc_id, {_FORM} FROM o",
    "only_pending": f"WITH {_ORDERS} SELECT doc_id, {_FORM} FROM (SELECT * REPLACE ('PENDING' AS settle_class) FROM o WHERE settle_class = 'CONFIRMED')",
    "sort_positions": f"""WITH {_ORDERS}, e AS (SELECT doc_id, ord, {_FORM} FROM o)
SELECT doc_id, fund_code, order_type, transfer_amount, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN settle_class = '2' THEN 0 ELSE 1 END, CASE WHEN order_type = '3' THEN 0 ELSE 1 END,
 CASE WHEN regexp_full_match(trim(fund_code), '[0-9]+') THEN 0 ELSE 1 END, CASE WHEN regexp_full_match(trim(fund_code), '[0-9]+') THEN TRY_CAST(trim(fund_code) AS BIGINT) END NULLS FIRST, trim(fund_code), coalesce(t_day, ''), {S.parse("transfer_amount")}, ord) AS INTEGER) AS position FROM e""",
    "amount_forms": f"SELECT order_id, {S.canonical('transfer_amount')} AS canonical, {S.source('transfer_amount')} AS source, {S.render(S.snap(S.parse('transfer_amount')), False)} AS plain, ltrim({S.canonical('transfer_amount')}, '+-') AS \"unsigned\" FROM order_extractions WHERE transfer_amount IS NOT NULL",
    "contract_codes": f"SELECT order_id, {_FORM} FROM order_extractions",
    "amount_units": rf"""WITH c AS (SELECT p_partkey, {_UNIT_TEXT.format("VARCHAR")} AS cell FROM part),
t AS (SELECT *, regexp_replace(regexp_replace(cell, '[\s\p{{Z}}]+', '', 'g'), '(?i)KRW|[₩￦원]', '', 'g') AS t FROM c),
n AS (SELECT *, CASE WHEN regexp_full_match(t, '[+-]?[0-9][0-9,]*(\.[0-9]+)?[억만천]?') THEN CAST(TRY_CAST(regexp_replace(replace(t, ',', ''), '[억만천]$', '') AS DECIMAL(24,6)) * CASE regexp_extract(t, '[억만천]$') WHEN '억' THEN 100000000 WHEN '만' THEN 10000 WHEN '천' THEN 1000 ELSE 1 END AS DECIMAL(18,2)) END AS d FROM t)
SELECT p_partkey, cell, CAST(d AS VARCHAR) AS number, trim(cell) IN ('-', '--') OR coalesce(d, 1) = 0 AS zero FROM n""",
    "date_forms": f"WITH d AS (SELECT o_orderkey, {_DATE_TEXT['duck']} AS written FROM orders) SELECT o_orderkey, written, {S.normalize_date('written')} AS normal, TRY_CAST({S.normalize_date('written')} AS DATE) IS NOT NULL AS valid FROM d",
    "label_classes": f"SELECT evidence_label, n, {S.direction('evidence_label')} AS direction, {S.evidence_kind('evidence_label')} AS kind, {S.is_schedule('evidence_label')} AS schedule, {S.contains_any('lower(evidence_label)', S.NON_AMOUNT)} AS non_amount FROM (SELECT evidence_label, count(*) AS n FROM resolved_items WHERE evidence_label IS NOT NULL GROUP BY 1)",
    "settle_and_type": f"SELECT evidence_label, t_day, settle_class AS given_settle, order_type AS given_type, count(*) AS n, {S.settle_class('settle_class', 't_day', 'evidence_label')} AS settle, CASE WHEN t_day = 0 THEN 'CONFIRMED' WHEN t_day >= 1 THEN 'PENDING' END AS settle_by_day, {S.order_type('order_type', 'CAST(NULL AS VARCHAR)', 'evidence_label')} AS type FROM resolved_items GROUP BY evidence_label, t_day, settle_class, order_type",
    "name_keys": f"SELECT fund_id, {S.name_key('fund_name')} AS key, {S.compact('fund_name')} AS compact, {S.squeeze('manager_name')} AS manager FROM funds",
    "reason_codes": "SELECT nullif(substring(regexp_replace(regexp_replace(upper(trim(lower(reason_code) || ' - ' || coalesce(slot_id, ''))), '[^0-9A-Z가-힣]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 64), '') AS code, count(*) AS n FROM resolved_items GROUP BY 1",
    "payload_dedupe": f"WITH {_FLAT_SQL.format('document_payloads')}, y AS (SELECT *, {_RUN_KEY} AS k, {_OUT_IDS} FROM x) SELECT payload_id, {_O_COLS}, count(*) AS copies FROM y GROUP BY payload_id, {', '.join(f'i_{c}' for c in orders.OUTPUT[:-1])}, i_amount",
    "latest_runs": f"WITH {_LATEST} SELECT payload_id, run_no, status, base_date, CAST(len(orders) AS INTEGER) AS n_orders FROM l",
    "merge_documents": f"WITH {_LATEST}, {_FLAT_SQL.format('l')}, y AS (SELECT *, {_RUN_KEY} AS k, {_OUT_IDS} FROM x) SELECT {_O_COLS}, arg_min(payload_id, k) AS first_payload, arg_min(file_name, k) AS first_file, count(*) AS copies FROM y GROUP BY {', '.join(f'i_{c}' for c in orders.OUTPUT[:-1])}, i_amount",
    "merged_payload": f"""WITH {_LATEST} SELECT count(*) AS file_count, count(DISTINCT file_name) AS n_file_names, arg_min(file_name, payload_id) AS first_file, CASE WHEN count(DISTINCT model_name) = 1 THEN min(model_name) ELSE '' END AS model_name,
 CASE WHEN sum(len(orders)) > 0 THEN 'COMPLETED' WHEN bool_and(status = 'SKIPPED') THEN 'SKIPPED' ELSE 'FAILED' END AS status, arg_min(base_date, payload_id) FILTER (base_date IS NOT NULL) AS first_base_date, CAST(sum(len(orders)) AS BIGINT) AS n_orders,
 (SELECT string_agg(u, '|' ORDER BY k, u) FROM (SELECT u, min(payload_id) AS k FROM (SELECT payload_id, unnest(issues) AS u FROM l) GROUP BY u)) AS issues, (SELECT string_agg(u, '; ' ORDER BY k, u) FROM (SELECT trim(reason) AS u, min(payload_id) AS k FROM l WHERE trim(reason) <> '' GROUP BY 1)) AS reasons FROM l""",
    "first_dates": f"WITH {_LATEST} SELECT payload_id, list_filter(orders, lambda o: o.base_date <> '')[1].base_date AS base_date FROM l",
    "flat_rows": f"WITH {_LATEST}, {_FLAT_SQL.format('l')} SELECT file_name, source_path, model_name, coalesce(document_base_date, '') AS document_base_date, array_to_string(issues, '|') AS issues, {', '.join(f'coalesce(o.{c}, {chr(39)}{chr(39)}) AS {c}' for c in orders.OUTPUT)} FROM x",
    "issue_counts": f"WITH {_LATEST} SELECT issue, count(*) AS n_documents FROM (SELECT unnest(issues) AS issue FROM l) GROUP BY issue",
}
