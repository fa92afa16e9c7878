"""Mail threads, reports, pages, sinks, configuration and rendering on small cases."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from orderloom.functions import reasons
from orderloom.operators import issues, layout, render, scope
from orderloom.sources import config, mail, pages, sinks

from .test_documents import docs, tabs

ORDERS = ["펀드코드 | 금액", "F1 | 100"]


def test_earlier_messages_are_cut():
    head = ["From: A <a@b.example>", "Sent: Mon, 3 Jun 2024 09:12 +0900", "Subject: x"]
    assert mail.without_earlier([*ORDERS, "", "-----Original Message-----", *head, "old"]) == ORDERS
    assert mail.without_earlier([*ORDERS, "On Mon, 3 Jun 2024, A B wrote:", "> old"]) == ORDERS
    assert mail.without_earlier([*ORDERS, "", *head, "", "F2 | 5"]) == ORDERS
    assert mail.without_earlier([*ORDERS, *head, "F2 | 5"]) == ORDERS  # right below orders, with orders behind
    note = ["Please note", *head, "nothing else"]
    assert mail.without_earlier(note) == note
    example = ["Header example:", *head, "", "F2 | 5"]
    assert mail.without_earlier(example) == example
    assert mail.without_earlier(["Subject: only a word", "x"]) == ["Subject: only a word", "x"]
    assert mail.earlier_message([]) is None


def test_body_scores():
    assert mail.score(["fund code | amount", "F1 | 5"], "html") == 24 + 4 + 2
    assert mail.score(["hello"], "plain") == -30 and mail.score(["From: x", "amount"], "plain") == 12 - 20


def test_a_report_with_one_cell_a_line():
    cells = ["BUY & SELL REPORT", "Sender", "", "Date", "Buy&Sell", "11-28-2025", "B", "M", "151128", "Alpha", "1.0", "1,311,285", "55,901,379", "M", "151161", "Beta", "1.0", "3,597,188", "10", "9,770,019", "11", "Bank", "Total"]
    got = mail.report_rows(cells)
    assert got[:2] == ["BUY & SELL REPORT", "Sender"] and got[2:4] == mail.REPORT_HEADER
    assert got[4] == "11-28-2025 | B | M | 151128 | Alpha | 1.0 | 1,311,285 |  | 55,901,379 |  | " and got[5] == " |  | M | 151161 | Beta | 1.0 | 3,597,188 | 10 | 9,770,019 | 11 | Bank"
    assert mail.report_rows(["x"]) is None and mail.report_rows(cells[:5]) is None


PIECES = """운용지시서
펀드명 운용사 수탁코드 구분 내용 금액 D+1(예상금액) 당일좌수
보험료입금 - 48,912,891 -
글로벌 자산배분 가나자산운용 F00432
안정형 입금소계 - 48,912,891 -
출금소계 2,819,320 - 1,904,145"""


def test_pages():
    assert pages.from_pieces(PIECES, "가나").split("\n")[1:] == [pages.PIECES_COLUMNS, "글로벌자산배분안정형 | 가나자산운용 | F00432 | 입금 | 입금소계 | - | 48,912,891", "글로벌자산배분안정형 | 가나자산운용 | F00432 | 출금 | 출금소계 | 2,819,320 | -"]
    whole = [["title", None, None], ["펀드코드", "펀드명", "금액"], ["F001", "Al\npha", "100"], ["합계", "", "100"]]
    torn = [["펀", "드", "코"], ["F001", "Al", "100"]]
    assert pages.reading_score([whole]) > pages.reading_score([torn])
    two = [pages.Page("기준일 2024-01-02\nx", [[torn], [whole]]), pages.Page("", [[[["F002", "Beta", "7"], ["F003", "C", "8"], ["F004", "D", "9"]]]])]
    got = pages.document_text(two).split("\n")
    assert got == ["[PAGE 1]", "기준일 2024-01-02", "title", "펀드코드 | 펀드명 | 금액", "F001 | Al / pha | 100", "", "==== SECTION ====", "", "[PAGE 2]", "펀드코드 | 펀드명 | 금액", "F002 | Beta | 7", "F003 | C | 8", "F004 | D | 9"]
    head = "Fund Name Code No. of Unit NAV Date NAV Amount(KRW) Bank"
    plain = pages.document_text([pages.Page(f"1. Subscription\n{head}\nAlpha AEE 3.5 27-Nov-25 1.7 668,326 HANA"), pages.Page("Beta BEE 3.5 27-Nov-25 1.7 5 HANA")])
    assert plain.split("\n")[-3:] == ["1. Subscription", head, "Beta BEE 3.5 27-Nov-25 1.7 5 HANA"]
    assert pages.document_text([]) == "" and pages.document_text([pages.Page()]) == ""


def test_pages_in_spark(spark):
    df = spark.createDataFrame([(1, 2, "b", None), (1, 1, "a", [[]]), (2, 1, None, None)], "doc_id long, page_no int, text string, readings array<array<array<array<string>>>>")
    assert {r.doc_id: r.raw_text for r in pages.read_pages(df).collect()} == {1: "[PAGE 1]\na\n\n==== SECTION ====\n\n[PAGE 2]\nb", 2: None}


def test_sinks(spark, tmp_path):
    assert sinks.output_base(["/a/b.pdf"], None, datetime(2024, 1, 2)) == "b_20240102_000000" and sinks.output_base(["a", "b"], None, datetime(2024, 1, 2)).startswith("merged_orders_")
    js, cs = sinks.write_payload({"status": "COMPLETED", "rows": [{"fund_code": "F1", "issues": "X"}]}, str(tmp_path / "o" / "r"))
    assert json.loads(open(js, encoding="utf-8").read()) == {"status": "COMPLETED"}
    assert open(cs, "rb").read().startswith(b"\xef\xbb\xbffile_name,")
    stage = spark.createDataFrame([(1, 0, "k", '[{"ord":"1"},{"ord":"2"}]', ["I"], ["bad", "worse"])], "doc_id long, batch int, key string, items_json string, issues array<string>, invalid array<string>")
    sinks.write_dead_letters(stage, str(tmp_path / "dead"), "r1", "t_day")
    assert sorted(r.answer for r in spark.read.json(str(tmp_path / "dead" / "run=r1")).collect()) == ["bad", "worse"]
    assert tuple(sinks.stage_metrics(stage).first()) == (1, 2, 1, 2)
    o = spark.createDataFrame([("F1", None, "1", "3", "2024-01-02", "01", "5"), ("F2", "B", "2", "1", None, "01", "7")], "fund_code string, fund_name string, settle_class string, order_type string, base_date string, t_day string, transfer_amount string")
    rows = [tuple(r) for r in sinks.review_rows(o).orderBy("fund_code").collect()]
    assert rows == [("F1", "", "2024-01-02", "01", "5", "청구", "설정"), ("F2", "B", "", "01", "7", "확정", "해지")]
    sinks.write_review(rows, str(tmp_path / "v" / "r.csv"))
    assert sinks.read_review(str(tmp_path / "v" / "r.csv"))[0] and sinks.read_review(cs) == (False, [])
    (tmp_path / "h" / "run=1").mkdir(parents=True)
    assert not sinks.clean_handoff(str(tmp_path / "h" / "run=1"), str(tmp_path / "h"), False) and not sinks.clean_handoff(str(tmp_path / "o"), str(tmp_path), True)
    assert sinks.clean_handoff(str(tmp_path / "h" / "run=1"), str(tmp_path / "h"), True) and not (tmp_path / "h" / "run=1").exists()


def test_configuration(tmp_path):
    (tmp_path / ".env").write_text("# c\nORDERLOOM_TRIES=5\nexport ORDERLOOM_MODEL='m'\nORDERLOOM_BATCH=7\n")
    s = config.settings({"ORDERLOOM_BATCH": "9", "ORDERLOOM_ONLY_PENDING": "yes"}, str(tmp_path / ".env"))
    assert (s.tries, s.model, s.batch, s.only_pending) == (5, "m", 9, True)
    with pytest.raises(ValueError):
        config.settings({"ORDERLOOM_ONLY_PENDING": "maybe"}, "none")
    (tmp_path / "p.json").write_text(json.dumps([{"name": "A", "text_tokens": ["X "]}, {"name": ""}, "?", {"name": "B", "file_tokens": ["y"]}]))
    assert config.read_parties(str(tmp_path / "p.json")) == ([("A", ["x"], []), ("B", [], ["y"])], ["row 2: no name or no token", "row 3: no name or no token"])
    good = [{"stage": x, "prompt": "{document} {items}"} for x in config.STAGES]
    path = tmp_path / "prompts.json"
    path.write_text(json.dumps(good))
    p = config.Prompts(str(path))
    path.write_text("broken")
    assert len(p.refresh()) == 7 and p.error
    for bad in (good[1:], [*good, good[0]], [{"stage": "t_day", "prompt": "x"}], [{"stage": "t_day", "prompt": "{document} {items} {other}"}]):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            config.read_prompts(str(path))


def test_whole_documents(spark):
    t = "[SHEET Sheet1]\nNote\n펀드코드 | 펀드명 | 설정금액 | 당일좌수\nF001 | Alpha | 100 | 5\n합계 |  | 100 | 5\nbye" + layout.RAW_DELIMITER + "[HTML 2]\n" + layout.RAW_DELIMITER + "plain\nx | y"
    got = {r.doc_id: r.markdown for r in render.document_markdown(docs(spark, t, "", None)).collect()}
    assert got == {1: "## Sheet Sheet1\n\n```text\nNote\n```\n\n| 펀드코드 | 펀드명 | 설정금액 |\n| --- | --- | --- |\n| F001 | Alpha | 100 |\n\n```text\nbye\n```\n\n<!-- SECTION -->\n\n## HTML 2\n\n<!-- SECTION -->\n\n## Section 3\n\n```text\nx | y\n```"}
    a = render.audit_of(tabs(docs(spark, t))).first().audit
    assert a.codes == ["F001"] and a.labels == ["펀드코드", "펀드명", "설정금액", "당일좌수"] and a.rows == ["| F001 | Alpha | 100 | 5 |"]
    df = spark.createDataFrame([("F001 100", (["100"], ["x"], [], [], ["F001"]), True), ("a", None, True), ("a", None, False)], "m string, a struct<labels: array<string>, rows: array<string>, inherited: array<string>, kinds: array<string>, codes: array<string>>, h boolean")
    assert [r[0] for r in df.select(render.loss_reasons(F.col("m"), F.col("a"), F.col("h"))).collect()] == [["html_table_shape_collapsed"], ["html_markdown_unverified"], []]
    c = spark.createDataFrame([("md", "raw"), ("md", None), ("md", "x" * 30)], "m string, r string").select(render.model_context(F.col("m"), F.col("r"), 10, 5).alias("c"))
    assert [r.c for r in c.collect()] == ["md" + render.BACKUP + "raw\n```", "md", "md" + render.BACKUP + "x" * 10 + "\n...\n" + "x" * 5 + "\n```"]
    assert {r[0] for r in c.select(render.structured_view(F.col("c"))).collect()} == {"md"}


def test_reasons(spark):
    df = spark.createDataFrame([(1, "T1_SUB", "익영업일 청구", "5"), (0, "T0_NET", "x", "-5"), (0, None, "1. Subscription", None), (0, "T0_SUB", "설정금액", "5"), (None, None, None, None)], "d int, s string, l string, a string")
    d, s, l, a = (F.col(c) for c in "dsla")
    got = df.select(reasons.slot_reason(d, s, l), reasons.settle_reason(d, l), reasons.type_reason(a, l), reasons.amount_reason(d, a, l)).collect()
    assert [tuple(r) for r in got] == [
        ("SLOT_BUSINESS_DAY_HEADER", "SETTLE_BUSINESS_DAY_HEADER", "ORDER_OTHER_VERIFIED", "AMOUNT_SCHEDULE_BUCKET"), ("SLOT_T0_NET", "SETTLE_TDAY_FALLBACK", "ORDER_SIGN_NEGATIVE", "AMOUNT_SIGNED_OUTFLOW"),
        ("SLOT_T0_EXPLICIT_SUB", "SETTLE_SAME_DAY_LABEL", "ORDER_LABEL_SUB", "AMOUNT_EXPLICIT_SUB"), ("SLOT_T0_EXPLICIT_SUB", "SETTLE_SAME_DAY_LABEL", "ORDER_LABEL_SUB", "AMOUNT_EXPLICIT_SUB"),
        ("SLOT_OTHER_VERIFIED", "SETTLE_OTHER_VERIFIED", "ORDER_OTHER_VERIFIED", "AMOUNT_OTHER_VERIFIED"),
    ]


MANAGED = """[SHEET 1]
운용사명 | 펀드코드 | 펀드명 | 설정금액 | 해지금액
가나자산운용 | F001 | Alpha | 100 | -
다라자산운용 | F002 | Beta | 5 | 6
가나자산운용 | F003 | Gamma | 0 | 0"""
BARE = "펀드코드 | 펀드명 | 설정금액\nF009 | Delta | 7"


def test_scopes_of_documents(spark):
    by_line = f"[SHEET 1]\n운용사: 가나자산운용{layout.RAW_DELIMITER}[SHEET 2]\n{BARE}{layout.RAW_DELIMITER}[SHEET 3]\n{BARE.replace('F009', 'F010')}"
    texts = [MANAGED, by_line, f"[SHEET 1]\n{BARE}", "운용사 : 다라자산운용\nx", "manager: 가나", MANAGED.replace("가나", "마바"), None]
    got = {r.doc_id: (r.manager_column_present, r.include_all_funds, r.fund_codes, r.canonical_fund_names) for r in scope.document_scope(docs(spark, *texts), "가나").collect()}
    assert got == {
        1: (True, False, ["F001"], ["alpha"]), 2: (True, False, ["F009"], ["delta"]), 3: (False, True, [], []), 4: (True, False, [], []), 5: (True, True, [], []), 6: (True, False, [], []),
    }


def test_status_and_notices(spark):
    p = spark.createDataFrame([(1, "/a", "notice", False, False, None), (2, "/b", None, True, False, 0), (3, "/c", None, False, True, 0), (4, "/d", "x", True, True, 2), (5, "/e", "", False, False, None)], "payload_id long, source_path string, non_instruction_reason string, allow_empty_result boolean, scope_excludes_all_funds boolean, n_orders long")
    got = {r.payload_id: (r.status, r.reason) for r in issues.document_status(p).collect()}
    assert got == {1: ("SKIPPED", "not an order instruction: /a: notice"), 2: ("SKIPPED", "no trade in the document"), 3: ("SKIPPED", "no order of the funds in scope"), 4: ("COMPLETED", None), 5: ("SKIPPED", "no order found")}
    head = "Subject: a\nFrom: b\nTo: c\nDate: d\n"
    d = spark.createDataFrame([(1, "설정 해지 금액 통보", 0), (2, f"{head}\n첨부파일과 같이 송부드리니", 0), (3, f"{head}\nsee attached", None), (4, f"{head}\nhello", 0), (5, "설정해지금액통보", 3), (6, None, 0)], "doc_id long, text string, n_cells long")
    assert {r.doc_id: r.why for r in issues.non_instruction(d).collect()} == {1: "notice", 2: "cover", 3: "cover", 4: None, 5: None}


def test_issues_that_orders_disprove(spark):
    o = "array<struct<fund_code: string, fund_name: string, settle_class: string, order_type: string, base_date: string, t_day: string, transfer_amount: string>>"
    full, part = ("F1", "A", "2", "3", "2024-01-02", "01", "5"), ("F1", "B", "2", "3", None, "01", "0")
    every = ["BASE_DATE_MISSING", "T_DAY_STAGE_PARTIAL:2", "BASE_DATE_STAGE_PARTIAL", "T_DAY_MISSING", "TRANSFER_AMOUNT_ZERO", "FUND_CODE_DUPLICATE", "LLM_INVALID_RESPONSE_FORMAT", "NO_MANAGER_INFO", "OTHER"]
    rows = [(1, every, [full], True, True), (2, every, [full, part], False, False), (3, every, [], True, False)]
    p = spark.createDataFrame(rows, f"payload_id long, issues array<string>, orders {o}, in_scope boolean, corroborated boolean")
    facts = spark.createDataFrame([(2, True, False, False, False, False)], "doc_id long, t_day_open boolean, amount_open boolean, kind_open boolean, settle_open boolean, fund_open boolean")
    got = {r.payload_id: r.kept for r in issues.reconciled(p, facts, ["T_DAY_MISSING", "T_DAY_STAGE_PARTIAL", "BASE_DATE_STAGE_PARTIAL"]).collect()}
    assert got[1] == ["OTHER"] and got[2] == every and got[3] == [x for x in every if x != "T_DAY_MISSING"]


def test_protected_pages_are_opened(spark, tmp_path):
    import base64
    import hashlib

    from orderloom.sources import documents, secure

    password, salt, page = "p가ss", b"12345678", "<html><body><table><tr><td>펀드코드</td><td>금액</td></tr><tr><td>F1</td><td>5</td></tr></table></body></html>".encode()
    key = block = b""
    while len(key) < 48:
        block = hashlib.md5(block + password.encode() + salt).digest()
        key += block
    enc = spark.createDataFrame([(bytearray(page), bytearray(key[:32]), bytearray(key[32:48]))], "p binary, k binary, i binary").select(F.aes_encrypt("p", "k", F.lit("CBC"), F.lit("PKCS"), F.col("i"))).first()[0]
    cipher = base64.b64encode(b"Salted__" + salt + bytes(enc)[16:]).decode()
    halves = f"'{cipher[:40]}' + '{cipher[40:]}'"
    shell = "<html>보안메일<input type='password'> 인증암호 <script>var c = {}; CryptoJS.AES.decrypt(c)</script></html>"
    (tmp_path / "a.html").write_text(shell.format(f'"{cipher}"'), encoding="utf-8")
    (tmp_path / "b.html").write_text(shell.format(halves), encoding="utf-8")
    (tmp_path / "c.html").write_text("<p>plain 보안메일</p>", encoding="utf-8")
    assert secure.is_shell(shell) and not secure.is_shell("<p>plain 보안메일</p>")
    for given, opened in ((password, True), ("wrong", False), (None, False)):
        got = {r.file_name: (r.raw_text, r.error) for r in documents.load(spark, str(tmp_path), given).collect()}
        assert got["c.html"] == ("[HTML 1]\nplain 보안메일", None)
        for name in ("a.html", "b.html"):
            assert (got[name][0] == "[HTML 1]\n펀드코드 | 금액\nF1 | 5") is opened and (got[name][1] is None) is opened


def test_paths(tmp_path, monkeypatch):
    from orderloom.sources import documents

    (tmp_path / "in" / "d").mkdir(parents=True)
    for f in ("in/a.txt", "a.txt", "in/d/b.txt", "c.txt"):
        (tmp_path / f).write_text("x")
    monkeypatch.chdir(tmp_path)
    found, missing = documents.resolve(["a.txt", "d/b.txt", "c.txt", str(tmp_path / "a.txt"), "a.txt", "none", "in"], "in")
    assert [f[len(str(tmp_path)) + 1 :] for f in found] == ["in/a.txt", "in/d/b.txt", "c.txt", "a.txt"] and missing == ["none", "in"]


def test_stage_items(spark):
    from orderloom.operators import stages

    df = spark.createDataFrame([(1, "a", "F", "T+2 예정", 1, "T1_SUB", "5", None), (1, "b", "F", "T+2 예정", 2, "T2_SUB", "5", "r"), (1, "c", "F", "x", 1, None, None, None), (1, "d", "F", "x", 1, None, None, "s")], "doc_id long, ord string, fund string, evidence_label string, t_day int, slot_id string, transfer_amount string, reason_code string")
    full = df.withColumn("settle_class", F.lit(None).cast("string")).withColumn("order_type", F.lit(None).cast("string"))
    assert sorted((r.ord, r.tied) for r in stages.settled_slots(full, ["doc_id", "fund"]).collect()) == [("b", False), ("c", True)]
    assert sorted((r.ord, r.reason_code) for r in stages.distinct_items(df).collect()) == [("a", None), ("b", "r"), ("c", "s")]
    a = spark.createDataFrame([(1, "x", None), (2, "y", None), (3, "z", None), (5, "q", "w")], "k int, f string, g string")
    b = spark.createDataFrame([(1, "x", "1"), (2, "y", None), (4, "n", None), (5, "q", None)], "k int, f string, g string")
    assert {r.k: r.delta for r in stages.compared(a, b, ["k"], ["f", "g"]).collect()} == {1: "filled", 2: "same", 3: "missing", 4: "added", 5: "lost"}
