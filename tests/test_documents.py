"""Layout recovery, order builders and sources on small documents."""

import base64
import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from orderloom.functions import labels
from orderloom.operators import builders, coverage, joins, layout
from orderloom.plans import pipeline
from orderloom.sources import charset, documents, html, mail, secure, workbook

REPORT = """[PAGE 1]
BUY & SELL REPORT
Date | Buy&Sell | External Fund Manager | Fund Code | Fund Name | Fund Price | Buy |  | Sell |  | Custodian Bank
 |  |  |  |  |  | Amount | Unit | Amount | Unit |
11-28-2025 | B | M | 151128 | Alpha | 1.0 | 1,311,285 | 10 | 55,901,379 | 11 | Bank
 | B | M | 151161 | Beta | 1.0 | 3,597,188 | 10 | 9,770,019 | 11 | Bank
Total |  |  |  |  |  | 1 | 1 | 1 | 1 | """
NET = """[SHEET Sheet1]
기준일: 2026-03-18
펀드코드 | 펀드명 | 설정액 | 해지액 | 정산액
F001 | Alpha | 100 | -40 | 60
합계 |  | 100 | 40 | 60

펀드코드 | 펀드명 | 설정금액 / 3월19일 | 설정금액 / 3월20일 | 해지금액 / 3월19일 | 해지금액 / 3월20일
F001 | Alpha | 10 | 20 | 30 | 40"""
CONTEXT = """[SHEET Sheet1]
Date: 2024-05-16
수탁코드 | 펀드명 | 구분 | 내용 | 금액 | D+1(예상금액)
F001 | Alpha | 입금 | 보험료입금 | 5,000 | -
F001 | Alpha | 출금 | 환매신청 | 7 | 8
소계 |  |  |  | 5,007 | 8"""
LEDGER = """[PAGE 1]
1. Subscription
Fund Name Code No. of Unit NAV Date NAV Amount(KRW) Bank
Alpha Growth 151128 1,000.5 2024-05-16 1,023.4 5,000,000 Bank
2. Redemption
Fund Name Code No. of Unit NAV Date NAV Amount(KRW) Bank
Beta Bond 151161 10 17-May-24 999.1 40 Bank
Gamma 151162 10 2024-05-16 999.1 - Bank
TOTAL 5,000,040"""


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


def tabs(df):
    return layout.tables(layout.raw_rows(layout.sections(df)))


def test_buy_and_sell_report(spark):
    got = sorted((r.fund_code, r.order_type, r.base_date, r.transfer_amount) for r in builders.buy_sell_orders(docs(spark, REPORT, None, "")).collect())
    assert got == [("151128", "RED", "2025-11-28", "-55,901,379"), ("151128", "SUB", "2025-11-28", "1,311,285"), ("151161", "RED", "2025-11-28", "-9,770,019"), ("151161", "SUB", "2025-11-28", "3,597,188")]
    out = sorted((r.fund_code, r.order_type, r.t_day, r.transfer_amount) for r in pipeline.document_orders(docs(spark, REPORT)).collect())
    assert out[0] == ("151128", "1", "01", "55,901,379") and len(out) == 4


def orders_in(spark, *texts):
    got = builders.table_orders(builders.recovered(docs(spark, *texts))).collect()
    return sorted((r.fund_code, r.settle_class, r.order_type, r.t_day, r.transfer_amount) for r in got)


def cells_in(spark, *texts):
    d = docs(spark, *texts)
    return {r.doc_id: r.n_cells for r in coverage.counts(tabs(d), d).collect()}


def test_net_columns_and_future_days(spark):
    got = [x[1:] for x in orders_in(spark, NET)]
    assert got == [("CONFIRMED", "SUB", 0, "60"), ("PENDING", "RED", 1, "-30"), ("PENDING", "RED", 2, "-40"), ("PENDING", "SUB", 1, "10"), ("PENDING", "SUB", 2, "20")]
    assert cells_in(spark, NET) == {1: 5}


def test_direction_from_the_row(spark):
    got = sorted(x[2:] for x in orders_in(spark, CONTEXT))
    assert got == [("RED", 0, "-7"), ("RED", 1, "-8"), ("SUB", 0, "5,000")]
    signed = CONTEXT.replace("| 7 |", "| +7 |")  # an explicit sign beats the row's direction
    assert ("SUB", 0, "7") in [x[2:] for x in orders_in(spark, signed)]


PAGE_NET = """[HTML a.html]
2026년 3월 18일
정산내역

펀드코드 | 펀드명 | 설정액 | 해지액 | 정산액
BALI00 | 퇴연주식형 | 8,592,243 | 0 | 8,592,243

펀드코드 | 펀드명 | 설정금액 / 3월19일 | 설정금액 / 3월20일 | 해지금액 / 3월19일 | 해지금액 / 3월20일
BALI00 | 퇴연주식형 | 0 | 0 | 0 | 1,656,769"""


def test_a_page_keeps_its_empty_days(spark):
    assert orders_in(spark, PAGE_NET) == [("BALI00", "CONFIRMED", "SUB", 0, "8,592,243"), ("BALI00", "PENDING", "RED", 2, "-1,656,769")]


def test_the_base_date_is_no_future_day(spark):
    t = "[SHEET 1]\n기준일: 2026-03-18\n펀드코드 | 펀드명 | 설정금액 / 3월18일 | 설정금액 / 3월19일\nF001 | Alpha | 5 | 6"
    assert [x[1:] for x in orders_in(spark, t)] == [("CONFIRMED", "SUB", 0, "5"), ("PENDING", "SUB", 1, "6")]


def test_rows_that_must_not_be_lost(spark):
    t = """[SHEET 1]
기준일: 2026-03-18
펀드코드 | 펀드명 | 설정금액 | 해지금액
F001 | Total Return Bond | 900 | -
F002 | Beta | 10 | -
 | Beta B | - | 40
[펀드계] |  | 950 | 40
합계 |  | 950 | 40"""
    assert [(c, o, a) for c, _, o, _, a in orders_in(spark, t)] == [("F001", "SUB", "900"), ("F002", "RED", "-40"), ("F002", "SUB", "10")]


KDB = """[SHEET Sheet1]
운용지시서 |  |  |  |  |  |  |  |
2025-11-28 |  |  |  |  |  |  |  |
펀드명 | 운용사 | 수탁코드 | 구분 | 내용 | 금액 | D+1(예상금액) | 당일좌수
글로벌 자산배분안정형 | 가나자산운용 | F00432 | 입금 | 보험료입금 | - | 48,912,891 | -
 |  |  |  | 입금소계 | - | 48,912,891 | -
 |  |  | 출금 | 특별계정운용보수 | - | - | -
 |  |  |  | 기타 | 2,819,320 | - | 1,904,145
 |  |  |  | 출금소계 | 2,819,320 | - | 1,904,145"""


def test_subtotals_that_are_orders(spark):
    t = layout.pruned(tabs(docs(spark, KDB))).first()
    assert t.header == ["펀드명", "운용사", "수탁코드", "구분", "내용", "금액", "D+1(예상금액)"]
    assert ["글로벌 자산배분안정형", "가나자산운용", "F00432", "입금", "입금소계", "-", "48,912,891"] in t.body
    assert ["글로벌 자산배분안정형", "가나자산운용", "F00432", "출금", "출금소계", "2,819,320", "-"] in t.body
    assert builders.dated(docs(spark, KDB)).first().base_date == "2025-11-28"


SCHEDULE = """[PAGE 1]
기준일자 : 2025-11-27 수신처 : 가나자산운용
펀드명 운용사 입금액 출금액 당일이체좌수 당일이체금액
펀드코드 펀드코드 2025-11-28 2025-12-01 2025-12-02 2025-12-03
DV004 M0402 퇴직혼합형-혼합형 가나자산운용 0 0 0 -19,267,686 846,032 -121,762,204 0 0
DV005 M0501 퇴직 주식형-주식형1 가나자산운용 0 0 0 0 1,157,261 0 0 0"""


def test_a_schedule_in_plain_text(spark):
    t = layout.schedules(layout.sections(docs(spark, SCHEDULE, SCHEDULE.replace(" M0402", "").replace("퇴직 주식형", "0 |")))).orderBy("doc_id").collect()
    assert t[0].header[4:] == ["당일이체금액", "2025-11-28 예정금액", "2025-12-01 예정금액", "2025-12-02 예정금액", "2025-12-03 예정금액"]
    assert t[0].body[0] == ["DV004", "M0402", "퇴직혼합형-혼합형", "가나자산운용", "-19,267,686", "846,032", "-121,762,204", "0", "0"] and t[0].body[1][2] == "퇴직 주식형-주식형1"
    assert cells_in(spark, SCHEDULE) == {1: 4}
    assert [(c, o, d, a) for c, _, o, d, a in orders_in(spark, SCHEDULE)] == [("DV004", "RED", 0, "-19,267,686"), ("DV004", "RED", 2, "-121,762,204"), ("DV004", "SUB", 1, "846,032"), ("DV005", "SUB", 1, "1,157,261")]


SPLIT = """[PAGE 1]
거래유형 |  | 펀드코드 |  | 사무관리사 | 결제일 | 설정(해지)전좌수 | 설정(해지)좌수 | 펀드납입(인출)금액
판매사 |  | 펀드명 |  | 펀드평가사 | 통화코드 | 설정(해지)후좌수 | 설정(해지)금액 | 판매회사분결제액
설정 |  | BBC13F |  | 가나펀드서비스 | 2025-11-27 | 18,577,453,950 | 3,406,206 | 7,108,103
가나생명 |  | VUL 주식성장형(1형)_Active |  |  |  | 18,580,860,156 | 7,108,103 | 7,108,103
|  | [매매처계] |  |  |  | 18,577,453,950 | 3,406,206 | 7,108,103
[수탁사계] |  |  |  |  |  | 18,577,453,950 | 3,406,206 | 7,108,103
"""
PLAIN = """[PAGE 1]
The order of Subscription and Redemption
1. Subscription
Fund Name Code No. of Unit NAV Date NAV Amount(KRW) Bank
Asia(ex Japan) Index FoF AEE 373,629.5985 27-Nov-25 1,788.74 668,326 HANA
AI innovative Theme selection ATE - 27-Nov-25 1,566.73 - CITI
2. Redemption
Fund Name Code No. of Unit NAV Date NAV Amount(KRW) Bank
Bond ETF FoF BEE 185,714,727.6942 27-Nov-25 1,120.91 208,169,495 SCFB
TOTAL 186,088,356.2927 208,837,821
"""


def test_coverage_of_split_rows_and_plain_text(spark):
    two = SPLIT + layout.RAW_DELIMITER + SPLIT.replace("BBC13F", "BBA72G").replace("VUL", "VA").replace("7,108,103", "1,288,090")
    assert cells_in(spark, two, PLAIN, None, "") == {1: 2, 2: 2}
    got = sorted((r.fund_code, r.order_type, r.base_date, r.transfer_amount) for r in builders.section_orders(builders.dated(docs(spark, PLAIN))).collect())
    assert got == [("AEE", "SUB", "2025-11-27", "668,326"), ("BEE", "RED", "2025-11-27", "-208,169,495")]


def test_a_very_long_table(spark):
    """A hundred thousand rows in one block: patterns must not recurse, and filling down must stay linear."""
    n = 100_000
    rows = "\n".join(f"{f'F{i:06d}' if i % 3 == 0 else ''} | Fund {i} | {i + 1} | -" for i in range(n))
    d = docs(spark, f"[SHEET 1]\n기준일: 2026-03-18\n펀드코드 | 펀드명 | 설정금액 | 해지금액\n{rows}")
    got = builders.table_orders(builders.recovered(d)).agg(F.count("*"), F.count_distinct("fund_code"), F.max("row_no")).first()
    assert tuple(got) == (n, -(-n // 3), n)
    m = "\n".join(["| a | b |", "| --- | --- |"] + ["| 1 | 2 |"] * 5000)
    assert layout.long_cells(layout.markdown_rows(layout.sections(docs(spark, m)))).count() == 2 * 5001


def test_labels(spark):
    df = spark.createDataFrame([(["설정금액", "순유입금액", "2024-01-02 예정금액", "좌수 / 해지금액", "운용보수 금액", "펀드명", "구분", "당일좌수", ""],)], "h array<string>")
    c = df.select(labels.classes(F.col("h")).alias("c")).first().c
    assert [x.any for x in c] == [True, True, True, True, False, False, False, False, False]
    assert [x.mixed for x in c][3] and [x.identity for x in c] == [False] * 5 + [True] + [False] * 3
    assert [x.strong for x in c][5] and [x.context for x in c][6] and [x.relevant for x in c][:4] == [True] * 4
    df = spark.createDataFrame([("설정(해지)금액",), ("금액",), ("펀드계 / 입금(출금)금액",), ("펀드명",), ("D+1(예상금액)",)], "l string")
    assert [r[0] for r in df.select(labels.order_rank(F.col("l"))).collect()] == [0, 10, -8, None, 10]
    assert [r[0] for r in df.select(labels.coverage_rank(F.col("l"))).collect()] == [0, 10, -8, None, None]


def test_ledger_sections(spark):
    got = sorted((r.fund_code, r.fund_name, r.order_type, r.base_date, r.transfer_amount) for r in builders.section_orders(builders.dated(docs(spark, LEDGER))).collect())
    assert got == [("151128", "Alpha Growth", "SUB", "2024-05-16", "5,000,000"), ("151161", "Beta Bond", "RED", "2024-05-17", "-40")]


def test_where_documents_put_their_date(spark):
    title = "운용지시서\n2024-05-16 | \n펀드코드 | 순유입금액 (T-1 NAV 2024-05-14)\nF1 | 5"
    rows = "x\nDate | Buy&Sell | Fund Code | Fund Name | x\n11-28-2025 | B | 1 | a\n12-01-2025 | B | 2 | b\nDate: 2024-01-02"
    texts = ["Date: 2024-01-02\nx", "기준일자 : 20240105", title, rows, rows.replace("12-01", "11-28").replace("Date: 2024-01-02", ""), "Date (Asia/Seoul): 2024-01-04", "none", None, PLAIN, "a\n15-Jan-24", "Date: 2024-01-02\n2023년 5월 6일"]
    got = {r.doc_id: (r.base_date, r.date_source) for r in builders.dated(docs(spark, *texts)).collect()}
    want = [("2024-01-02", "text"), ("2024-01-05", "text"), ("2024-05-16", "title"), (None, None), ("2025-11-28", "report"), ("2024-01-04", "text"), (None, None), (None, None), ("2025-11-27", "ledger"), ("2024-01-15", "text"), ("2023-05-06", "text")]
    assert [got[i] for i in range(1, 12)] == want


def test_blocks_headers_and_filling(spark):
    text = "[PAGE 1]\na | b\nnote\n펀드코드 | 펀드명 | 운용사명 | 금액\nF001 | A | M1 | 1\n | B |  | 2\n합계 |  |  | 3" + layout.RAW_DELIMITER + "  \n" + layout.RAW_DELIMITER + "[HTML 2]\nx"
    s = layout.sections(docs(spark, text, "", None))
    assert [(r.section_no, r.section[:8]) for r in s.orderBy("section_no").collect()] == [(1, "[PAGE 1]"), (3, "[HTML 2]")]
    t = [r for r in tabs(docs(spark, text)).collect() if r.header_at]
    assert [(r.block_no, r.header_at, r.data_at, r.code_at, r.name_at, r.manager_at) for r in t] == [(2, 1, 2, 1, 2, 3)]
    assert [(r.row[0], r.row[2], r.total, r.kept) for r in t[0].body] == [("F001", "M1", False, True), ("F001", "M1", False, False), ("합계", "M1", True, False)]
    n = joins.neighbour(layout.body_rows(tabs(docs(spark, text))), "code").orderBy("row_no").collect()
    assert [(r.code, r.borrowed) for r in n][1] == ("F001", True)


def test_headers_of_two_rows(spark):
    df = spark.createDataFrame([([["", "설정금액", "", "좌수", ""], ["코드", "3월19일", "3월20일", "당일", "합"]],)], "r array<array<string>>")
    assert df.select(layout.collapse_header(F.col("r"))).first()[0] == ["코드", "설정금액 / 3월19일", "설정금액 / 3월20일", "좌수 / 당일", "합"]


def test_packing_sections(spark):
    df = spark.createDataFrame([(["aaaa", "bb", "c" * 20, "d"],), ([],)], "p array<string>")
    got = [r[0] for r in df.select(layout.pack_sections(F.col("p"), 9, "--")).collect()]
    assert got == [["aaaa--bb", "c" * 20, "d"], []]


def test_table_text(spark):
    df = spark.createDataFrame([([["a", "b|c"], ["1", ""]],)], "r array<array<string>>")
    assert df.select(layout.render_table(F.col("r"))).first()[0] == "| a | b\\|c |\n| --- | --- |\n| 1 |  |"


def test_scope(spark):
    rows = spark.createDataFrame([(1, "F1", "Alpha"), (1, "F2", "be-ta"), (1, None, None), (2, "F9", "x")], "doc_id long, fund_code string, fund_name string")
    scope = "payload_id long, target_fund_scope struct<manager_column_present: boolean, include_all_funds: boolean, fund_codes: array<string>, fund_names: array<string>, canonical_fund_names: array<string>>"
    p = spark.createDataFrame([(1, (True, False, ["F1"], None, ["beta"])), (2, (False, True, [], [], [])), (3, None)], scope)
    got = coverage.in_scope(rows, coverage.scope_members(p), coverage.limited(p)).collect()
    assert sorted((r.doc_id, r.fund_code) for r in got) == [(1, "F1"), (1, "F2"), (2, "F9")]


def test_scope_without_a_manager_column_keeps_all(spark):
    rows = spark.createDataFrame([(1, "F1", "Alpha"), (1, "F2", "Beta"), (2, "F1", "Alpha"), (2, "F2", "Beta"), (3, "F2", "Beta")], "doc_id long, fund_code string, fund_name string")
    scope = "payload_id long, target_fund_scope struct<manager_column_present: boolean, include_all_funds: boolean, fund_codes: array<string>, fund_names: array<string>, canonical_fund_names: array<string>>"
    p = spark.createDataFrame([(1, (False, False, ["F1"], [], [])), (2, (True, False, ["F1"], [], [])), (3, (None, False, [], [], []))], scope)
    got = coverage.in_scope(rows, coverage.scope_members(p), coverage.limited(p)).collect()
    assert sorted((r.doc_id, r.fund_code) for r in got) == [(1, "F1"), (1, "F2"), (2, "F1"), (3, "F2")]


PAGE = """<html><head><style>x</style></head><body><p>Hello&nbsp;you<br>there</p><table><tr><td><table>
<tr><th rowspan=2>A</th><th colspan="2">B &amp; C</th></tr><tr><td>1</td><td>2</td></tr><tr><td>x</td></tr></table></td></tr></table><script>no</script><div>end</div></body></html>"""


def test_html_blocks():
    got = html.blocks(PAGE)
    assert [b.kind for b in got] == ["text", "table", "text"]
    assert [[c.text for c in r] for r in got[1].rows] == [["A", "B & C", "B & C"], ["A", "1", "2"], ["x", "", ""]]
    assert [[c.inherited for c in r] for r in got[1].rows][:2] == [[False, False, True], [True, False, False]]
    assert html.to_lines(got)[:3] == ["Hello you", "there", ""]
    assert html.blocks("") == [] and html.to_lines(html.blocks("<table><tr><td>open")) == ["open"]


def test_charsets():
    for name in ("utf-8", "cp949", "utf-16", "utf-8-sig"):
        assert charset.decode("펀드코드 설정금액".encode(name)) == "펀드코드 설정금액"
    assert charset.decode("펀드".encode("cp949"), "ks_c_5601-1987") == "펀드" and charset.decode(b"") == ""


EML = """Subject: =?utf-8?b?{subject}?=
From: A <a@x.example>
To: b@x.example
Date: Mon, 13 May 2024 22:25 +0000
Content-Type: multipart/alternative; boundary=q

--q
Content-Type: text/plain; charset=utf-8

plain only
--q
Content-Type: text/html; charset=utf-8

<table><tr><td>fund</td><td>amount</td></tr><tr><td>F1</td><td>5</td></tr></table>
--q--
""".format(subject=base64.b64encode("운용지시".encode()).decode())


def test_mail():
    got = mail.read_eml(EML.encode(), "x.eml").split("\n")
    assert got[:2] == ["[EML x.eml]", "Subject: 운용지시"] and "Date (Asia/Seoul): 2024-05-14" in got
    assert got[-2:] == ["fund | amount", "F1 | 5"]
    assert mail.seoul_date("nonsense") is None and mail.seoul_date(None) is None


def xlsx() -> bytes:
    n = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    parts = {
        "xl/workbook.xml": f'<workbook {n} {r}><sheets><sheet name="S1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {n}><si><t>펀드</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>",
        "xl/styles.xml": f'<styleSheet {n}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet {n}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"/><row r="3"><c r="A3"><v>70000000.00000001</v></c><c r="B3" s="1"><v>45000</v></c><c r="C3"><v>0.0019</v></c><c r="D3" t="inlineStr"><is><t>x\ny</t></is></c></row></sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


XML2003 = b"""<?xml version="1.0"?><Workbook xmlns="urn:schemas-microsoft-com:office:spreadsheet" xmlns:ss="urn:schemas-microsoft-com:office:spreadsheet">
<Worksheet ss:Name="T"><Table><Row><Cell><Data ss:Type="String">a</Data></Cell><Cell ss:Index="3"><Data ss:Type="Number">5.0</Data></Cell></Row></Table></Worksheet></Workbook>"""


def test_workbooks():
    assert workbook.render(workbook.read_xlsx(xlsx())) == "[SHEET S1]\n펀드 |  | ab\n70000000 | 2023-03-15 | 0.0019 | x y"
    assert workbook.render(workbook.read_xml_spreadsheet(XML2003)) == "[SHEET T]\na |  | 5"


def test_loading_files(spark, tmp_path):
    (tmp_path / "a.html").write_text(PAGE, encoding="utf-8")
    (tmp_path / "b.eml").write_bytes(EML.encode())
    (tmp_path / "c.xlsx").write_bytes(xlsx())
    (tmp_path / "d.xls").write_bytes(XML2003)
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    (tmp_path / "f.xlsx").write_bytes(b"broken")
    (tmp_path / "g.txt").write_text("펀드", encoding="cp949")
    (tmp_path / "h.mht").write_bytes(EML.encode())
    with zipfile.ZipFile(tmp_path / "i.html", "w") as z:
        z.writestr("x/other.html", "<p>other</p>")
        z.writestr("index.html", "<p>first</p>")
    got = {r.file_name: (r.raw_text, r.error) for r in documents.load(spark, str(tmp_path)).collect()}
    assert len(got) == 9 and {k for k, v in got.items() if v[1]} == {"e.pdf", "f.xlsx"}
    assert got["g.txt"][0] == "펀드" and got["i.html"][0].endswith("first") and got["h.mht"][0].startswith("[MHT 1]")


def test_handoff_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a.eml", "x", "secret")], "file_name string, raw_text string, password string")
    documents.write_handoff(df, str(tmp_path), "r1")
    back = documents.read_handoff(spark, f"{tmp_path}/run=r1").first()
    assert (back.file_name, back.chunks, back.effective_llm_text_kind, back.expected_order_count) == ("a.eml", [], "markdown_text", 0)
    assert documents.orders_csv([(1, None)], ["a", "b"]).decode("utf-8-sig") == "a,b\r\n1,\r\n"


@pytest.mark.parametrize("size", [32, 16])
def test_salted_text_is_decrypted(spark, size):
    password, salt, plain = "p가ss", b"12345678", "주문 내역 order".encode()
    key, block = b"", b""
    while len(key) < size + 16:
        block = hashlib.md5(block + password.encode() + salt).digest()
        key += block
    enc = spark.createDataFrame([(bytearray(plain), bytearray(key[:size]), bytearray(key[size : size + 16]))], "p binary, k binary, iv binary").select(F.aes_encrypt("p", "k", F.lit("CBC"), F.lit("PKCS"), F.col("iv"))).first()[0]
    text = base64.b64encode(b"Salted__" + salt + bytes(enc)[16:]).decode()
    df = spark.createDataFrame([(text, password), (text, "wrong"), ("nonsense", password), (None, password)], "t string, p string")
    got = [bytes(r[0]) if r[0] is not None else None for r in df.select(secure.decrypt(F.col("t"), F.col("p"))).collect()]
    assert got[0] == plain and got[2] is None and got[3] is None and got[1] != plain


def test_parties(spark):
    df = spark.createDataFrame([(1, "instr_1.eml", "x"), (2, "zz.xlsx", "특별계정 자금 집계"), (3, "reorder.txt", ""), (4, None, None), (5, "운용지시.pdf", "Order of Fund Transfers")], "payload_id long, file_name string, raw_text string")
    got = {r.payload_id: (r.party, r.by) for r in joins.resolve_party(df, joins.PARTIES).collect()}
    assert got == {1: ("instruction", "name"), 2: ("account-summary", "text"), 3: (None, None), 4: (None, None), 5: ("transfer-order", "text")}


def test_siblings_and_unique_matches(spark):
    df = spark.createDataFrame([(1, "a", "F", None, "x"), (1, "b", "F", "5", None), (2, "c", None, None, None)], "doc_id long, ord string, fund string, amount string, day string")
    got = sorted((r.ord, r.field, r.has) for r in joins.siblings(df, ["doc_id", "fund"], ["amount", "day"]).collect())
    assert got == [("a", "amount", True), ("b", "day", True), ("c", "amount", False), ("c", "day", False)]
    right = spark.createDataFrame([("F", "1"), ("G", "2"), ("G", "3")], "fund string, v string")
    left = spark.createDataFrame([("F",), ("G",)], "fund string")
    assert [tuple(r) for r in joins.match_unique(left, right, ["fund"], "v").collect()] == [("F", "1")]
