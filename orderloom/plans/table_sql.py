"""SQL counterparts of table recovery, orders read off tables and coverage.

Nothing here is taken from the operators: words and patterns are written out again, cells are rows of a relation instead
of arrays, filling is a window. Only what the test tables can't show is left out: labels with parts between slashes,
business days written as words, and requests whose day stands in a note.
"""

from __future__ import annotations

from . import sql as S

_B = "doc_id, section_no, block_no"
NUM = r"[+-]?[0-9][0-9,]*(\.[0-9]+)?[억만천]?"
_WHITE = "chr(32) || chr(9) || chr(13) || chr(160) || chr(8195) || chr(8199) || chr(8201) || chr(8239) || chr(12288) || chr(133)"


def words(x: str, *w: str) -> str:
    return "(" + " OR ".join(f"contains({x}, '{v}')" for v in w) + ")"


def sections(field: str, delimiter: str) -> str:
    split = f"string_split({field}, '{delimiter}')"
    return rf"sec AS (SELECT doc_id, CAST(i AS INTEGER) AS section_no, s AS section FROM (SELECT payload_id AS doc_id, unnest({split}) AS s, generate_subscripts({split}, 1) AS i FROM task_payloads WHERE {field} IS NOT NULL) WHERE trim(regexp_replace(s, '\s+', ' ', 'g')) <> '')"


def blocks(pattern: str) -> str:
    found = f"regexp_extract_all(section, '{pattern}')"
    return rf"""blk AS (SELECT doc_id, section_no, CAST(i AS INTEGER) AS block_no, string_split(regexp_replace(b, '\n$', ''), chr(10)) AS lines FROM (SELECT doc_id, section_no, unnest({found}) AS b, generate_subscripts({found}, 1) AS i FROM sec)),
lin AS (SELECT doc_id, section_no, block_no, unnest(lines) AS line, CAST(generate_subscripts(lines, 1) AS INTEGER) AS row_no FROM blk)"""


RAW = "\n\n==== SECTION ====\n\n"
STRUCTURED = "\n\n<!-- SECTION -->\n\n"
CELLS = rf"""{sections("raw_text", RAW)}, {blocks(r"(?m)(?:^.* \| .*$\n?)+")},
prt AS (SELECT doc_id, section_no, block_no, row_no, string_split(regexp_replace(line, ' \|\s*$', ' | '), ' | ') AS parts FROM lin),
cel AS (SELECT doc_id, section_no, block_no, row_no, CAST(generate_subscripts(parts, 1) AS INTEGER) AS col_no, trim(unnest(parts), {_WHITE}) AS cell FROM prt)"""

_ORDER = ("설정금액", "해지금액", "추가설정금액", "당일인출금액", "해지신청", "설정신청", "입금액", "출금액", "투입금액", "인출금액", "매입금액", "환매금액", "buy", "sell", "subscription", "redemption", "execution amount", "당일이체금액", "amount")
_EXPLICIT = ("설정금액", "해지금액", "추가설정금액", "당일인출금액", "해지신청", "설정신청", "입금액", "출금액", "투입금액", "인출금액", "매입금액", "환매금액", "buy", "sell", "subscription", "redemption")
_NET = ("순유입", "순투입", "증감금액", "증감액", "정산액", "당일이체금액", "이체예정금액", "실행금액", "결제금액", "settlement amount", "execution amount")
_UNITS = ("좌수", "unit", "share")
_SIDE = ("금액", "amount", "보수", "fee", "이용료", "수령", "receipt", "회계", "초기자금", "발생", "계정")
_HEADER = ("펀드", "fund", "설정", "해지", "입금", "출금", "투입", "인출", "subscription", "redemption", "transaction", "구분", "date", "기준일", "결제일", "settlement", "당일", "예정", "청구", "예상", "t+", "nav", "순유입", "이체", "amount")
_SUB = ("투입", "설정", "입금", "납입", "매입", "buy", "subscription")
_RED = ("인출", "해지", "출금", "환매", "sell", "redemption")
_CONTEXT_LATIN = ("transaction", "type", "content", "detail", "description", "memo")
_CONTEXT_HANGUL = ("구분", "내용", "적요", "사유", "비고")
_EXECUTION = ("순유입", "순투입", "증감금액", "증감액", "펀드계", "정산액", "당일이체금액", "이체예상금액", "이체예정금액", "실행금액", "결제금액", "settlement amount", "execution")
_SCHEDULE = r"예정|청구|예상|t\+|익+영업일|제\s*[0-9]+\s*영업일|[0-9]{1,2}\s*월\s*[0-9]{1,2}\s*일|[0-9]{1,2}[/-][0-9]{1,2}|[0-9]{4}-[0-9]{2}-[0-9]{2}"


def total_text(x: str) -> str:
    t = f"lower(trim({x}))"
    return f"({t} IN ('total', '총 계', '총계', '설정 합계', '해지 합계') OR contains({t}, 'subtotal') OR suffix({t}, '소계') OR suffix({t}, '합계') OR regexp_matches({t}, '[0-9]+\\s*개\\s*펀드') OR suffix(trim({t}, '[](){{}}<>'), '계'))"


def direction(x: str) -> str:
    return f"CASE WHEN {words(x, *_SUB)} AND NOT {words(x, *_RED)} THEN 'SUB' WHEN {words(x, *_RED)} AND NOT {words(x, *_SUB)} THEN 'RED' END"


_ONE = "^[.zZ]*(t[.zZ]*[aA]|[aA][.zZ]*t)[.zZ]*$"
_filled = "length(replace(k, '.', ''))"
_SPREADS = rf"(NOT {words('lower(shown)', *_UNITS)} AND ({words('lower(shown)', *_ORDER)} OR regexp_matches(lower(shown), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|예정|청구|예상|t\+|t일|execution|실행')))"

GRID = rf"""{CELLS},
wid AS (SELECT {_B}, max(col_no) AS width, max(row_no) AS height FROM cel GROUP BY {_B}),
tok AS (SELECT *, regexp_replace(regexp_replace(cell, '[\s\p{{Z}}]+', '', 'g'), '(?i)krw|[₩￦원]', '', 'g') AS n FROM cel),
nor AS (SELECT {_B}, row_no, col_no, CASE WHEN cell IN ('|', '\|') THEN '' WHEN regexp_full_match(n, '{NUM}') THEN n ELSE cell END AS v FROM tok),
pad AS (SELECT w.doc_id, w.section_no, w.block_no, w.height, r.row_no, g.col_no FROM wid w CROSS JOIN LATERAL (SELECT CAST(unnest(generate_series(1, w.height)) AS INTEGER) AS row_no) r CROSS JOIN LATERAL (SELECT CAST(unnest(generate_series(1, w.width)) AS INTEGER) AS col_no) g),
gri AS (SELECT p.*, coalesce(n.v, '') AS v FROM pad p LEFT JOIN nor n USING (doc_id, section_no, block_no, row_no, col_no)),
let AS (SELECT *, CASE WHEN v = '' THEN '.' WHEN regexp_full_match(v, '{NUM}') THEN CASE WHEN regexp_full_match(v, '[A-Z0-9]{{3,}}') THEN CASE WHEN regexp_matches(v, '[1-9]') THEN 'A' ELSE 'Z' END ELSE CASE WHEN regexp_matches(v, '[1-9]') THEN 'a' ELSE 'z' END END
 WHEN upper(v) IN ('TRUE', 'FALSE') THEN 'b' WHEN regexp_full_match(v, '[A-Z0-9]{{3,}}') THEN 'c' ELSE 't' END AS l FROM gri),
ro0 AS (SELECT {_B}, row_no, any_value(height) AS height, string_agg(l, '' ORDER BY col_no) AS k, list(v ORDER BY col_no) AS vs, list(v ORDER BY col_no) FILTER (v <> '') AS f, lower(string_agg(v, ' ' ORDER BY col_no) FILTER (v <> '')) AS j FROM let GROUP BY {_B}, row_no),
ro1 AS (SELECT *, len(list_filter(f[1:3], lambda z: {total_text("z")})) > 0 AS total, {_filled} <= 4 AND len(list_filter(f, lambda z: contains(z, ':'))) > 0 AND len(list_filter(f, lambda z: {words("lower(z)", *_ORDER)} AND NOT {words("lower(z)", *_UNITS)})) = 0 AS preamble FROM ro0),
ro2 AS (SELECT *, CASE WHEN regexp_matches(k, '[az]') THEN regexp_extract(k, '^([^az]*)[az]', 1) ELSE regexp_extract(k, '^([^AZ]*)[AZ]', 1) END AS b0 FROM ro1),
ro3 AS (SELECT *, NOT total AND NOT preamble AND {_filled} >= 3 AND regexp_matches(k, '^.+[aA]') AND regexp_matches(substring(CASE WHEN b0 = '' THEN substring(k, 1, 4) ELSE b0 END, 1, 8), '[AZct]') AS data,
 {_filled} >= 2 AND (regexp_matches(k, 't.*t') OR {words("j", *_HEADER)}) AS heady, CASE WHEN {_filled} >= 2 THEN {" + ".join(f"CASE WHEN contains(j, '{w}') THEN 2 ELSE 0 END" for w in _HEADER)} + CASE WHEN length(regexp_replace(k, '[^t]', '', 'g')) >= 2 THEN length(regexp_replace(k, '[^t]', '', 'g')) ELSE 0 END ELSE 0 END AS score FROM ro2),
row AS (SELECT *, coalesce(NOT total AND NOT preamble AND NOT data AND regexp_matches(substring(k, 1, 4), '[AZc]|t.*t') AND regexp_matches(k, '^.+[zZ]') AND NOT regexp_matches(k, '^.+[aA]') AND NOT lead(total) OVER w AND NOT lead(preamble) OVER w AND regexp_matches(lead(k) OVER w, '{_ONE}'), false) AS seed FROM ro3 WINDOW w AS (PARTITION BY {_B} ORDER BY row_no)),
fir AS (SELECT {_B}, any_value(height) AS height, min(row_no) FILTER (data OR total OR seed) AS first, arg_max(row_no, score * 1000000 - row_no) AS best, max(score) AS top FROM row GROUP BY {_B}),
sta AS (SELECT f.*, coalesce((SELECT max(r.row_no) + 1 FROM row r WHERE r.doc_id = f.doc_id AND r.section_no = f.section_no AND r.block_no = f.block_no AND r.row_no <= f.first - 2 AND (NOT r.heady OR r.preamble)), 1) AS start FROM fir f),
tab AS (SELECT {_B}, header_at, CASE WHEN first IS NOT NULL THEN first ELSE header_at + 1 END AS data_at FROM (SELECT *, CAST(CASE WHEN height < 2 THEN NULL WHEN first > 1 THEN start WHEN first IS NULL AND top > 0 AND best < height THEN best END AS INTEGER) AS header_at FROM sta) WHERE header_at IS NOT NULL),
hd0 AS (SELECT g.*, last_value(nullif(g.v, '') IGNORE NULLS) OVER (PARTITION BY g.doc_id, g.section_no, g.block_no, g.row_no ORDER BY g.col_no) AS shown FROM gri g JOIN tab t USING (doc_id, section_no, block_no) WHERE g.row_no >= t.header_at AND g.row_no < t.data_at),
hd1 AS (SELECT *, CASE WHEN v = '' AND {_SPREADS} THEN shown ELSE v END AS part FROM hd0),
hd2 AS (SELECT *, row_number() OVER (PARTITION BY {_B}, col_no, part ORDER BY row_no) AS nth FROM hd1),
hdr AS (SELECT {_B}, col_no, coalesce(string_agg(part, ' / ' ORDER BY row_no) FILTER (part <> '' AND nth = 1), '') AS label FROM hd2 GROUP BY {_B}, col_no)"""

_any = "(core OR explicit OR net OR scheduled OR ordered)"
LABELS = rf"""la0 AS (SELECT DISTINCT label, lower(label) AS low, regexp_replace(label, '[^0-9a-z가-힣]+', '', 'g') AS bare, regexp_replace(lower(label), '[^0-9a-z가-힣]+', '', 'g') AS key, coalesce(list_filter(list_transform(string_split(lower(label), '/'), lambda z: trim(z)), lambda z: z <> '' AND NOT regexp_full_match(z, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND z NOT IN ('운용지시서', 'buy&sell'))[-1], lower(label)) AS part FROM hdr),
la1 AS (SELECT *, {words("low", *_UNITS)} AS units, {words("low", *_SIDE)} AS side, {words("low", "합산", "누계", "총합", "subtotal", "total", "ratio", "nav대비", "nav ratio")} AS sums, bare IN ('금액', '금액원', 'amount', 'amountkrw', 'amountwon') AS plain FROM la0),
la2 AS (SELECT *, NOT units AND {words("low", *_ORDER)} AND NOT regexp_matches(low, '^순[투유]입') AS ordered, NOT units AND {words("low", *_EXPLICIT)} AS explicit, {words("low", *_NET)} AS net,
 NOT units AND regexp_matches(low, '예정|청구|예상|t\+|t일|d\s*\+\s*[0-9]+|익+영업일|제\s*[0-9]+\s*영업일|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND {words("low", "금액", "amount", "투입", "인출", "입금", "출금", "buy", "sell", "subscription", "redemption")} AS scheduled,
 {words("low", "금액", "amount")} AND {words("low", "설정", "해지", "입금", "출금", "투입", "인출", "납입", "결제", "buy", "sell", "subscription", "redemption")} AS generic FROM la1),
la3 AS (SELECT *, NOT sums AND NOT units AND NOT {words("low", "보수", "fee", "이용료", "수령", "receipt", "회계", "초기자금", "발생", "계정")} AND (explicit OR net OR scheduled OR generic OR ordered) AS core,
 {words("low", *_CONTEXT_LATIN)} OR {words("bare", *_CONTEXT_HANGUL)} OR bare IN ('거래유형', '거래유형명') AS context, contains(bare, '구분') OR bare IN ('거래유형', '거래유형명') OR {words("low", "transaction", "type")} AS grouping,
 NOT side AND ({words("low", "fund code", "fund name", "product name", "asset name", "manager", "custodian")} OR {words("bare", "펀드코드", "수탁코드", "펀드명", "상품명", "자산명", "운용사", "수탁은행", "판매사", "환매사")}) AS strong,
 label <> '' AND NOT explicit AND NOT net AND NOT scheduled AND NOT ordered AND NOT side AND NOT {words("part", *_UNITS)} AND NOT {words("part", "transaction", "type", "content", "detail", "description", "memo", "date", "settlement", "nav", "price", "custodian", "buy&sell")} AND NOT {words("regexp_replace(part, '[^0-9a-z가-힣]+', '', 'g')", "구분", "내용", "적요", "사유", "비고", "기준일", "결제일", "기준가", "수탁은행", "수익은행")} AS identity FROM la2),
lab AS (SELECT *, {_any} AS pays, units AND {_any} AS mixed, NOT sums AND (plain OR CASE WHEN units AND {_any} THEN {words("low", "금액", "amount")} ELSE NOT units AND {_any} END) AS relevant FROM la3),
col AS (SELECT h.doc_id, h.section_no, h.block_no, h.col_no, l.* FROM hdr h JOIN lab l USING (label)),
cat AS (SELECT {_B}, coalesce(min(col_no) FILTER ({words("low", "펀드코드", "fund code")} OR {words("key", "펀드코드", "fundcode")}), min(col_no) FILTER ({words("low", "수탁코드", "code")})) AS code_at,
 coalesce(min(col_no) FILTER ({words("low", "펀드명", "fund name")} OR {words("key", "펀드명", "fundname")}), min(col_no) FILTER ({words("key", "상품명", "productname", "자산명", "assetname")})) AS name_at,
 coalesce(min(col_no) FILTER ({words("key", "운용사명", "externalfundmanager", "managername")}), min(col_no) FILTER ({words("low", "운용사", "manager")} AND NOT {words("low", "코드", "code", "id")})) AS manager_at FROM col GROUP BY {_B})"""

BODY = rf"""{GRID}, {LABELS},
bod AS (SELECT g.doc_id, g.section_no, g.block_no, g.row_no - t.data_at + 1 AS row_no, g.col_no, g.v AS own, CASE WHEN c.strong OR c.grouping THEN coalesce(last_value(nullif(g.v, '') IGNORE NULLS) OVER (PARTITION BY g.doc_id, g.section_no, g.block_no, g.col_no ORDER BY g.row_no), '') ELSE g.v END AS v
 FROM gri g JOIN tab t USING (doc_id, section_no, block_no) JOIN col c USING (doc_id, section_no, block_no, col_no) WHERE g.row_no >= t.data_at),
br0 AS (SELECT r.doc_id, r.section_no, r.block_no, r.row_no - t.data_at + 1 AS row_no, r.k, r.total, r.data, r.preamble, r.vs FROM row r JOIN tab t USING (doc_id, section_no, block_no) WHERE r.row_no >= t.data_at),
br1 AS (SELECT b.*, coalesce(regexp_matches(b.k, '{_ONE}') AND NOT b.total AND NOT b.preamble AND (x.identity OR x.strong) AND y.pays, false) AS continues FROM br0 b
 LEFT JOIN col x ON x.doc_id = b.doc_id AND x.section_no = b.section_no AND x.block_no = b.block_no AND x.col_no = instr(b.k, 't') LEFT JOIN col y ON y.doc_id = b.doc_id AND y.section_no = b.section_no AND y.block_no = b.block_no AND y.col_no = length(regexp_extract(b.k, '^([^aA]*)', 1)) + 1),
fr0 AS (SELECT {_B}, row_no, list(v ORDER BY col_no) FILTER (v <> '') AS f, string_agg(CASE WHEN v = '' THEN '.' WHEN regexp_full_match(v, '{NUM}') THEN CASE WHEN regexp_full_match(v, '[A-Z0-9]{{3,}}') THEN 'A' WHEN regexp_matches(v, '[1-9]') THEN 'a' ELSE 'z' END ELSE 't' END, '' ORDER BY col_no) AS k FROM bod GROUP BY {_B}, row_no),
bro AS (SELECT b.*, b.data OR b.continues OR coalesce(NOT b.total AND NOT b.preamble AND NOT b.data AND regexp_matches(substring(b.k, 1, 4), '[AZc]|t.*t') AND regexp_matches(b.k, '^.+[zZ]') AND NOT regexp_matches(b.k, '^.+[aA]') AND lead(b.continues) OVER w, false)
 OR b.total AND regexp_matches(b.k, '[aA]') AND len(list_filter(b.vs, lambda z: {words("lower(z)", "입금소계", "출금소계", "설정소계", "해지소계")})) > 0 AND len(list_filter(f.f[1:3], lambda z: {total_text("z")})) = 0 AND len(f.f) >= 3 AS kept
 FROM br1 b JOIN fr0 f USING (doc_id, section_no, block_no, row_no) WINDOW w AS (PARTITION BY b.doc_id, b.section_no, b.block_no ORDER BY b.row_no))"""

ROWS = rf"""{BODY},
rws AS (SELECT b.doc_id, b.section_no, b.block_no, b.row_no, b.total, b.data, b.kept,
 nullif(max(CASE WHEN d.col_no = c.code_at THEN {S.squeeze("d.own")} END), '') AS code, nullif(max(CASE WHEN d.col_no = c.name_at THEN {S.squeeze("d.own")} END), '') AS name, nullif(max(CASE WHEN d.col_no = c.manager_at THEN {S.squeeze("d.own")} END), '') AS manager,
 nullif(max(CASE WHEN d.col_no = c.code_at THEN {S.squeeze("d.v")} END), '') AS filled_code, nullif(max(CASE WHEN d.col_no = c.manager_at THEN {S.squeeze("d.v")} END), '') AS filled_manager
 FROM bro b JOIN bod d USING (doc_id, section_no, block_no, row_no) JOIN cat c USING (doc_id, section_no, block_no) GROUP BY ALL)"""

WHOLE = r"regexp_matches(section, '^\s*\[(HTML|MHT)\b')"
_PRUNED = rf"""{BODY},
som AS (SELECT b.doc_id, b.section_no, b.block_no, bool_or(b.kept) AS anykept, any_value({{WHOLE}}) AS whole FROM bro b JOIN sec USING (doc_id, section_no) GROUP BY b.doc_id, b.section_no, b.block_no),
kro AS (SELECT b.doc_id, b.section_no, b.block_no, b.row_no, row_number() OVER (PARTITION BY b.doc_id, b.section_no, b.block_no ORDER BY b.row_no) AS n FROM bro b JOIN som USING (doc_id, section_no, block_no) WHERE b.kept OR NOT anykept OR whole),
kce AS (SELECT k.doc_id, k.section_no, k.block_no, CAST(k.n AS INTEGER) AS row_no, d.col_no, d.v FROM kro k JOIN bod d USING (doc_id, section_no, block_no, row_no)),
cst AS (SELECT {_B}, col_no, count(*) FILTER (v <> '' AND NOT regexp_full_match(v, '{NUM}')) AS texts, coalesce(bool_and(lower(regexp_replace(v, '[^0-9a-z가-힣]+', '', 'g')) IN ('입금', '출금', '환매신청', '환매', '설정', '해지', 'buy', 'sell', 'subscription', 'redemption')) FILTER (v <> '' AND NOT regexp_full_match(v, '{NUM}')), true) AS ways,
 coalesce(bool_or(NOT {total_text("v")}) FILTER (v <> '' AND NOT regexp_full_match(v, '{NUM}')), false) AS said, coalesce(bool_or(regexp_full_match(v, '{NUM}') AND regexp_matches(v, '[1-9]')), false) AS paid FROM kce GROUP BY {_B}, col_no),
cs2 AS (SELECT c.*, s.texts >= 2 AND s.ways AS valued, s.said, s.paid, bool_or(c.context) OVER w AS ctx FROM col c JOIN cst s USING (doc_id, section_no, block_no, col_no) WINDOW w AS (PARTITION BY c.doc_id, c.section_no, c.block_no)),
cs3 AS (SELECT *, relevant OR ctx AND plain AND NOT units AS rel FROM cs2),
cs4 AS (SELECT *, bool_or(NOT mixed AND rel AND paid) OVER w AS clean FROM cs3 WINDOW w AS (PARTITION BY {_B})),
cs5 AS (SELECT *, identity OR context AND said OR valued OR NOT (mixed AND clean) AND rel AND paid AS keep FROM cs4),
cs6 AS (SELECT c.*, bool_or(c.keep) OVER w AND NOT s.whole AS somecol FROM cs5 c JOIN som s USING (doc_id, section_no, block_no) WINDOW w AS (PARTITION BY c.doc_id, c.section_no, c.block_no)),
pco AS (SELECT {_B}, col_no AS old_no, CAST(row_number() OVER (PARTITION BY {_B} ORDER BY col_no) AS INTEGER) AS col_no, CASE WHEN valued AND NOT context AND somecol THEN '구분' ELSE label END AS label FROM cs6 WHERE keep OR NOT somecol),
pce AS (SELECT k.doc_id, k.section_no, k.block_no, k.row_no, p.col_no, p.label, k.v FROM kce k JOIN pco p ON p.doc_id = k.doc_id AND p.section_no = k.section_no AND p.block_no = k.block_no AND p.old_no = k.col_no)"""

PRUNED = _PRUNED.replace("{WHOLE}", "false")
#: Tables of pages and web archives are read whole.
READ = _PRUNED.replace("{WHOLE}", WHOLE)

DATES = rf"""dl0 AS (SELECT payload_id AS doc_id, raw_text AS t, list_filter(list_transform(string_split_regex(raw_text, '\r\n|\n|\r'), lambda z: {S.squeeze("z")}), lambda z: z <> '') AS lines FROM task_payloads WHERE raw_text IS NOT NULL),
dl1 AS (SELECT *, array_to_string(lines[1:16], chr(10)) AS head FROM dl0),
dl2 AS (SELECT doc_id, t, head, CASE WHEN regexp_matches(t, '[0-9]{{4}}\s*년\s*[0-9]{{1,2}}\s*월\s*[0-9]{{1,2}}\s*일') THEN regexp_extract(t, '([0-9]{{4}})\s*년\s*([0-9]{{1,2}})\s*월\s*([0-9]{{1,2}})\s*일', ['y', 'm', 'd'])
 WHEN regexp_matches(head, '(?i)(기준일(자)?|결제일|document\s*date|settlement\s*date)\s*[:：]?\s*[0-9]{{4}}\s*[./-]?\s*[0-9]{{1,2}}\s*[./-]?\s*[0-9]{{1,2}}') THEN regexp_extract(head, '(?i)(?:기준일(?:자)?|결제일|document\s*date|settlement\s*date)\s*[:：]?\s*([0-9]{{4}})\s*[./-]?\s*([0-9]{{1,2}})\s*[./-]?\s*([0-9]{{1,2}})', ['y', 'm', 'd'])
 WHEN regexp_matches(head, '(?im)^\s*date\s*[:：]?\s*[0-9]{{4}}\s*[./-]?\s*[0-9]{{1,2}}\s*[./-]?\s*[0-9]{{1,2}}\s*$') THEN regexp_extract(head, '(?im)^\s*date\s*[:：]?\s*([0-9]{{4}})\s*[./-]?\s*([0-9]{{1,2}})\s*[./-]?\s*([0-9]{{1,2}})\s*$', ['y', 'm', 'd'])
 WHEN regexp_matches(t, '[0-9]{{4}}[-/.][0-9]{{1,2}}[-/.][0-9]{{1,2}}') THEN regexp_extract(t, '([0-9]{{4}})[-/.]([0-9]{{1,2}})[-/.]([0-9]{{1,2}})', ['y', 'm', 'd']) END AS g FROM dl1),
dd AS (SELECT doc_id, CASE WHEN g IS NOT NULL THEN concat_ws('-', g.y, lpad(g.m, 2, '0'), lpad(g.d, 2, '0')) END AS base_date, CASE WHEN g IS NOT NULL THEN 'text' END AS source FROM dl2)"""

_meta = words("low", "manager", "custodian", "bank", "운용사", "수탁은행", "판매사", "환매사")
_rank = f"CASE WHEN {words('low', *_SUB)} AND {words('low', *_RED)} THEN CASE WHEN contains(low, '설정') AND contains(low, '해지') THEN 0 WHEN contains(low, '납입') AND {words('low', '출금', '인출')} THEN 1 WHEN contains(low, '입금') AND {words('low', '출금', '인출')} THEN 2 WHEN contains(low, '투입') AND {words('low', '출금', '인출')} THEN 3 ELSE 4 END"
_whole = "CASE WHEN contains(key, '펀드계') THEN -10 WHEN contains(key, '투자일임') OR contains(key, '수익증권') THEN 1 ELSE 0 END"
_zkey = "regexp_replace(z, '[^0-9a-z가-힣]+', '', 'g')"
_generic = f"({_zkey} IN ('금액', '금액원', 'amount', 'amountkrw', 'amountwon') OR regexp_matches(z, '{_SCHEDULE}') AND ({direction('z')}) IS NULL)"
_SEGMENT = f"CASE WHEN ({words('z', '금액', 'amount')} OR {_generic}) AND z <> '' THEN {_rank.replace('(low, ', '(z, ')} WHEN {_generic} THEN 10 END END"
UNPIVOT = rf"""{READ}, {DATES},
sp0 AS (SELECT p.doc_id, p.section_no, p.block_no, p.col_no, p.label, lower(p.label) AS low, regexp_replace(lower(p.label), '[^0-9a-z가-힣]+', '', 'g') AS key, d.base_date FROM pco p LEFT JOIN dd d USING (doc_id)),
sp1 AS (SELECT *, CASE WHEN NOT {_meta} THEN {direction("low")} END AS direction, {words("low", *_EXECUTION)} AS net, {words("low", *_CONTEXT_LATIN)} OR {words("key", *_CONTEXT_HANGUL)} OR key IN ('거래유형', '거래유형명') AS context,
 regexp_matches(low, '{_SCHEDULE}') AS sched, TRY_CAST(regexp_extract(low, 't\s*\+\s*([0-9]+)', 1) AS INTEGER) AS plus,
 CASE WHEN regexp_matches(low, '[0-9]{{1,2}}\s*월\s*[0-9]{{1,2}}\s*일') THEN concat(lpad(regexp_extract(low, '([0-9]{{1,2}})\s*월', 1), 2, '0'), '-', lpad(regexp_extract(low, '월\s*([0-9]{{1,2}})', 1), 2, '0')) END AS md FROM sp0),
sp2 AS (SELECT *, bool_or(context) OVER (PARTITION BY {_B}) AS ctx, CASE WHEN md IS NOT NULL THEN CASE WHEN base_date IS NULL OR md <> substring(base_date, 6, 5) THEN md END WHEN sched THEN regexp_replace(regexp_replace(low, '투입|설정|입금|매입|인출|해지|출금|환매|buy|sell|subscription|redemption', '', 'g'), '\s+', '', 'g') END AS future FROM sp1),
sp3 AS (SELECT *, CASE WHEN ctx THEN list_min(list_filter(list_transform(list_transform(string_split(low, '/'), lambda z: trim(z)), lambda z: {_SEGMENT}), lambda z: z IS NOT NULL)) END + {_whole} AS rank FROM sp2),
sp4 AS (SELECT *, rank IS NULL AND (net OR direction IS NULL AND future IS NOT NULL) AS signed FROM sp3 WHERE label <> '' AND (direction IS NOT NULL OR rank IS NOT NULL OR net OR future IS NOT NULL)),
fut AS (SELECT {_B}, future, row_number() OVER (PARTITION BY {_B} ORDER BY min(col_no)) AS nth FROM sp4 WHERE plus IS NULL AND future IS NOT NULL GROUP BY {_B}, future),
sp5 AS (SELECT s.*, CAST(coalesce(s.plus, f.nth, 0) AS INTEGER) AS t_day FROM sp4 s LEFT JOIN fut f ON f.doc_id = s.doc_id AND f.section_no = s.section_no AND f.block_no = s.block_no AND f.future = s.future AND s.plus IS NULL),
sp6 AS (SELECT *, min(rank) OVER w AS best, bool_or(signed) OVER w AS netted FROM sp5 WINDOW w AS (PARTITION BY {_B}, t_day)),
spe AS (SELECT {_B}, col_no, label, t_day, best IS NOT NULL AND NOT contains(key, '펀드계') AS by_row, CASE WHEN best IS NOT NULL THEN contains(key, '펀드계') ELSE signed END AS signed, CASE WHEN best IS NULL AND NOT signed THEN direction END AS direction FROM sp6 WHERE coalesce(rank = best, false) OR best IS NULL AND (signed OR NOT netted)),
pat AS (SELECT {_B}, min(col_no) FILTER (contains(label, '펀드코드') OR contains(low, 'fund code') OR replace(low, ' ', '') IN ('수탁코드', '종목코드')) AS code_at, min(col_no) FILTER (contains(label, '펀드명') OR contains(low, 'fund name')) AS name_at FROM sp0 GROUP BY {_B}),
ctd AS (SELECT e.doc_id, e.section_no, e.block_no, e.row_no, arg_min(d, e.col_no) FILTER (d IS NOT NULL) AS row_direction FROM (SELECT c.*, {direction("lower(c.v)")} AS d FROM pce c JOIN sp1 s USING (doc_id, section_no, block_no, col_no) WHERE s.context) e GROUP BY ALL),
idn AS (SELECT c.doc_id, c.section_no, c.block_no, c.row_no, any_value(p.code_at) IS NOT NULL AS has_code, nullif(max(CASE WHEN c.col_no = p.code_at THEN {S.squeeze("c.v")} END), '') AS fund_code, nullif(max(CASE WHEN c.col_no = p.name_at THEN {S.squeeze("c.v")} END), '') AS fund_name FROM pce c JOIN pat p USING (doc_id, section_no, block_no) GROUP BY c.doc_id, c.section_no, c.block_no, c.row_no),
am0 AS (SELECT c.doc_id, c.section_no, c.block_no, c.row_no, c.col_no, i.fund_code, i.fund_name, i.has_code, s.label, s.t_day, s.by_row, s.signed, s.direction, x.row_direction, d.base_date, c.v AS cell,
 CAST(TRY_CAST(regexp_replace(replace(c.v, ',', ''), '[억만천]$', '') AS DECIMAL(24,6)) * CASE regexp_extract(c.v, '[억만천]$') WHEN '억' THEN 100000000 WHEN '만' THEN 10000 WHEN '천' THEN 1000 ELSE 1 END AS DECIMAL(38,10)) AS amount
 FROM pce c JOIN spe s USING (doc_id, section_no, block_no, col_no) JOIN idn i USING (doc_id, section_no, block_no, row_no) LEFT JOIN dd d USING (doc_id) LEFT JOIN ctd x ON x.doc_id = c.doc_id AND x.section_no = c.section_no AND x.block_no = c.block_no AND x.row_no = c.row_no
 WHERE regexp_full_match(c.v, '{NUM}') AND regexp_matches(c.v, '[1-9]') AND (i.fund_code IS NOT NULL OR NOT i.has_code AND i.fund_name IS NOT NULL AND i.fund_name NOT IN ('/', '-'))
 AND NOT (regexp_replace(lower(coalesce(i.fund_code, '')), '[^\p{{L}}\p{{N}}]+', '', 'g') IN ('합계', '총계', '소계', 'subtotal', 'grandtotal', 'total') OR {total_text("coalesce(i.fund_code, '')")} OR regexp_replace(lower(coalesce(i.fund_name, '')), '[^\p{{L}}\p{{N}}]+', '', 'g') IN ('합계', '총계', '소계', 'subtotal', 'grandtotal', 'total') OR {total_text("coalesce(i.fund_name, '')")})),
am AS (SELECT *, CASE WHEN by_row THEN CASE WHEN regexp_matches(cell, '^[+-]') THEN CASE WHEN amount < 0 THEN 'RED' ELSE 'SUB' END ELSE row_direction END WHEN signed THEN CASE WHEN amount < 0 THEN 'RED' ELSE 'SUB' END ELSE direction END AS order_type FROM am0 WHERE amount <> 0)"""
TABLE_ORDERS = f"""{UNPIVOT},
v AS (SELECT *, CASE WHEN signed THEN amount WHEN order_type = 'RED' THEN -abs(amount) ELSE abs(amount) END AS value FROM am WHERE has_code AND order_type IS NOT NULL AND base_date IS NOT NULL),
tor AS (SELECT doc_id, section_no, block_no, row_no, col_no, coalesce(fund_code, '') AS fund_code, coalesce(fund_name, '-') AS fund_name, CASE WHEN t_day = 0 THEN 'CONFIRMED' ELSE 'PENDING' END AS settle_class, order_type, base_date, t_day, {S.render(S.snap("value"))} AS transfer_amount FROM v)"""

_bare_way = direction(r"regexp_replace(lower(regexp_replace(trim(z), '^[0-9]+\.\s*', '')), '[\s\[\](){}<>:.\-_/]+', '', 'g')")
COVERED = rf"""{BODY},
ck0 AS (SELECT *, bool_or(context) OVER w AS ctx, bool_or((pays OR plain) AND NOT mixed) OVER w AS whole, {_bare_way.replace("trim(z)", "trim(label)")} AS direction,
 CASE WHEN regexp_matches(low, '[td]\s*\+\s*[0-9]+') THEN concat('T+', regexp_extract(low, '[td]\s*\+\s*([0-9]+)', 1)) WHEN contains(low, 't일') THEN 'T0' WHEN regexp_matches(low, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN regexp_extract(low, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')
 WHEN regexp_matches(low, '[0-9]{{1,2}}\s*월\s*[0-9]{{1,2}}\s*일') THEN concat('M', lpad(regexp_extract(low, '([0-9]{{1,2}})\s*월', 1), 2, '0'), 'D', lpad(regexp_extract(low, '월\s*([0-9]{{1,2}})', 1), 2, '0'))
 WHEN {words("low", "당일", "확정", "실행", "설정금액", "해지금액", "입금액", "출금액", "투입금액", "인출금액", "순유입", "순투입", "결제금액", "buy", "sell", "settlement amount", "execution amount", "subscription", "redemption")} OR plain OR core THEN 'T0' ELSE concat('COL_', col_no - 1) END AS bucket FROM col WINDOW w AS (PARTITION BY {_B})),
ck AS (SELECT *, CASE WHEN ctx AND (generic OR NOT units AND {words("low", *_ORDER)} OR key IN ('금액', '금액원', 'amount', 'amountkrw', 'amountwon')) THEN {_rank} WHEN key IN ('금액', '금액원', 'amount', 'amountkrw', 'amountwon') THEN 10 END + {_whole} END AS rank FROM ck0),
wy AS (SELECT d.doc_id, d.section_no, d.block_no, d.row_no, arg_min(w, d.col_no) FILTER (w IS NOT NULL) AS way FROM (SELECT b.*, {_bare_way.replace("trim(z)", "trim(b.v)")} AS w FROM bod b JOIN col c USING (doc_id, section_no, block_no, col_no) WHERE c.context) d GROUP BY d.doc_id, d.section_no, d.block_no, d.row_no),
pd AS (SELECT b.doc_id, b.section_no, b.block_no, b.row_no, b.col_no, c.* EXCLUDE (doc_id, section_no, block_no, col_no) FROM bod b JOIN ck c USING (doc_id, section_no, block_no, col_no) WHERE regexp_full_match(b.v, '{NUM}') AND regexp_matches(b.v, '[1-9]') AND c.label <> '' AND (c.pays OR c.plain OR c.net)),
p2 AS (SELECT *, min(rank) OVER w AS best, bool_or(net) OVER w AS netted FROM pd WINDOW w AS (PARTITION BY {_B}, row_no, bucket)),
p3 AS (SELECT p.*, y.way FROM p2 p LEFT JOIN wy y ON y.doc_id = p.doc_id AND y.section_no = p.section_no AND y.block_no = p.block_no AND y.row_no = p.row_no WHERE (best IS NULL OR coalesce(rank = best, false))
 AND (NOT mixed OR NOT whole OR EXISTS (SELECT 1 FROM pd q WHERE q.doc_id = p.doc_id AND q.section_no = p.section_no AND q.block_no = p.block_no AND q.row_no = p.row_no AND q.col_no <> p.col_no AND NOT q.mixed AND (q.pays OR q.plain)))),
bu AS (SELECT {_B}, row_no, list_sort(list(DISTINCT concat_ws('_', bucket, CASE WHEN NOT (netted AND best IS NULL) THEN coalesce(direction, way) END))) AS b FROM p3 GROUP BY {_B}, row_no),
im AS (SELECT x.doc_id, x.section_no, x.block_no, x.col_no FROM (SELECT b.doc_id, b.section_no, b.block_no, b.col_no, any_value(c.strong) AS strong, count(*) FILTER (b.own <> '') AS n, count(*) FILTER (regexp_full_match(b.own, '{NUM}')) AS m FROM bod b JOIN col c USING (doc_id, section_no, block_no, col_no) WHERE c.identity GROUP BY b.doc_id, b.section_no, b.block_no, b.col_no) x WHERE strong OR n > 0 AND m < n * 0.6),
ir AS (SELECT b.doc_id, b.section_no, b.block_no, b.row_no, string_agg(b.v, '¦' ORDER BY b.col_no) FILTER (b.v <> '') AS direct FROM bod b JOIN im USING (doc_id, section_no, block_no, col_no) GROUP BY b.doc_id, b.section_no, b.block_no, b.row_no),
rc AS (SELECT r.doc_id, r.section_no, r.block_no, r.row_no, r.total, r.data OR r.continues OR (r.kept AND r.total) AS counts, coalesce(bu.b, []) AS b, coalesce(ir.direct, '') AS direct,
 coalesce(max(CASE WHEN d.col_no = c.code_at AND regexp_full_match(d.v, '[A-Z0-9]{{3,}}') AND NOT {total_text("d.v")} THEN d.v END), '') AS code, coalesce(max(CASE WHEN d.col_no = c.name_at AND NOT regexp_full_match(d.v, '[A-Z0-9]{{3,}}') AND NOT {total_text("d.v")} THEN d.v END), '') AS name
 FROM bro r JOIN bod d USING (doc_id, section_no, block_no, row_no) JOIN cat c USING (doc_id, section_no, block_no) LEFT JOIN bu ON bu.doc_id = r.doc_id AND bu.section_no = r.section_no AND bu.block_no = r.block_no AND bu.row_no = r.row_no LEFT JOIN ir ON ir.doc_id = r.doc_id AND ir.section_no = r.section_no AND ir.block_no = r.block_no AND ir.row_no = r.row_no GROUP BY ALL),
nb AS (SELECT *, CASE WHEN NOT lag(total) OVER w AND lag(b) OVER w = b THEN lag(code) OVER w END AS c1, CASE WHEN NOT lead(total) OVER w AND lead(b) OVER w = b THEN lead(code) OVER w END AS c2, CASE WHEN NOT lag(total) OVER w AND lag(b) OVER w = b THEN lag(name) OVER w END AS n1, CASE WHEN NOT lead(total) OVER w AND lead(b) OVER w = b THEN lead(name) OVER w END AS n2 FROM rc WINDOW w AS (PARTITION BY {_B} ORDER BY row_no)),
cov AS (SELECT DISTINCT doc_id, coalesce(nullif(concat_ws('¦', nullif(coalesce(nullif(code, ''), nullif(c1, ''), c2, ''), ''), nullif(coalesce(nullif(name, ''), nullif(n1, ''), n2, ''), '')), ''), direct) AS fund, unnest(b) AS bucket FROM nb WHERE counts)"""
