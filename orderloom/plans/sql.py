"""Pieces of ANSI-like SQL from which the queries' counterparts for DuckDB are put together."""

from __future__ import annotations

# Written out again, so that a wrong word in an operator shows.
_EMPTY = ["", "-", "--", "N/A", "n/a", "null", "None"]
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_SUB = ["투입", "설정", "입금", "납입", "매입", "buy", "subscription"]
_RED = ["인출", "해지", "출금", "환매", "sell", "redemption"]
_SCHEDULE = ["예정", "청구", "예상", "t+"]
_SCHEDULE_PATTERN = r"익+영업일|제\s*[0-9]+\s*영업일|[0-9]{1,2}\s*월\s*[0-9]{1,2}\s*일|[0-9]{1,2}[/-][0-9]{1,2}|[0-9]{4}-[0-9]{2}-[0-9]{2}"
_EXPLICIT = ["설정금액", "해지금액", "입금액", "출금액", "투입금액", "인출금액", "buy", "sell", "subscription", "redemption"]
_NET = ["순유입", "순투입", "증감금액", "증감액", "펀드계", "정산액", "당일이체금액", "이체예상금액", "이체예정금액", "실행금액", "결제금액", "settlement amount", "execution amount", "execution"]
_SAME_DAY = ["당일", "확정", "실행", "당일이체", "당일투입", "당일인출", "설정금액", "해지금액", "입금액", "출금액", "buy", "sell"]
_INSTRUCTION = ["subscription", "redemption", "order", "instruction", "운용지시", "지시서"]
NON_AMOUNT = ["좌수", "unit", "share", "nav대비", "nav ratio", "ratio", "%", "합산", "누계", "총합", "subtotal", "total"]
BLOCKING = [
    "LLM_INVALID_RESPONSE_FORMAT", "FUND_DISCOVERY_EMPTY", "TRANSACTION_SLOT_EMPTY", "TRANSFER_AMOUNT_EMPTY", "SETTLE_CLASS_EMPTY", "FUND_METADATA_INCOMPLETE", "TRANSFER_AMOUNT_MISSING",
    "TRANSFER_AMOUNT_CONFLICT", "SETTLE_CLASS_MISSING", "ORDER_TYPE_MISSING", "T_DAY_MISSING", "BASE_DATE_STAGE_PARTIAL", "T_DAY_STAGE_PARTIAL", "TRANSFER_AMOUNT_STAGE_PARTIAL",
    "SETTLE_CLASS_STAGE_PARTIAL", "ORDER_TYPE_STAGE_PARTIAL",
]


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def contains_any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x{{85}}\p{{Z}}]+', ' ', 'g'))"


def compact(x: str) -> str:
    return rf"regexp_replace(lower({x}), '[\s\x{{85}}\p{{Z}}]+', '', 'g')"


def bare(x: str) -> str:
    return f"(CASE WHEN trim({x}) NOT IN ({quoted(_EMPTY)}) THEN replace(trim({x}), ' ', '') END)"


def parse(x: str) -> str:
    return rf"(CASE WHEN regexp_full_match({bare(x)}, '[+-]?[0-9][0-9,]*(\.[0-9]+)?') THEN TRY_CAST(replace({bare(x)}, ',', '') AS DECIMAL(38,10)) END)"


def snap(d: str) -> str:
    return f"(CASE WHEN abs({d} - CAST(round({d}, 0) AS DECIMAL(38,10))) < 0.000001 THEN CAST(round({d}, 0) AS DECIMAL(38,10)) ELSE {d} END)"


def render(d: str, grouped: bool = True) -> str:
    text = f"CAST(CAST(abs({d}) AS DECIMAL(38,10)) AS VARCHAR)"
    mark = "{:,}" if grouped else "{}"
    whole = f"format('{mark}', CAST(split_part({text}, '.', 1) AS BIGINT))"
    rest = f"rtrim(split_part({text}, '.', 2), '0')"
    return f"(CASE WHEN {d} IS NULL THEN NULL ELSE concat(CASE WHEN {d} < 0 THEN '-' ELSE '' END, {whole}, CASE WHEN {rest} <> '' THEN concat('.', {rest}) ELSE '' END) END)"


def canonical(x: str) -> str:
    return render(snap(parse(x)))


def source(x: str) -> str:
    d, t = parse(x), bare(x)
    fraction = rf"regexp_extract({t}, '\.([0-9]+)$', 1)"
    whole = f"format('{{:,}}', CAST(replace(regexp_extract({t}, '^[+-]?([0-9,]+)', 1), ',', '') AS BIGINT))"
    return f"(CASE WHEN {snap(d)} = {d} AND regexp_matches({fraction}, '[1-9]') THEN concat(CASE WHEN starts_with({t}, '-') THEN '-' ELSE '' END, {whole}, '.', {fraction}) ELSE {render(snap(d))} END)"


def signed(x: str, kind: str) -> str:
    return f"(CASE WHEN regexp_matches({bare(x)}, '^[+-]') THEN {parse(x)} WHEN {kind} = 'RED' THEN -{parse(x)} ELSE {parse(x)} END)"


def output_amount(x: str, kind: str) -> str:
    text = rf"regexp_replace(coalesce({source(f'trim({x})')}, trim({x})), '^\+', '')"
    return f"(CASE WHEN {kind} = 'RED' THEN regexp_replace({text}, '^-', '') ELSE {text} END)"


def year_first(x: str) -> str:
    digits = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    p = r"([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})"
    part = lambda k: f"regexp_extract({x}, '{p}', {k})"
    return (
        f"(CASE WHEN length({digits}) = 8 THEN concat_ws('-', substring({digits}, 1, 4), substring({digits}, 5, 2), substring({digits}, 7, 2)) "
        f"WHEN regexp_matches({x}, '{p}') THEN concat_ws('-', {part(1)}, lpad({part(2)}, 2, '0'), lpad({part(3)}, 2, '0')) END)"
    )


def month_first(x: str) -> str:
    p = r"^\s*([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4})\s*$"
    part = lambda k: f"regexp_extract({x}, '{p}', {k})"
    return f"(CASE WHEN regexp_matches({x}, '{p}') THEN concat_ws('-', {part(3)}, lpad({part(1)}, 2, '0'), lpad({part(2)}, 2, '0')) END)"


def short_english(x: str) -> str:
    p = r"(?i)^\s*([0-9]{1,2})-([a-z]{3})-([0-9]{2})\s*$"
    part = lambda k: f"regexp_extract({x}, '{p}', {k})"
    month = f"list_position([{quoted(_MONTHS)}], lower({part(2)}))"
    year = f"TRY_CAST({part(3)} AS INTEGER)"
    return f"(CASE WHEN regexp_matches({x}, '{p}') AND {month} > 0 THEN concat_ws('-', CAST({year} + CASE WHEN {year} >= 69 THEN 1900 ELSE 2000 END AS VARCHAR), lpad(CAST({month} AS VARCHAR), 2, '0'), lpad({part(1)}, 2, '0')) END)"


def normalize_date(x: str) -> str:
    return f"coalesce({month_first(x)}, {short_english(x)}, {year_first(x)})"


def direction(x: str) -> str:
    t = f"lower({x})"
    sub, red = contains_any(t, _SUB), contains_any(t, _RED)
    return f"(CASE WHEN {sub} AND NOT {red} THEN 'SUB' WHEN {red} AND NOT {sub} THEN 'RED' END)"


def is_schedule(x: str) -> str:
    t = f"lower({x})"
    return f"({contains_any(t, _SCHEDULE)} OR regexp_matches({t}, '{_SCHEDULE_PATTERN}'))"


def evidence_kind(x: str) -> str:
    t = f"lower(coalesce({x}, ''))"
    return f"(CASE WHEN {contains_any(t, _EXPLICIT)} THEN 'explicit' WHEN {contains_any(t, _NET)} THEN 'execution' ELSE 'other' END)"


def settle_class(value: str, day: str, label: str) -> str:
    t = f"lower(coalesce({label}, ''))"
    return (
        f"(CASE WHEN {is_schedule(t)} THEN 'PENDING' WHEN {contains_any(t, _SAME_DAY)} THEN 'CONFIRMED' WHEN {contains_any(t, _INSTRUCTION)} THEN 'CONFIRMED' "
        f"WHEN upper(trim({value})) IN ('CONFIRMED', 'PENDING') THEN upper(trim({value})) WHEN {day} = 0 THEN 'CONFIRMED' WHEN {day} >= 1 THEN 'PENDING' END)"
    )


def order_type(value: str, amount: str, label: str) -> str:
    return (
        f"coalesce({direction(f'coalesce({label}, {chr(39)}{chr(39)})')}, CASE WHEN upper(trim({value})) IN ('SUB', 'RED') THEN upper(trim({value})) END, "
        f"CASE WHEN starts_with(trim({amount}), '-') THEN 'RED' WHEN starts_with(trim({amount}), '+') THEN 'SUB' END)"
    )


def output_codes(settle: str, kind: str, day: str) -> str:
    return (
        f"CASE trim({settle}) WHEN 'PENDING' THEN '1' WHEN 'CONFIRMED' THEN '2' ELSE nullif(trim({settle}), '') END AS settle_class, "
        f"CASE trim({kind}) WHEN 'RED' THEN '1' WHEN 'SUB' THEN '3' ELSE nullif(trim({kind}), '') END AS order_type, "
        f"CASE WHEN {settle} = 'CONFIRMED' THEN '01' WHEN {day} IS NOT NULL THEN CASE WHEN length(CAST({day} + 1 AS VARCHAR)) < 2 THEN lpad(CAST({day} + 1 AS VARCHAR), 2, '0') ELSE CAST({day} + 1 AS VARCHAR) END END AS t_day"
    )


def name_key(x: str) -> str:
    return f"regexp_replace(lower(coalesce({x}, '')), '[^0-9a-z가-힣]+', '', 'g')"
