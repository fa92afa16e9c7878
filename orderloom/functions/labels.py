"""What a column label or an evidence label says: direction, kind of evidence, schedule, settlement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bare, compact, contains_any, segments, squeeze

# Words of labels. Matching is 'contains' on lower case.
SUB_WORDS = ["투입", "설정", "입금", "납입", "매입", "buy", "subscription"]
RED_WORDS = ["인출", "해지", "출금", "환매", "sell", "redemption"]
NET_EVIDENCE = [
    "순유입", "순투입", "증감금액", "증감액", "펀드계", "정산액", "당일이체금액", "이체예상금액", "이체예정금액", "실행금액", "결제금액",
    "settlement amount", "execution amount", "execution",
]
NET_LABELS = ["순유입", "순투입", "증감금액", "증감액", "정산액", "당일이체금액", "이체예정금액", "실행금액", "결제금액", "settlement amount", "execution amount"]
EXPLICIT_EVIDENCE = ["설정금액", "해지금액", "입금액", "출금액", "투입금액", "인출금액", "buy", "sell", "subscription", "redemption"]
EXPLICIT_LABELS = [
    "설정금액", "해지금액", "추가설정금액", "당일인출금액", "해지신청", "설정신청", "입금액", "출금액", "투입금액", "인출금액", "매입금액", "환매금액",
    "buy", "sell", "subscription", "redemption",
]
ORDER_LABELS = [
    "설정금액", "해지금액", "추가설정금액", "당일인출금액", "해지신청", "설정신청", "입금액", "출금액", "투입금액", "인출금액", "매입금액", "환매금액",
    "buy", "sell", "subscription", "redemption", "execution amount", "당일이체금액", "amount",
]
SCHEDULE_WORDS = ["예정", "청구", "예상", "t+"]
SCHEDULE_PATTERN = r"익+영업일|제\s*\d+\s*영업일|\d{1,2}\s*월\s*\d{1,2}\s*일|\d{1,2}[/-]\d{1,2}|\d{4}-\d{2}-\d{2}"
SCHEDULED_LABELS = r"예정|청구|예상|t\+|t일|d\s*\+\s*\d+|익+영업일|제\s*\d+\s*영업일|\d{4}-\d{2}-\d{2}"
SCHEDULED_AMOUNTS = ["금액", "amount", "투입", "인출", "입금", "출금", "buy", "sell", "subscription", "redemption"]
SAME_DAY_EVIDENCE = ["당일", "확정", "실행", "당일이체", "당일투입", "당일인출", "설정금액", "해지금액", "입금액", "출금액", "buy", "sell"]
INSTRUCTION_EVIDENCE = ["subscription", "redemption", "order", "instruction", "운용지시", "지시서"]
UNIT_LABELS = ["좌수", "unit", "units", "share", "shares", "누적좌수", "전일좌수", "변경 후 누적좌수", "순투입좌수", "증감좌수"]
NON_AMOUNT = ["좌수", "unit", "units", "share", "shares", "nav대비", "nav ratio", "ratio", "%", "합산", "누계", "총합", "subtotal", "total"]
SUM_LABELS = ["합산", "누계", "총합", "subtotal", "total", "ratio", "nav대비", "nav ratio"]
SIDE_LABELS = ["보수", "fee", "이용료", "수령", "receipt", "회계", "초기자금", "발생", "계정"]
AUXILIARY_LABELS = ["금액", "amount", "보수", "fee", "이용료", "수령", "receipt", "회계", "초기자금", "발생", "계정"]
GENERIC_PARTS = ["설정", "해지", "입금", "출금", "투입", "인출", "납입", "결제", "buy", "sell", "subscription", "redemption"]
GENERIC_AMOUNTS = ["금액", "금액원", "amount", "amountkrw", "amountwon"]
CONTEXT_LATIN = ["transaction", "type", "content", "detail", "description", "memo"]
CONTEXT_HANGUL = ["구분", "내용", "적요", "사유", "비고"]
CONTEXT_WHOLE = ["거래유형", "거래유형명"]
CONTEXT_VALUES = ["입금", "출금", "환매신청", "환매", "설정", "해지", "buy", "sell", "subscription", "redemption"]
PENDING_REQUESTS = ["해지신청", "설정신청"]
STRONG_LATIN = ["fund code", "fund name", "product name", "asset name", "manager", "custodian"]
STRONG_HANGUL = ["펀드코드", "수탁코드", "펀드명", "상품명", "자산명", "운용사", "수탁은행", "판매사", "환매사"]
NO_IDENTITY_LATIN = ["transaction", "type", "content", "detail", "description", "memo", "date", "settlement", "nav", "price", "custodian", "buy&sell"]
NO_IDENTITY_HANGUL = ["구분", "내용", "적요", "사유", "비고", "기준일", "결제일", "기준가", "수탁은행", "수익은행"]
METADATA_LATIN = ["manager", "custodian", "bank"]
METADATA_HANGUL = ["운용사", "수탁은행", "판매사", "환매사"]
SIGNAL_LATIN = [
    "fund", "amount", "unit", "share", "transaction", "type", "content", "detail", "description", "memo", "remark", "subscription", "redemption",
    "execution", "settlement", "expected",
]
SIGNAL_HANGUL = [
    "펀드", "코드", "운용사", "수탁", "구분", "내용", "적요", "사유", "비고", "금액", "예상", "영업일", "정산", "결제", "좌수", "당일", "설정", "해지",
    "입금", "출금", "청구",
]


def direction(label: Column) -> Column:
    """SUB or RED where the label's words name one of them only; null else."""
    t = F.lower(label)
    sub, red = contains_any(t, SUB_WORDS), contains_any(t, RED_WORDS)
    return F.when(sub & ~red, "SUB").when(red & ~sub, "RED")


def is_explicit(label: Column, words: list[str] = EXPLICIT_EVIDENCE) -> Column:
    return contains_any(F.lower(label), words)


def is_net(label: Column, words: list[str] = NET_EVIDENCE) -> Column:
    return contains_any(F.lower(label), words)


def is_schedule(label: Column) -> Column:
    t = F.lower(label)
    return contains_any(t, SCHEDULE_WORDS) | t.rlike(SCHEDULE_PATTERN)


def is_non_amount(label: Column) -> Column:
    return contains_any(F.lower(label), NON_AMOUNT)


def evidence_kind(label: Column) -> Column:
    """explicit is tested before execution: a label may hold words of both."""
    label = F.coalesce(label, F.lit(""))
    return F.when(is_explicit(label), "explicit").when(is_net(label), "execution").otherwise("other")


def settle_class(value: Column, t_day: Column, label: Column) -> Column:
    """Schedule words, then same-day words, then words of an instruction, then the value given, then the day."""
    text = F.lower(F.coalesce(label, F.lit("")))
    given = F.upper(F.trim(value))
    return (
        F.when(is_schedule(text), "PENDING")
        .when(contains_any(text, SAME_DAY_EVIDENCE), "CONFIRMED")
        .when(contains_any(text, INSTRUCTION_EVIDENCE), "CONFIRMED")
        .when(given.isin("CONFIRMED", "PENDING"), given)
        .when(t_day == 0, "CONFIRMED")
        .when(t_day >= 1, "PENDING")
    )


def order_type(value: Column, amount: Column, label: Column) -> Column:
    """The label's direction, then the value given, then an explicit sign."""
    given = F.upper(F.trim(value))
    return F.coalesce(
        direction(F.coalesce(label, F.lit(""))),
        F.when(given.isin("SUB", "RED"), given),
        F.when(F.trim(amount).startswith("-"), "RED").when(F.trim(amount).startswith("+"), "SUB"),
    )


def output_settle(value: Column) -> Column:
    """PENDING is 1, CONFIRMED 2; another value stays."""
    t = F.trim(value)
    return F.when(t == "PENDING", "1").when(t == "CONFIRMED", "2").when(t != "", t)


def output_type(value: Column) -> Column:
    """RED is 1, SUB 3; another value stays."""
    t = F.trim(value)
    return F.when(t == "RED", "1").when(t == "SUB", "3").when(t != "", t)


def output_t_day(settle: Column, t_day: Column) -> Column:
    """01 for confirmed orders, else the day plus one in two digits at least."""
    n = (t_day + 1).cast("string")
    return F.when(settle == "CONFIRMED", "01").when(t_day.isNotNull(), F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n))


def _with(x: Column, known: list[str], **more: Column) -> Column:
    return F.struct(*(x[k].alias(k) for k in known), *(v.alias(k) for k, v in more.items()))


def _any(parts: Column, test) -> Column:
    return F.exists(parts, test)


def semantic(label: Column) -> Column:
    """A collapsed label without the leading parts that say nothing of its column (titles, dates)."""
    parts = segments(squeeze(label))
    first = F.array_position(F.transform(parts, _signals), F.lit(True))
    told = F.when((F.size(parts) > 1) & (first > 1), F.array_join(F.slice(parts, first.cast("int"), F.size(parts)), " / "))
    return F.coalesce(F.when(label.contains("/"), told), squeeze(label))


def _signals(part: Column) -> Column:
    low = F.lower(part)
    return low.rlike(r"(?<![\p{L}\p{N}_])[td]\s*\+\s*\d+(?![\p{L}\p{N}_])|\d{1,2}\s*월\s*\d{1,2}\s*일") | contains_any(low, SIGNAL_LATIN) | contains_any(bare(low), SIGNAL_HANGUL)


_BASE = ["label", "low", "parts", "bare"]
_KINDS = [*_BASE, "units", "order", "explicit", "net", "scheduled", "plain", "sums", "side"]
#: What `classes` tells of a label.
CLASSES = [*_KINDS, "core", "any", "identity_part"]
LABEL_FACTS = ["label", "low", "bare", "core", "any", "net", "plain", "units", "mixed", "relevant", "context", "grouping", "identity", "strong", "pending"]


def classes(header: Column) -> Column:
    """Per label of a header what it stands for in a document's table (LABEL_FACTS).

    The steps are transforms of one another, so that each part of a label is looked at once. A label's parts lie
    between slashes; `any` is a label over amounts of orders, `core` one needed to tell them, `mixed` one that counts
    units too, `relevant` one that a structured table keeps, `identity` (`strong`: even over digits) one that names a
    fund, `context` one whose values give a row's direction, `grouping` one whose value holds for the rows below.
    """
    has = contains_any

    def base(x: Column) -> Column:
        low = F.lower(x)
        return F.struct(x.alias("label"), low.alias("low"), segments(low).alias("parts"), bare(x).alias("bare"))

    def kinds(x: Column) -> Column:
        p, low = x["parts"], x["low"]
        return _with(
            x, _BASE,
            units=_any(p, lambda s: has(s, UNIT_LABELS)),
            order=_any(p, lambda s: has(s, ORDER_LABELS) & ~has(s, UNIT_LABELS) & ~s.rlike("^순[투유]입")),
            explicit=_any(p, lambda s: has(s, EXPLICIT_LABELS) & ~has(s, UNIT_LABELS)),
            net=_any(p, lambda s: has(s, NET_LABELS)),
            scheduled=low.rlike(SCHEDULED_LABELS) & has(low, SCHEDULED_AMOUNTS) & ~has(low, UNIT_LABELS),
            plain=x["bare"].isin(GENERIC_AMOUNTS),
            sums=has(low, SUM_LABELS),
            side=has(low, AUXILIARY_LABELS),
        )

    def parts(x: Column) -> Column:
        def amount(s: Column) -> Column:
            order = has(s, ORDER_LABELS) & ~s.rlike("^순[투유]입")
            scheduled = s.rlike(SCHEDULED_LABELS) & has(s, SCHEDULED_AMOUNTS)
            generic = s.rlike("금액|amount") & has(s, GENERIC_PARTS)
            return ~has(s, UNIT_LABELS) & ~has(s, SIDE_LABELS) & (has(s, EXPLICIT_LABELS) | has(s, NET_LABELS) | scheduled | generic | order)

        told = F.filter(x["parts"], lambda s: ~s.rlike(r"^\d{4}-\d{2}-\d{2}\z") & ~s.isin("운용지시서", "buy&sell"))
        core = ~x["sums"] & _any(x["parts"], amount)
        return _with(x, _KINDS, core=core, any=core | x["explicit"] | x["net"] | x["scheduled"] | x["order"], identity_part=F.coalesce(F.get(told, F.size(told) - 1), x["low"]))

    def facts(x: Column) -> Column:
        low, b, s = x["low"], x["bare"], x["identity_part"]
        mixed = x["units"] & x["any"]
        relevant = ~x["sums"] & (x["plain"] | F.when(mixed, low.rlike("금액|amount")).otherwise(~has(low, UNIT_LABELS) & x["any"]))
        context = has(low, CONTEXT_LATIN) | has(b, CONTEXT_HANGUL) | b.isin(CONTEXT_WHOLE)
        amount = x["explicit"] | x["net"] | x["scheduled"] | x["order"]
        identity = (x["label"] != "") & ~amount & ~x["side"] & ~has(s, UNIT_LABELS) & ~has(s, NO_IDENTITY_LATIN) & ~has(bare(s), NO_IDENTITY_HANGUL)
        return F.struct(
            x["label"].alias("label"), low.alias("low"), b.alias("bare"), x["core"].alias("core"), x["any"].alias("any"), x["net"].alias("net"), x["plain"].alias("plain"), x["units"].alias("units"),
            mixed.alias("mixed"), relevant.alias("relevant"), context.alias("context"), (b.contains("구분") | b.isin(CONTEXT_WHOLE) | low.rlike("transaction|type")).alias("grouping"), identity.alias("identity"),
            (~x["side"] & (has(low, STRONG_LATIN) | has(b, STRONG_HANGUL))).alias("strong"), _any(x["parts"], lambda p: has(p, PENDING_REQUESTS)).alias("pending"),
        )

    return F.transform(F.transform(F.transform(F.transform(header, base), kinds), parts), facts)


def spreads(value: Column) -> Column:
    """Does a label of a header row hold for the blank cells to its right?"""
    low = F.lower(value)
    order = _any(segments(low), lambda s: contains_any(s, ORDER_LABELS) & ~contains_any(s, UNIT_LABELS) & ~s.rlike("^순[투유]입"))
    return ~contains_any(low, UNIT_LABELS) & (order | low.rlike(r"\d{4}-\d{2}-\d{2}|예정|청구|예상|t\+|t일|execution|실행"))


def _first(header: Column, test) -> Column:
    """The place, from 1, of the first label that passes; null if none does."""
    at = F.array_position(F.transform(header, test), F.lit(True)).cast("int")
    return F.when(at > 0, at)


def _part_has(label: Column, *words: str) -> Column:
    """Does a label hold one of the words, spaces within them aside?"""
    low = F.lower(label)
    return contains_any(low, list(words)) | contains_any(bare(low), [w.replace(" ", "") for w in words])


def manager_at(header: Column) -> Column:
    named = lambda x: _part_has(x, "운용사명", "external fund manager", "manager name")
    other = lambda x: _part_has(x, "운용사", "manager") & ~_part_has(x, "코드", "code", "id")
    return F.coalesce(_first(header, named), _first(header, other))


def code_at(header: Column) -> Column:
    return F.coalesce(_first(header, lambda x: _part_has(x, "펀드코드", "fund code")), _first(header, lambda x: _part_has(x, "수탁코드", "code")))


def name_at(header: Column) -> Column:
    return F.coalesce(_first(header, lambda x: _part_has(x, "펀드명", "fund name")), _first(header, lambda x: _part_has(x, "상품명", "product name", "자산명", "asset name")))


def remarks_at(header: Column) -> Column:
    return _first(header, lambda x: bare(x).contains("비고") | F.lower(x).rlike("remark|note"))


def bare_direction(value: Column) -> Column:
    """The direction that a text names, numbering and punctuation aside."""
    t = section_label(value)
    sub, red = contains_any(t, SUB_WORDS), contains_any(t, RED_WORDS)
    return F.when(sub & ~red, "SUB").when(red & ~sub, "RED")


def section_label(value: Column) -> Column:
    """A heading without number and punctuation, in lower case."""
    return F.regexp_replace(F.lower(F.regexp_replace(squeeze(value), r"^\d+\.\s*(?=.)", "")), r"[\s\[\](){}<>:.\-_/]+", "")


def mixed_rank(part: Column, generic: Column) -> Column:
    """The rank of a part that names both directions (0 to 4) or is only an amount (10); null else."""
    sub, red = contains_any(part, SUB_WORDS), contains_any(part, RED_WORDS)
    out = part.rlike("출금|인출")
    both = (
        F.when(part.contains("설정") & part.contains("해지"), 0)
        .when(part.contains("납입") & out, 1)
        .when(part.contains("입금") & out, 2)
        .when(part.contains("투입") & out, 3)
        .otherwise(4)
    )
    return F.when(sub & red, both).when(generic, 10)


def whole_rank(compacted: Column) -> Column:
    """What the whole label adds to the ranks of its parts."""
    return F.when(compacted.contains("펀드계"), -10).when(compacted.rlike("투자일임|수익증권"), 1).otherwise(0)


def coverage_rank(label: Column) -> Column:
    """The rank of an amount column among those of its bucket, where rows name their direction; the lowest counts."""
    low = F.lower(label)
    amount = lambda s: (s.rlike("금액|amount") & contains_any(s, GENERIC_PARTS)) | (contains_any(s, ORDER_LABELS) & ~contains_any(s, UNIT_LABELS) & ~s.rlike("^순[투유]입")) | bare(s).isin(GENERIC_AMOUNTS)
    ranks = F.transform(F.filter(segments(low), amount), lambda s: mixed_rank(s, bare(s).isin(GENERIC_AMOUNTS)))
    return F.array_min(F.filter(ranks, lambda r: r.isNotNull())) + whole_rank(section_label(label))


def order_rank(label: Column) -> Column:
    """As `coverage_rank`, for the reading of orders: columns of a future day without a direction count too."""
    low = F.lower(semantic(label))
    future = lambda s: is_schedule(s) & direction(s).isNull()
    parts = F.filter(segments(low), lambda s: s.rlike("금액|amount") | bare(s).isin(GENERIC_AMOUNTS) | future(s))
    ranks = F.transform(parts, lambda s: mixed_rank(s, bare(s).isin(GENERIC_AMOUNTS) | future(s)))
    return F.array_min(F.filter(ranks, lambda r: r.isNotNull())) + whole_rank(bare(low))


def is_metadata(label: Column) -> Column:
    """A label of parties: words of direction in it mean nothing."""
    low = F.lower(label)
    return contains_any(low, METADATA_LATIN) | contains_any(F.regexp_replace(low, r"\s+", ""), METADATA_HANGUL)


def is_context_header(label: Column) -> Column:
    low = F.lower(label)
    return contains_any(low, CONTEXT_LATIN) | contains_any(bare(low), CONTEXT_HANGUL) | bare(low).isin(CONTEXT_WHOLE)


def is_pending_request(label: Column) -> Column:
    return contains_any(compact(label), PENDING_REQUESTS)
