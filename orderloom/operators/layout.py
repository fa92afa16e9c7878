"""Layout recovery: documents to sections, blocks of table rows, cells, headers and bodies.

A document's text stays in its row until it is cut: sections by the delimiter, blocks by one pattern that takes
maximal runs of table lines, rows and cells by split. What a row is (data, total, preamble, continuation) is read off
its `kind`, a text with one letter a cell; blank cells are filled down by runs. So recovering tables needs no shuffle
and no window, and every step is linear in the length of the text. Columns of the documents beside `doc_id` and `text`
are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import amounts, labels, text
from ..functions.text import let

# Delimiters of sections in raw text and in structured text, and of cells.
RAW_DELIMITER = "\n\n==== SECTION ====\n\n"
MARKDOWN_DELIMITER = "\n\n<!-- SECTION -->\n\n"
CELL = " | "
#: (?d): only a line feed ends a line. The repetition is possessive: a plain one recurses once a line.
#: Maximal runs of lines that hold a cell delimiter; a blank line ends a run.
RAW_BLOCKS = r"(?md)(?:^.* \| .*$\n?)++"
#: Maximal runs of lines that begin with a bar.
MARKDOWN_BLOCKS = r"(?md)(?:^\|.*$\n?)++"
# Words that make a row look like a header.
HEADER_WORDS = [
    "펀드", "fund", "설정", "해지", "입금", "출금", "투입", "인출", "subscription", "redemption", "transaction", "구분", "date", "기준일", "결제일",
    "settlement", "당일", "예정", "청구", "예상", "t+", "nav", "순유입", "이체", "amount",
]
# Texts of total rows, whole and by their parts, and of subtotals that are orders.
TOTAL_TEXTS = ["total", "총 계", "총계", "설정 합계", "해지 합계"]
TOTAL_PARTS = r"subtotal|(?:소계|합계)\z|\d+\s*개\s*펀드"
ORDER_SUBTOTALS = ["입금소계", "출금소계", "설정소계", "해지소계", "buy subtotal", "sell subtotal", "subscription subtotal", "redemption subtotal"]


#: The outer form, its empty rows dropped afterwards: the inner one makes the optimizer filter by the size of its
#: array first, and so compute the array twice.
posexplode = F.posexplode_outer


def extra(df: DataFrame, *own: str) -> list[str]:
    """The columns of df that an operator hands on."""
    return [c for c in df.columns if c not in own]


def sections(docs: DataFrame, delimiter: str = RAW_DELIMITER) -> DataFrame:
    """(doc_id, section_no, section): the non-blank sections of docs (doc_id, text), numbered from 1."""
    keep = extra(docs, "doc_id", "text")
    s = docs.where(F.col("text").isNotNull()).select("doc_id", *keep, posexplode(F.split("text", delimiter)).alias("p", "section"))
    return s.where(F.col("section").rlike(r"\S")).select("doc_id", (F.col("p") + 1).alias("section_no"), "section", *keep)


def marker(section: Column) -> Column:
    """The kind of a section by its first line: PAGE, SHEET, HTML, EML, MHT; null else."""
    return text.blank_to_null(F.regexp_extract(section, r"^\s*\[(PAGE|SHEET|HTML|EML|MHT)\b[^\]\n]*\]", 1))


def cells(line: Column) -> Column:
    """The trimmed cells of a row; a bar at the end closes an empty cell."""
    return F.transform(F.split(F.regexp_replace(line, r" \|\s*\z", " | "), r" \| "), lambda x: text.strip(x))


def markdown_cells(line: Column) -> Column:
    """The trimmed cells of a row between bars."""
    return F.transform(F.split(F.regexp_replace(text.strip(line), r"^\|\s*|\s*\|\z", ""), r"\s*\|\s*"), lambda x: text.strip(x))


def blocks(sects: DataFrame, pattern: str = RAW_BLOCKS) -> DataFrame:
    """(doc_id, section_no, block_no, lines): the blocks of table lines of each section."""
    keep = extra(sects, "doc_id", "section_no", "section")
    b = sects.select("doc_id", "section_no", *keep, posexplode(F.regexp_extract_all("section", F.lit(pattern), F.lit(0))).alias("p", "block")).where("p IS NOT NULL")
    return b.select("doc_id", "section_no", (F.col("p") + 1).alias("block_no"), F.split(F.regexp_replace("block", r"\n\z", ""), "\n").alias("lines"), *keep)


def raw_rows(sects: DataFrame) -> DataFrame:
    """(doc_id, section_no, block_no, rows): each block as an array of rows of cells."""
    b = blocks(sects)
    return b.select("doc_id", "section_no", "block_no", F.transform("lines", cells).alias("rows"), *extra(b, "doc_id", "section_no", "block_no", "lines"))


def markdown_rows(sects: DataFrame) -> DataFrame:
    """As `raw_rows` for structured text; lines of dashes between header and body are left out."""
    r = F.transform(F.filter("lines", lambda x: ~x.rlike(r"^[|\s:\-]+\z")), markdown_cells)
    b = blocks(sects, MARKDOWN_BLOCKS)
    return b.select("doc_id", "section_no", "block_no", r.alias("rows"), *extra(b, "doc_id", "section_no", "block_no", "lines"))


def normal_cell(cell: Column) -> Column:
    """A cell without currency marks if it is an amount; a lone bar is blank; business days get their T+n."""
    ik = r"(?<![\p{L}\p{N}_])(익+)영업일(?![\p{L}\p{N}_])(?!\s*\(T\+\d+\))"
    nth = r"(?<![\p{L}\p{N}_])제\s*(\d+)\s*영업일(?![\p{L}\p{N}_])(?!\s*\(T\+\d+\))"
    days = F.length(F.regexp_extract(cell, ik, 1)).cast("string")
    aliased = F.when(cell.rlike(ik), F.regexp_replace(cell, F.lit(ik), F.concat(F.lit("$0(T+"), days, F.lit(")")))).otherwise(cell)
    aliased = F.regexp_replace(aliased, nth, "$0(T+$1)")
    return F.when(cell.isin("|", "\\|"), "").when(cell.contains("영업일"), aliased).otherwise(F.coalesce(amounts.token(cell), cell))


def kind(row: Column) -> Column:
    """One letter a cell: . blank, a amount, z zero, A and Z the same where the digits could be a code, c code, t text, b true or false."""

    def one(c: Column) -> Column:
        code = c.rlike(r"^[A-Z0-9]{3,}\z")
        amount = c.rlike(amounts.TOKEN)
        more = c.rlike("[1-9]")
        return (
            F.when(c == "", ".")
            .when(amount, F.when(code, F.when(more, "A").otherwise("Z")).otherwise(F.when(more, "a").otherwise("z")))
            .when(F.upper(c).isin("TRUE", "FALSE"), "b")
            .when(code, "c")
            .otherwise("t")
        )

    return F.array_join(F.transform(row, one), "")


def is_total_text(value: Column) -> Column:
    """Does a cell say total, subtotal or sum? A bracketed one that ends with the syllable for sum does."""
    t = F.lower(text.strip(value))
    return t.isin(TOTAL_TEXTS) | t.rlike(TOTAL_PARTS) | t.rlike(r"계[\[\](){}<>]*\z")


def is_total(row: Column) -> Column:
    """One of the first three filled cells says total."""
    return F.exists(F.slice(F.filter(row, lambda x: x != ""), 1, 3), is_total_text)


def is_preamble(row: Column, kinds: Column) -> Column:
    """A row of at most four filled cells, one with a colon and none a label over amounts: what stands before a table."""
    order = lambda x: F.exists(text.segments(F.lower(x)), lambda s: text.contains_any(s, labels.ORDER_LABELS) & ~text.contains_any(s, labels.UNIT_LABELS) & ~s.rlike("^순[투유]입"))
    return (F.length(F.replace(kinds, F.lit("."), F.lit(""))) <= 4) & F.exists(row, lambda x: x.contains(":")) & ~F.exists(row, order)


_ONE_AMOUNT = r"^[.zZ]*(?:t[.zZ]*[aA]|[aA][.zZ]*t)[.zZ]*\z"


def _facts(row: Column) -> Column:
    k = kind(row)
    return F.struct(k.alias("k"), is_total(row).alias("total"), is_preamble(row, k).alias("preamble"))


def is_data(x: Column) -> Column:
    """x: a row's facts. Three filled cells or more, an amount behind the first column, and a code or text before the first amount."""
    k = x["k"]
    before = F.when(k.rlike("[az]"), F.regexp_extract(k, "^([^az]*)[az]", 1)).otherwise(F.regexp_extract(k, "^([^AZ]*)[AZ]", 1))
    lead = F.substring(F.when(before == "", F.substring(k, 1, 4)).otherwise(before), 1, 8)
    return ~x["total"] & ~x["preamble"] & (F.length(F.replace(k, F.lit("."), F.lit(""))) >= 3) & k.rlike("^.+[aA]") & lead.rlike("[AZct]")


def _is_seed(x: Column, nxt: Column, followed: Column) -> Column:
    """A row that names a fund over zeros only, whose amount stands in the row below."""
    k = x["k"]
    named = F.substring(k, 1, 4).rlike("[AZc]|t.*t")
    return F.coalesce(~x["total"] & ~x["preamble"] & ~is_data(x) & named & k.rlike("^.+[zZ]") & ~k.rlike("^.+[aA]") & nxt.isNotNull() & ~nxt["total"] & ~nxt["preamble"] & followed, F.lit(False))


def header_score(row: Column, kinds: Column) -> Column:
    """Two for each header word in a row, plus the number of its text cells if two or more; nothing for less than two filled cells."""
    low = F.lower(F.array_join(F.filter(row, lambda c: c != ""), " "))
    words = F.lit(0)
    for w in HEADER_WORDS:
        words = words + F.when(low.contains(w), 2).otherwise(0)
    texts = F.length(F.regexp_replace(kinds, "[^t]", ""))
    return F.when(F.length(F.replace(kinds, F.lit("."), F.lit(""))) >= 2, words + F.when(texts >= 2, texts).otherwise(0)).otherwise(0)


def _looks_header(row: Column, kinds: Column) -> Column:
    """Is the header score above zero? One pattern tells."""
    return (F.length(F.replace(kinds, F.lit("."), F.lit(""))) >= 2) & (kinds.rlike("t.*t") | text.contains_any(F.lower(F.array_join(row, " ")), HEADER_WORDS))


def fill_runs(values: Column) -> Column:
    """An array in which blanks take the nearest value before them.

    Blank and filled places become a text of two letters; its runs tell for each place which filled one it takes.
    """
    places = F.array_join(F.transform(values, lambda x: F.when(x == "", ".").otherwise("x")), "")

    def of(v: Column) -> Column:
        runs = F.regexp_extract_all(v["places"], F.lit(r"^\.+|x\.*"), F.lit(0))
        which = F.flatten(F.transform(runs, lambda t, g: F.array_repeat(g, F.length(t))))
        none = F.filter(F.array(F.lit("")), lambda _: v["places"].startswith("."))
        return F.struct(which.alias("at"), F.concat(none, F.filter(v["values"], lambda x: x != "")).alias("own"))

    found = let(F.struct(values.alias("values"), places.alias("places")), of)
    return let(found, lambda v: F.transform(v["at"], lambda g: F.get(v["own"], g)))


def structure(rows: DataFrame) -> DataFrame:
    """Adds where a block's header and body begin (`header_at`, `data_at`, from 1; null: no table), cells made normal
    and rows of one width (`grid`), and each row's `facts`.

    The body begins at the first row of data, total or split seed; the header is the run of header-like rows above it.
    Where no row is data, the header is the row of the highest score, unless it is the last.
    """
    wide = F.struct(F.col("rows").alias("r"), F.array_max(F.transform("rows", F.size)).alias("w"))
    t = rows.withColumn("grid", let(wide, lambda v: F.transform(v["r"], lambda r: F.concat(F.transform(r, normal_cell), F.array_repeat(F.lit(""), v["w"] - F.size(r))))))
    t = t.withColumn("facts", F.transform("grid", _facts))
    body = F.transform("facts", lambda x, i: is_data(x) | x["total"] | _is_seed(x, F.get("facts", i + 1), F.get("facts", i + 1)["k"].rlike(_ONE_AMOUNT)))
    t = t.withColumn("first", F.array_position(body, True).cast("int"))
    above = F.slice(F.arrays_zip(F.col("grid").alias("r"), F.col("facts").alias("f")), F.lit(1), F.greatest(F.col("first") - 2, F.lit(0)))
    stops = F.transform(above, lambda z: ~_looks_header(z["r"], z["f"]["k"]) | z["f"]["preamble"])
    last = F.size(stops) - F.array_position(F.reverse(stops), True).cast("int") + 1
    start = F.when(F.array_contains(stops, True), last + 1).otherwise(1)
    scores = F.when(F.col("first") == 0, F.transform(F.arrays_zip(F.col("grid").alias("r"), F.col("facts").alias("f")), lambda z: header_score(z["r"], z["f"]["k"])))
    t = t.withColumn("scores", scores).withColumn("start", start)
    best = F.array_position("scores", F.array_max("scores")).cast("int")
    alone = (F.array_max("scores") > 0) & (best < F.size("grid"))
    many = F.size("grid") > 1
    t = t.withColumn("header_at", F.when(many, F.when(F.col("first") > 1, F.col("start")).when((F.col("first") == 0) & alone, best)))
    t = t.withColumn("data_at", F.when(F.col("header_at").isNotNull(), F.when(F.col("first") > 0, F.col("first")).otherwise(F.col("header_at") + 1)))
    return t.drop("scores", "start", "first", "rows")


def tables(rows: DataFrame) -> DataFrame:
    """Blocks as tables: (…, header, header_at, data_at, classes, code_at, name_at, manager_at, body).

    `header` is the header's rows collapsed into one, `classes` what its labels stand for (labels.classes). `body` holds
    for each row below its cells as printed (`own`), its cells filled down (`row`), its `kind`, whether it is a
    `total`, `data`, and whether it is `kept`: data, a continuation, a split seed or a subtotal of orders. A block
    that is no table keeps its row with nulls: a filter here would be pushed below and compute all of it twice.
    """
    t = structure(rows)
    top = F.slice("grid", F.col("header_at"), F.col("data_at") - F.col("header_at"))
    t = t.withColumn("header", F.when(F.col("header_at").isNotNull(), collapse_header(top)))
    t = t.withColumn("below", F.slice(F.arrays_zip(F.col("grid").alias("own"), F.col("facts").alias("facts")), F.col("data_at"), F.size("grid"))).drop("grid", "facts")
    t = t.withColumn("classes", labels.classes(F.col("header")))
    t = t.withColumn("code_at", labels.code_at(F.col("header"))).withColumn("name_at", labels.name_at(F.col("header"))).withColumn("manager_at", labels.manager_at(F.col("header")))
    carry = F.transform("classes", lambda c: c["strong"] | c["grouping"])
    t = t.withColumn("carry", carry)
    blank = F.exists("below", lambda z: F.exists(F.arrays_zip(z["own"].alias("c"), F.col("carry").alias("y")), lambda q: q["y"] & (q["c"] == "")))
    t = t.withColumn("filled", F.when(blank, F.transform("carry", lambda y, j: F.when(y, fill_runs(F.transform("below", lambda z: F.get(z["own"], j)))))))
    row = lambda z, i: F.when(F.col("filled").isNull(), z["own"]).otherwise(F.transform(z["own"], lambda c, j: F.when(c == "", F.coalesce(F.get(F.get("filled", j), i), F.lit(""))).otherwise(c)))
    t = t.withColumn("below", F.transform("below", lambda z, i: F.struct(z["own"].alias("own"), row(z, i).alias("row"), z["facts"].alias("facts"), is_data(z["facts"]).alias("data")))).drop("carry", "filled")
    t = t.withColumn("below", F.transform("below", lambda z: F.struct(z["own"].alias("own"), z["row"].alias("row"), z["facts"].alias("facts"), z["data"].alias("data"), _continues(z, F.col("classes")).alias("continues"))))

    def full(z: Column, i: Column) -> Column:
        nxt = F.get("below", i + 1)
        kept = z["data"] | z["continues"] | _is_seed(z["facts"], nxt["facts"], nxt["continues"]) | _order_subtotal(z)
        return F.struct(z["own"].alias("own"), z["row"].alias("row"), z["facts"]["k"].alias("kind"), z["facts"]["total"].alias("total"), z["data"].alias("data"), z["continues"].alias("continues"), kept.alias("kept"))

    return t.withColumn("body", F.transform("below", full)).drop("below")


def _continues(z: Column, classes: Column) -> Column:
    """One text under a label of identity and one amount under a label of amounts: the row goes on with the one above."""
    k = z["facts"]["k"]
    shape = k.rlike(_ONE_AMOUNT) & ~z["facts"]["total"] & ~z["facts"]["preamble"]
    named = F.get(classes, F.instr(k, "t") - 1)
    paid = F.get(classes, F.length(F.regexp_extract(k, "^([^aA]*)", 1)))
    return F.coalesce(F.when(shape, (named["label"] != "") & (named["identity"] | named["strong"]) & paid["any"]), F.lit(False))


def continuation_shape(kinds: Column, total: Column, classes: Column) -> Column:
    named = F.get(classes, F.instr(kinds, "t") - 1)
    return F.coalesce(kinds.rlike(_ONE_AMOUNT) & ~total & (named["label"] != "") & (named["identity"] | named["strong"]), F.lit(False))


def _order_subtotal(z: Column) -> Column:
    """A subtotal of one direction that is the order itself: its row is data once it is filled down."""
    said = F.exists(z["own"], lambda c: is_total_text(c) & text.contains_any(F.lower(c), ORDER_SUBTOTALS))
    k = kind(z["row"])
    again = F.struct(k.alias("k"), is_total(z["row"]).alias("total"), F.lit(False).alias("preamble"))
    return F.when(z["facts"]["total"] & z["facts"]["k"].rlike("[aA]"), said & is_data(again)).otherwise(False)


def pruned(tabs: DataFrame) -> DataFrame:
    """Tables as a structured document shows them: (…, header, body: rows of cells).

    Rows that are no order go (all stay where none is kept), and so do columns that neither name a fund, nor give a
    row's direction, nor hold an amount of orders; a column that only its values show to give the direction is
    called 구분. Tables of a section marked `lossless` (a column, see `web`) keep all of both.
    """
    whole = F.col("lossless") if "lossless" in tabs.columns else F.lit(False)
    some = F.exists("body", lambda z: z["kept"]) & ~whole
    t = tabs.withColumn("rows", F.transform(F.filter("body", lambda z: z["kept"] | ~some), lambda z: z["row"]))
    t = t.withColumn("columns", F.transform("header", lambda h, j: F.filter(F.transform("rows", lambda r: F.get(r, j)), lambda v: v != "")))
    amount = lambda v: v.rlike(amounts.TOKEN)
    told = F.transform("columns", lambda c: F.filter(c, lambda v: ~amount(v)))
    t = t.withColumn("told", F.transform(told, lambda c: F.struct((F.size(c) >= 2).alias("two"), F.forall(c, lambda v: F.lower(text.bare(v)).isin(labels.CONTEXT_VALUES)).alias("all"), F.exists(c, lambda v: ~is_total_text(v)).alias("text"))))
    t = t.withColumn("paid", F.transform("columns", lambda c: F.exists(c, lambda v: amount(v) & v.rlike("[1-9]"))))
    context = F.exists("classes", lambda c: c["context"])
    relevant = lambda c: c["relevant"] | (context & c["plain"] & ~text.contains_any(c["low"], labels.UNIT_LABELS))
    clean = F.exists(F.arrays_zip("classes", "paid"), lambda z: ~z["classes"]["mixed"] & relevant(z["classes"]) & z["paid"])
    z = F.arrays_zip("classes", "told", "paid")
    t = t.withColumn("clean", clean)
    values = lambda q: q["told"]["two"] & q["told"]["all"]
    keep = F.transform(z, lambda q: q["classes"]["identity"] | (q["classes"]["context"] & q["told"]["text"]) | values(q) | (~(q["classes"]["mixed"] & F.col("clean")) & relevant(q["classes"]) & q["paid"]))
    t = t.withColumn("keep", keep)
    some_column = F.exists("keep", lambda k: k) & ~whole
    t = t.withColumn("at", F.filter(F.transform("keep", lambda k, j: F.when(k | ~some_column, j)), lambda j: j.isNotNull()))
    named = F.transform(F.arrays_zip("classes", "told"), lambda q: F.when(values(q) & ~q["classes"]["context"] & some_column, "구분").otherwise(q["classes"]["label"]))
    t = t.withColumn("named", named)
    pick = lambda r: F.transform("at", lambda j: F.get(r, j))
    return t.select(*[c for c in tabs.columns if c not in ("header", "body", "classes", "code_at", "name_at", "manager_at")], pick(F.col("named")).alias("header"), F.transform("rows", pick).alias("body"))


def web(section: Column) -> Column:
    """A section of a page or a web archive: its tables are shown whole."""
    return section.rlike(r"^\s*\[(?:HTML|MHT)\b")


# Names of amounts in the header line of a flattened schedule, the columns that it always has, and its date columns.
SCHEDULE_AMOUNTS = ["입금액", "출금액", "설정금액", "해지금액", "당일이체좌수", "당일이체금액", "이체예정금액", "결제금액", "순유입금액", "순투입금액", "증감금액", "증감액"]
SCHEDULE_COLUMNS = ["통합펀드코드", "서브펀드코드", "펀드명", "운용사"]
SCHEDULE_DATES = " 예정금액"


def schedule(lines: Column) -> Column:
    """The table (header, body) of a schedule that was flattened to text: a line of amount names, below it one of dates,
    below that rows whose numbers stand at the end; null if there is none.

    Where some of the amounts are net or scheduled, only those are shown, and then one column a date.
    """
    day = r"\d{4}-\d{2}-\d{2}"
    values = lambda x: x.contains("펀드명") & x.contains("운용사") & F.lower(x).rlike("당일이체금액|입금액|출금액|settlement|amount")
    dated = lambda x: x.contains("펀드코드") & x.rlike(day)
    at = F.array_position(F.transform(lines, lambda x, i: F.coalesce(values(x) & dated(F.get(lines, i + 1)), F.lit(False))), True).cast("int")

    def parts(v: Column) -> Column:
        net = lambda a: text.contains_any(a, [*labels.NET_LABELS]) | (a.rlike("예정|청구|예상") & ~a.contains("좌수"))
        some = F.exists(v["amounts"], net)
        shown = F.filter(F.transform(v["amounts"], lambda a, i: F.when(~some | net(a), i)), lambda i: i.isNotNull())
        return F.struct(v["amounts"].alias("amounts"), v["dates"].alias("dates"), v["rows"].alias("rows"), shown.alias("shown"))

    def row(v: Column):
        def one(line: Column) -> Column:
            tail = F.size(v["amounts"]) + F.size(v["dates"])
            code = lambda t: t.rlike(r"^[A-Z0-9]{3,}\z")

            def read(t: Column) -> Column:
                head = F.slice(t, F.lit(1), F.greatest(F.size(t) - tail, F.lit(0)))
                own = F.slice(t, F.size(head) + 1, tail)
                sub = (F.size(head) >= 4) & code(F.get(head, F.lit(1)))
                skip = F.when(sub, 3).otherwise(2)
                name = F.array_join(F.slice(head, skip, F.greatest(F.size(head) - skip, F.lit(0))), " ")
                ok = (F.size(head) >= 3) & code(F.get(head, F.lit(0))) & (name != "") & F.forall(own, lambda c: c.rlike(amounts.TOKEN)) & ~is_total_text(F.get(t, F.lit(0)))
                picked = F.concat(F.transform(v["shown"], lambda i: F.get(own, i)), F.slice(own, F.size(v["amounts"]) + 1, F.size(v["dates"])))
                return F.when(ok, F.concat(F.array(F.get(head, F.lit(0)), F.when(sub, F.get(head, F.lit(1))).otherwise(""), name, F.element_at(head, -1)), picked))

            return let(F.split(line, " "), read)

        return one

    def table(v: Column) -> Column:
        header = F.concat(F.array(*map(F.lit, SCHEDULE_COLUMNS)), F.transform(v["shown"], lambda i: F.get(v["amounts"], i)), F.transform(v["dates"], lambda d: F.concat(d, F.lit(SCHEDULE_DATES))))
        body = F.filter(F.transform(v["rows"], row(v)), lambda r: r.isNotNull())
        return let(body, lambda b: F.when((F.size(b) > 0) & (F.size(v["amounts"]) > 0), F.struct(header.alias("header"), b.alias("body"))))

    found = F.struct(
        F.regexp_extract_all(F.get(lines, at - 1), F.lit("(" + "|".join(SCHEDULE_AMOUNTS) + ")"), F.lit(1)).alias("amounts"),
        F.regexp_extract_all(F.get(lines, at), F.lit(f"({day})"), F.lit(1)).alias("dates"),
        F.slice(lines, at + 2, F.size(lines)).alias("rows"),
    )
    return F.when(at > 0, let(let(found, parts), table))


def schedules(sects: DataFrame) -> DataFrame:
    """(doc_id, section_no, block_no, header, body): the flattened schedules of sections without table rows."""
    keep = extra(sects, "doc_id", "section_no", "section")
    s = sects.where(F.col("section").contains("펀드명") & F.col("section").contains("운용사") & ~F.col("section").contains(CELL))
    lines = F.filter(F.transform(F.split("section", "\n"), text.squeeze), lambda x: x != "")
    t = s.select("doc_id", "section_no", *keep, posexplode(F.array(let(lines, schedule))).alias("p", "t")).where("t IS NOT NULL")
    return t.select("doc_id", "section_no", (F.col("p") + 1).alias("block_no"), *keep, "t.header", "t.body")


def cell_at(row: Column, at: Column) -> Column:
    """The cell of a place counted from 1; null if there is none."""
    return F.get(row, at - 1)


def body_rows(tabs: DataFrame) -> DataFrame:
    """One row per body row of a table: code, name, manager as printed, what the row is."""
    keep = extra(tabs, "doc_id", "section_no", "block_no", "header", "header_at", "data_at", "classes", "code_at", "name_at", "manager_at", "body")
    r = tabs.select("doc_id", "section_no", "block_no", *keep, "code_at", "name_at", "manager_at", posexplode("body").alias("p", "z")).where("p IS NOT NULL")
    part = lambda at: text.blank_to_null(text.squeeze(cell_at(F.col("z.own"), F.col(at))))
    return r.select(
        "doc_id", "section_no", "block_no", (F.col("p") + 1).alias("row_no"), *keep, F.col("z.row").alias("row"),
        part("code_at").alias("code"), part("name_at").alias("name"), part("manager_at").alias("manager"),
        F.col("z.total").alias("total"), F.col("z.data").alias("data"), F.col("z.kept").alias("kept"), "code_at", "name_at", "manager_at",
    )


def long_cells(rows: DataFrame) -> DataFrame:
    """(doc_id, section_no, block_no, row_no, col_no, cell): every cell of blocks as `raw_rows` gives them."""
    r = rows.select("doc_id", "section_no", "block_no", posexplode("rows").alias("r", "row")).where("r IS NOT NULL")
    c = r.select("doc_id", "section_no", "block_no", (F.col("r") + 1).alias("row_no"), posexplode("row").alias("c", "cell")).where("c IS NOT NULL")
    return c.select("doc_id", "section_no", "block_no", "row_no", (F.col("c") + 1).alias("col_no"), "cell")


def fill_down(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Blank cells take the nearest value above in their block; a total above passes nothing down."""
    w = W.partitionBy("doc_id", "section_no", "block_no").orderBy("row_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumns({c: F.last(F.when(~F.col("total"), F.col(c)), ignorenulls=True).over(w) for c in columns})


def fill_right(header: Column) -> Column:
    """Blank labels take the label to their left, if it is one of orders, dates or days ahead (group labels of merged cells)."""
    shown = fill_runs(header)
    return F.transform(F.arrays_zip(header.alias("h"), shown.alias("s")), lambda z: F.when((z["h"] == "") & labels.spreads(z["s"]), z["s"]).otherwise(z["h"]))


def collapse_header(rows: Column) -> Column:
    """Several header rows as one: group labels spread right over blanks, equal labels once, parts joined by ' / '."""
    spread = F.transform(rows, fill_right)
    top = F.element_at(rows, 1)
    return F.transform(top, lambda _, i: F.array_join(F.array_distinct(F.filter(F.transform(spread, lambda r: F.get(r, i)), lambda x: F.coalesce(x, F.lit("")) != "")), " / "))


def heading(first_line: Column, number: Column) -> Column:
    """A section's marker as a heading of structured text."""
    p = r"^\[(PAGE|SHEET|HTML|EML|MHT) (.*)\]\s*\z"
    kind = F.regexp_extract(first_line, p, 1)
    shown = F.when(kind.isin("PAGE", "SHEET"), F.initcap(kind)).otherwise(kind)
    return F.when(kind != "", F.concat(F.lit("## "), shown, F.lit(" "), F.regexp_extract(first_line, p, 2))).otherwise(F.concat(F.lit("## Section "), number.cast("string")))


def render_table(rows: Column) -> Column:
    """Rows of cells as a table of structured text: header, dashes, body; bars inside cells are escaped."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda x: F.replace(x, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    dashes = F.concat(F.lit("| "), F.array_join(F.transform(F.element_at(rows, 1), lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.concat_ws("\n", line(F.element_at(rows, 1)), dashes, F.array_join(F.transform(F.slice(rows, 2, F.size(rows)), line), "\n"))


def pack_sections(parts: Column, limit: int, delimiter: str) -> Column:
    """Sections packed greedily, in order, into chunks of at most `limit` characters; a section is never cut.

    A fold over the sections of one document: the state is the finished chunks and the open one.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, x: Column) -> Column:
        grown = F.concat(acc["open"], F.lit(delimiter), x)
        return (
            F.when(acc["open"].isNull(), F.struct(acc["done"].alias("done"), x.alias("open")))
            .when(F.length(grown) <= limit, F.struct(acc["done"].alias("done"), grown.alias("open")))
            .otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), x.alias("open")))
        )

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def missing_tokens(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, n_cells, n_missing): cells of the raw tables that the structured text (docs: doc_id, text) doesn't hold."""
    c = long_cells(rows).where("cell <> ''").groupBy("doc_id").agg(F.collect_set("cell").alias("cells"))
    j = c.join(docs, "doc_id")
    return j.select("doc_id", F.size("cells").alias("n_cells"), F.size(F.filter("cells", lambda x: ~F.contains(F.col("text"), x))).alias("n_missing"))
