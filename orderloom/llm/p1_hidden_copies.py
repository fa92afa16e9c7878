"""Problem 1: order records that are copies though they are written differently.

Method: the three fields of a record are streamed through a skip-and-fold table (letters and digits are folded,
all else is skipped) into two rolling polynomial hashes each; canonical strings are never built. Rows are grouped
by the hashes and the four columns that must be equal: first the hashes alone are counted (partial aggregation, eight
bytes a row), then only rows whose hash occurs twice are shuffled with their text. Rows whose
hashes collide are compared with the smallest row of their group by a two-pointer comparison that skips and folds
while it runs. Rows that it tells apart (a true collision of 128 bits) are compared again among themselves, with the
smallest of them, until none is left.

Defined cases: null and empty fields are equal; null equals null in settle_class, order_type, base_date and t_day;
an amount without a digit is compared by its letters and digits; zero has no sign; rows of problem 5 and rows
without an id are in no set.
An empty table gives no rows. One hot group is split by AQE on the side of its rows: the other side has one row a group.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .p5_lookalikes import finder, vocabulary
from .shared import LIMIT, U64, bitmap, checkpointed, codepoints, folded, may_hold, mix, row_hashes, signed, slices, table, word_table

EQUAL = ["settle_class", "order_type", "base_date", "t_day"]
FIELDS = ["fund_code", "fund_name", "transfer_amount"]
RAW = ["raw_code", "raw_name", "raw_amount"]
BASES = (0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1)

# The labels under which record_text holds the three fields.
_LABELS = re.compile(r"(?P<fund_code>fund[ _]?code|펀드코드)|(?P<fund_name>fund[ _]?name|펀드명)|(?P<transfer_amount>transfer[ _]?amount|이체금액)", re.IGNORECASE)
_LABELLED = re.compile(rf"(?:{_LABELS.pattern})[\"']?\s*[:=]", re.IGNORECASE)


def parse_record(text: str) -> list[str]:
    """The raw fund_code, fund_name and transfer_amount of a record text, in any of its layouts."""
    out = dict.fromkeys(FIELDS, "")
    if text.lstrip().startswith("{"):
        try:
            for key, value in json.loads(text).items():
                if (m := _LABELS.fullmatch(key.strip())) and value is not None:
                    out[m.lastgroup] = str(value)
            return [out[f] for f in FIELDS]
        except (ValueError, AttributeError):
            pass
    found = list(_LABELLED.finditer(text))
    for m, nxt in zip(found, [*found[1:], None]):
        out[m.lastgroup] = text[m.end() : nxt.start() if nxt else len(text)].strip(" \t\r\n|;{}\"")
    return [out[f] for f in FIELDS]


def raw_fields(batch: pa.RecordBatch) -> list[pa.Array]:
    """The three fields as written, from their columns or from record_text."""
    text = batch.column(batch.schema.get_field_index("record_text"))
    out = [pc.fill_null(batch.column(batch.schema.get_field_index(f)), "") for f in FIELDS]
    has = pc.is_valid(text).to_numpy(zero_copy_only=False)
    if has.any():
        parsed = [parse_record(x) for x in text.filter(pa.array(has)).to_pylist()]
        mask = pa.array(has)
        out = [pc.replace_with_mask(c, mask, pa.array([p[k] for p in parsed], pa.string())) for k, c in enumerate(out)]
    return out


def text_hashes(column: pa.Array) -> list[np.ndarray]:
    points, starts = codepoints(folded(column))
    values = word_table()[np.minimum(points, LIMIT)]
    return [row_hashes(values, values > 0, starts, b) for b in BASES]


def amount_hashes(column: pa.Array) -> list[np.ndarray]:
    """Hashes of the signed number: zeros that lead or trail don't count, nor does the sign of zero."""
    column = folded(column)
    points, starts = codepoints(column)
    n = len(points)
    row = np.repeat(np.arange(len(column)), np.diff(starts))
    digit = (points >= 48) & (points <= 57)
    value = np.where(digit, points - 47, 0)
    nonzero = value > 1
    run = lambda flag: np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    point = points == 46
    dots, sig = run(point), run(nonzero)
    before = dots[np.arange(n)] - dots[starts[row]]  # points seen earlier in the row
    fraction = before > 0
    leading = digit & ~fraction & (sig[np.arange(n) + 1] - sig[starts[row]] == 0)
    left = sig[starts[row + 1]] - sig[np.arange(n)]  # nonzero digits from here on
    trailing = digit & fraction & (left == 0)
    mark = point & ~fraction & (left > 0)
    keep = digit & ~leading & ~trailing | mark
    values = np.where(mark, 20, value)
    alike = word_table()[np.minimum(points, LIMIT)]
    has_digit = run(digit)
    numeric = (has_digit[starts[1:]] - has_digit[starts[:-1]]) > 0
    keep = np.where(numeric[row], keep, alike > 0) if n else keep
    values = np.where(numeric[row], values, alike) if n else values
    first_digit = has_digit[np.arange(n)] - has_digit[starts[row]] == 0
    minus = run((points == 45) & first_digit)
    negative = numeric & (minus[starts[1:]] > minus[starts[:-1]]) & (sig[starts[1:]] > sig[starts[:-1]])
    salt = U64(0xA0761D6478BD642F) * negative.astype(U64) + U64(0xE7037ED1A0B428DB) * (~numeric).astype(U64)
    return [mix(row_hashes(values.astype(np.uint32), keep, starts, b) + salt) for b in BASES]


def _next(text: str, i: int, tab: np.ndarray) -> tuple[int, int]:
    """(folded letter or digit at or after i, the place behind it); (0, end) if there is none."""
    while i < len(text):
        v = int(tab[min(ord(text[i]), LIMIT)])
        i += 1
        if v:
            return v, i
    return 0, i


def same_text(a: str, b: str) -> bool:
    """Two pointers run over both texts, skip what isn't a letter or digit, and compare the folded rest."""
    if a == b:
        return True
    a, b = (x if x.isascii() else x.casefold() for x in (a, b))
    tab, i, j = word_table(), 0, 0
    while True:
        x, i = _next(a, i, tab)
        y, j = _next(b, j, tab)
        if x != y:
            return False
        if not x:
            return True


def _digits(text: str) -> tuple[bool, int, int]:
    """(is negative, place of the first digit of the number, place behind its last); places of zeros left out."""
    point, first, last, sign, seen = -1, -1, 0, False, False
    for i, c in enumerate(text):
        if c == "-" and not seen:
            sign = True
        elif c == "." and point < 0:
            point = i
        elif "0" <= c <= "9":
            seen = True
            if c != "0":
                first = i if first < 0 else first
                last = i + 1
    if first < 0:
        return False, -1, -1
    if point < 0:
        return sign, first, len(text)
    return sign, min(first, point), max(last, point)


def same_amount(a: str, b: str) -> bool:
    """Two pointers over the digits of both numbers; grouping, spaces, a plus and needless zeros are skipped."""
    if a == b:
        return True
    if not any("0" <= c <= "9" for c in a) or not any("0" <= c <= "9" for c in b):
        return not any("0" <= c <= "9" for c in a + b) and same_text(a, b)
    (s, i, m), (t, j, n) = _digits(a), _digits(b)
    if (i < 0) != (j < 0) or s != t:
        return False
    if i < 0:
        return True

    def step(x: str, k: int, end: int, point: bool) -> tuple[str, int, bool]:
        while k < end:
            c = x[k]
            k += 1
            if "0" <= c <= "9":
                return c, k, point
            if c == "." and not point and any("0" <= d <= "9" for d in x[k:end]):
                return c, k, True
        return "", k, point

    p = q = False
    while True:
        x, i, p = step(a, i, m, p)
        y, j, q = step(b, j, n, q)
        if x != y:
            return False
        if not x:
            return True


def hashed(orders: DataFrame, names: list[str], others: list[str]) -> DataFrame:
    """order_id, the equal columns, raw fields, two hashes; without the rows that problem 5 finds."""
    key = (tuple(names), tuple(others))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = finder(*key)
        for batch in slices(batches, ["fund_name", "record_text", "transfer_amount"]):
            odd = own.flagged(batch.column(batch.schema.get_field_index("fund_name")), names=True)
            odd |= own.flagged(batch.column(batch.schema.get_field_index("transfer_amount")), True)
            batch = batch.filter(pa.array(~odd))
            raw = raw_fields(batch)
            parts = [text_hashes(raw[0]), text_hashes(raw[1]), amount_hashes(raw[2])]
            h = []
            for code, name, amount in zip(*parts):
                h.append(mix(mix(mix(code + U64(1)) + name) + amount))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(batch.column(batch.schema.get_field_index(c)) for c in EQUAL), *raw, *map(signed, h)],
                ["order_id", *EQUAL, *RAW, "h1", "h2"],
            )

    return orders.where("order_id IS NOT NULL").select(F.col("order_id").cast("long"), *EQUAL, *FIELDS, "record_text").mapInArrow(
        run, "order_id long, settle_class string, order_type string, base_date string, t_day int, raw_code string, raw_name string, raw_amount string, h1 long, h2 long"
    )


def members(rows: DataFrame) -> DataFrame:
    """The rows whose first hash occurs twice or more, and few others: a bitmap of fixed size tells before any shuffle."""
    twice = rows.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bits = bitmap(twice, "h1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(bits, batch.column(batch.schema.get_field_index("h1")).to_numpy().view(U64))))

    return rows.mapInArrow(run, rows.schema)


def _verified(pairs: DataFrame) -> DataFrame:
    """Adds `same`: is the row the same record as the representative of its group?"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(k).to_pylist() for k, n in enumerate(batch.schema.names)}
            same = [
                i == k or same_text(a, x) and same_text(b, y) and same_amount(c, z)
                for i, k, a, b, c, x, y, z in zip(*(cols[n] for n in ("order_id", "keep_id", *RAW, "rep_code", "rep_name", "rep_amount")))
            ]
            keep = ["order_id", "keep_id", *RAW, *EQUAL, "h1", "h2"]
            blank = pa.array([not s for s in same])
            arrays = [batch.column(batch.schema.get_field_index(n)) for n in keep]
            arrays[2:5] = [pc.if_else(blank, a, None) for a in arrays[2:5]]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(same)], [*keep, "same"])

    return pairs.mapInArrow(run, "order_id long, keep_id long, raw_code string, raw_name string, raw_amount string, settle_class string, order_type string, base_date string, t_day int, h1 long, h2 long, same boolean")


def groups(orders: DataFrame, names: list[str], others: list[str]) -> DataFrame:
    """(keep_id, order_id) of every row that is in a set of two or more, the smallest row included."""
    keys = [*EQUAL, "h1", "h2"]
    rest = members(checkpointed(hashed(orders, names, others)))
    out = None
    # one round, but for true collisions: each further one takes a set of copies off every group that holds several
    while True:
        reps = (
            rest.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n"), F.min("order_id").alias("keep_id"), F.min_by(F.struct(*RAW), "order_id").alias("rep"))
            .where("n > 1")
            .select(*(F.col(k).alias(f"k_{k}") for k in keys), "keep_id", *(F.col(f"rep.{r}").alias(r.replace("raw", "rep")) for r in RAW))
        )
        joined = rest.join(reps, [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys])
        checked = checkpointed(_verified(joined.select("order_id", "keep_id", *RAW, "rep_code", "rep_name", "rep_amount", *keys)))
        found = checked.where("same").select("keep_id", "order_id")
        out = found if out is None else out.unionByName(found)
        rest = checked.where("not same").select("order_id", *keys, *RAW)
        if rest.isEmpty():
            return out


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "order_extractions"), *vocabulary(spark, sf_dir))
    return found.where("order_id <> keep_id").select("keep_id", F.col("order_id").alias("copy_id"))


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record: its smallest order_id and the number of its copies (1 for a record that stands alone)."""
    orders = table(spark, sf_dir, "order_extractions")
    copies = groups(orders, *vocabulary(spark, sf_dir)).where("order_id <> keep_id")
    extra = copies.groupBy("keep_id").agg((F.count(F.lit(1)) + 1).alias("n_copies"))
    single = orders.select("order_id").join(copies.select("order_id"), "order_id", "left_anti")
    return single.join(extra, single.order_id == extra.keep_id, "left").select(
        F.col("order_id").alias("keep_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies")
    )
