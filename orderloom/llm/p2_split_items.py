"""Problem 2: items longer than a limit, cut into overlapping pieces at natural boundaries.

Method: dynamic programming over boundary positions. The positions are section ends, table rows, lines and sentence
ends, all of them (and, only where none of these lies within reach, all spaces, and every 50th place); the cost of a plan is the sum
of its cuts' penalties, a small price a piece and the squared distance of each piece's size from the even share; a
piece holds at most `limit` characters and shares exactly `overlap` with the next. Each item is planned on its own
in an Arrow batch: no shuffle, and the table of plans is linear in the item's length.

Defined cases: null and empty items, null or empty arrays and items within the limit give no piece (they stay as
they are); a repeated row gives its pieces again; rows without an id are left out; characters are code points; a cut never precedes a combining mark
where another place is within reach.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import slices, table

LIMIT, OVERLAP = 2000, 200
#: Penalties of a cut by kind, and the names of the kinds.
SECTION, ROW, LINE, SENTENCE, SPACE, HARD, END = range(7)
PENALTY = np.array([0.0, 0.5, 1.0, 2.0, 1e3, 1e4, 0.0])
KINDS = ["section", "table row", "line", "sentence", "space", "hard", "end"]
PIECE, BALANCE = 1.0, 4.0
#: Hard places, offered only where no natural boundary is within reach, are so far apart.
HARD_STEP = 50

_BOUNDARY = re.compile(
    r"(?P<section>\n+(?=(?:==== SECTION ====|<!-- SECTION -->|#{1,6} )))"
    r"|(?P<line>\n)"
    r"|(?P<sentence>[.!?。！？…]+[\"'”’)\]]*(?=\s))"
)


def boundaries(text: str, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions behind which a cut may lie, kinds), ascending; natural ones, and others where these are too far apart."""
    n = len(text)
    places: list[int] = []
    kinds: list[int] = []
    line = 0
    for m in _BOUNDARY.finditer(text):
        kind = m.lastgroup
        end = m.end()
        if kind == "sentence":
            places.append(end)
            kinds.append(SENTENCE)
            continue
        places.append(end)
        kinds.append(SECTION if kind == "section" else ROW if " | " in text[line:end] or text.startswith("|", line) else LINE)
        line = end
    at, kind = np.array([*places, n], np.int64), np.array([*kinds, END], np.int64)
    inside = (at > overlap) & ((at < n) | (kind == END))
    at, kind = at[inside], kind[inside]
    # two boundaries at one place (a section's end is a line's too): the better kind
    order = np.lexsort((PENALTY[kind], at))
    at, kind = at[order], kind[order]
    keep = np.concatenate([[True], at[1:] != at[:-1]])
    at, kind = at[keep], kind[keep]
    reach = limit - overlap
    gaps = np.flatnonzero(np.diff(np.concatenate([[overlap], at])) > reach)
    if len(gaps):
        more: list[int] = []
        sort: list[int] = []
        for g in gaps:
            low, high = int(at[g - 1]) if g else overlap, int(at[g])
            for m in re.finditer(r"\s+", text[low:high]):
                if m.end() < high - low:
                    more.append(low + m.end())
                    sort.append(SPACE)
            step = max(1, min(HARD_STEP, reach // 4))
            for p in range(low + step, high, step):
                q = p
                while q > p - step + 1 and (unicodedata.combining(text[q]) or text[q] in "‍️"):
                    q -= 1
                more.append(q)
                sort.append(HARD)
        at, kind = np.concatenate([at, more]), np.concatenate([kind, sort])
        order = np.lexsort((PENALTY[kind], at))
        at, kind = at[order], kind[order]
        first = np.concatenate([[True], at[1:] != at[:-1]])
        at, kind = at[first], kind[first]
    return at, kind


def plan(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, kind of the cut behind it) of each piece of the cheapest plan; start counts from 0, end is exclusive."""
    n = len(text)
    if n <= limit:
        return [(0, n, END)]
    at, kind = boundaries(text, limit, overlap)
    reach = limit - overlap
    share = (n - overlap) / -(-(n - overlap) // reach) + overlap
    begin = np.concatenate([[0], at - overlap])  # where the piece behind cut i - 1 begins
    cost = np.full(len(at) + 1, np.inf)
    cost[0] = 0.0
    back = np.zeros(len(at) + 1, np.int64)
    low = np.searchsorted(begin, at - limit)
    own = PENALTY[kind] + PIECE
    for j in range(len(at)):
        k = low[j]
        size = at[j] - begin[k : j + 1]
        total = cost[k : j + 1] + BALANCE * ((size - share) / limit) ** 2
        i = int(total.argmin())
        cost[j + 1] = total[i] + own[j]
        back[j + 1] = k + i
    out, j = [], len(at)
    while j:
        i = int(back[j])
        out.append((int(begin[i]), int(at[j - 1]), int(kind[j - 1])))
        j = i
    return out[::-1]


def split(items: DataFrame, keys: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every item (column `item`) over the limit: keys, piece_no, start_pos, end_pos, cut, piece."""
    types = dict(items.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ["item"]):
            rows: list[int] = []
            out: list[tuple] = []
            for i, text in enumerate(batch.column(len(keys)).to_pylist()):
                for no, (start, end, kind) in enumerate(plan(text, limit, overlap), 1):
                    rows.append(i)
                    out.append((no, start + 1, end, KINDS[kind], text[start:end]))
            if rows:
                at = pa.array(rows)
                no, start, end, cut, piece = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(at) for k in range(len(keys))), pa.array(no, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(cut), pa.array(piece)],
                    [*keys, "piece_no", "start_pos", "end_pos", "cut", "piece"],
                )

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", piece_no int, start_pos long, end_pos long, cut string, piece string"
    return items.where(F.char_length("item") > limit).select(*keys, "item").mapInArrow(run, schema)


def items_of(payloads: DataFrame) -> DataFrame:
    """(payload_id, item_no, item): markdown_text as number 0 and the stored chunks from 1."""
    key = F.col("payload_id").cast("long").alias("payload_id")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("item_no"), F.col("markdown_text").alias("item")))
    parts = F.transform(F.coalesce("chunks", F.array().cast("array<string>")), lambda x, i: F.struct((i + 1).cast("long").alias("item_no"), x.alias("item")))
    return payloads.where("payload_id IS NOT NULL").select(key, F.explode(F.concat(whole, parts)).alias("x")).select("payload_id", "x.item_no", "x.item")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(items_of(table(spark, sf_dir, "task_payloads")), ["payload_id", "item_no"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that the operator cut."""
    return p2_pieces(spark, sf_dir).where("piece_no = 1").select("payload_id", "item_no")


SQL = {
    "p2_found": """
SELECT payload_id, CAST(0 AS BIGINT) AS item_no FROM task_payloads WHERE length(markdown_text) > 2000
UNION ALL
SELECT payload_id, CAST(i AS BIGINT) AS item_no FROM (SELECT payload_id, unnest(chunks) AS c, generate_subscripts(chunks, 1) AS i FROM task_payloads) WHERE length(c) > 2000"""
}
