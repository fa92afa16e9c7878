"""Problem 8: long spans that occur word for word in more than one document.

Method: Rabin-Karp hashes of every window of 200 characters, counted in Spark; repeated windows merge into maximal
intervals. Only windows that can repeat are counted: every window holds a 80-character gram that its content alone
selects (the one of smallest Rabin-Karp hash), so a window that occurs in two documents has a selected gram that
does. First the selected grams are counted (about one in sixty positions), then, in the documents that hold a gram
seen in several texts, every window around such a gram is hashed and counted. Nothing is lost by the first step.

Whole copies are grouped first by the SHA-256 of their text: a document of a group of copies is shared from end to
end, and only one text of a group takes part in the counting, so a group that holds a third of all rows costs no
more than one document. Counting uses partial aggregation; the rows that join back to a repeated hash are spread by
AQE. Before a shuffle, rows that a join would drop anyway are dropped by a bitmap of fixed size (8 MB) where that
tells. Two windows are taken as equal if 96 bits of two independent hashes agree; only the few texts that hold a
repeated gram are hashed at every place. All their windows are counted; only those that don't lie whole under a
shared window found before (at the position of a gram) are then joined to the counts, for they alone can add to a run.

Defined cases: null and empty texts, texts under 200 characters and rows without an id share nothing; a repeated row
(same id and text) is one document; a window that repeats only
within one document isn't shared; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import U64, bitmap, checkpointed, codepoints, may_hold, mix, mix_one, powers, signed, slices, table

WINDOW = 200
GRAM = 80
BASES = (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)
TOP = U64(0xFFFFFFFFFFFFFFFF)


@functools.cache
def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def prefix(points: np.ndarray, base: int) -> np.ndarray:
    """Running polynomial sums, modulo 2 ** 64, over mixed code points."""
    terms = mix(points.astype(U64) + U64(base & 0xFFFF)) * powers(base, len(points))
    return np.concatenate([np.zeros(1, U64), np.cumsum(terms, dtype=U64)])


def windows(sums: np.ndarray, length: int, base: int, at: np.ndarray | None = None) -> np.ndarray:
    """Rabin-Karp hashes of the windows of `length` that start at `at` (everywhere if None)."""
    if at is None:
        diff = sums[length:] - sums[:-length]
        return mix(diff * powers(_inverse(base), len(diff)))
    return mix((sums[at + length] - sums[at]) * powers(_inverse(base), len(sums))[at])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbours."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def selected(points: np.ndarray, starts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places where a whole window starts within one text, its row, the hash of its selected gram, hash sums)."""
    sums = prefix(points, BASES[0])
    n = len(points) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none.view(U64), sums
    grams = windows(sums, gram, BASES[0])
    least = sliding_min(grams, window - gram + 1)
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at = np.flatnonzero(row[:n] == row[window - 1 :])
    return at, row[at], least[at], sums


def grams(docs: DataFrame, bits: np.ndarray | None = None, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(gram, text_key): the selected grams of every text, of those the filter lets through; docs: text_key, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ["text"]):
            points, starts = codepoints(batch.column(1))
            _, row, least, _ = selected(points, starts, window, gram)
            if len(row):
                new = np.concatenate([[True], (least[1:] != least[:-1]) | (row[1:] != row[:-1])])
                least, row = least[new], row[new]
                if bits is not None:
                    may = may_hold(bits, least)
                    least, row = least[may], row[may]
                yield pa.RecordBatch.from_arrays([signed(least), batch.column(0).take(pa.array(row))], ["gram", "text_key"])

    return docs.select("text_key", "text").mapInArrow(run, "gram long, text_key long")


def only(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """The documents that the filter of hashed ids lets through; docs: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            may = may_hold(bits, mix(batch.column(0).to_numpy().view(U64)))
            yield batch.filter(pa.array(may))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string")


def hashed_ids(df: DataFrame) -> DataFrame:
    """`mix` of the column doc_id, as the filter of `only` expects it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([signed(mix(batch.column(0).to_numpy().view(U64)))], ["h"])

    return df.select("doc_id").mapInArrow(run, "h long")


def _lists(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of every element of a list column; null counts as empty."""
    lists = lists.fill_null([]) if lists.null_count else lists
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()


def _among(lists: pa.ListArray, hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each (hash, row): is the hash in the row's list?"""
    own, values = _lists(lists)
    salt = mix(np.arange(len(lists), dtype=U64) + U64(mix_one(7)))
    wanted = np.unique(values.view(U64) ^ salt[own])
    have = hashes ^ salt[row]
    if not len(wanted):
        return np.zeros(len(have), bool)
    return wanted[np.minimum(np.searchsorted(wanted, have), len(wanted) - 1)] == have


def candidate_windows(docs: DataFrame, which: str = "all", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(h, x, doc_id, pos): windows whose selected gram is in their document's list; docs: doc_id, text, grams.

    which: "all"; "anchors": only those that begin with a gram of the list; "open": only those that don't lie whole
    under the windows at the positions of the column `covered`. h and x are 64 and 32 bits of two independent
    hashes of the window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ["text"], 1 << 18):
            points, starts = codepoints(batch.column(1))
            at, row, least, sums = selected(points, starts, window, gram)
            if not len(at):
                continue
            first = windows(sums, gram, BASES[0], at) if which == "anchors" else least
            hit = _among(batch.column(2), first, row)
            if which == "open":
                own, covered = _lists(batch.column(3))
                begin = starts[own] + covered.astype(np.int64) - 1
                edge = np.bincount(begin, minlength=len(points) + 1) - np.bincount(begin + window, minlength=len(points) + 1)
                under = np.concatenate([[0], np.cumsum(np.cumsum(edge)[: len(points)] > 0)])
                hit &= under[at + window] - under[at] < window
            at, row = at[hit], row[hit]
            if len(at):
                other = windows(prefix(points, BASES[1]), window, BASES[1], at)
                yield pa.RecordBatch.from_arrays(
                    [
                        signed(windows(sums, window, BASES[0], at)),
                        pa.array((other >> U64(32)).astype(np.uint32).view(np.int32)),
                        batch.column(0).take(pa.array(row)),
                        pa.array((at - starts[row] + 1).astype(np.int32)),
                    ],
                    ["h", "x", "doc_id", "pos"],
                )

    return docs.mapInArrow(run, "h long, x int, doc_id long, pos int")


def repeated(found: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(doc_id, pos) of the rows of `found` whose window occurs in two documents of `of` (of `found` if None)."""
    of = found if of is None else of
    twice = of.groupBy("h", "x").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h", "x")
    return found.join(twice, ["h", "x"], "left_semi").select("doc_id", "pos")


def merge(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, start_pos, end_pos): the maximal runs of characters under the windows; df: doc_id, places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            if not len(ids):
                continue
            offsets = lists.offsets.to_numpy()
            place = lists.flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(ids)), np.diff(offsets))
            order = np.lexsort((place, row))
            place, row = place[order], row[order]
            first = np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] > place[:-1] + window)])
            last = np.concatenate([first[1:], [True]])
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(row[first])), pa.array(place[first]), pa.array(place[last] + window - 1)], ["doc_id", "start_pos", "end_pos"]
            )

    return df.mapInArrow(run, "doc_id long, start_pos long, end_pos long")


def shared_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, start_pos, end_pos) of every maximal shared run; docs: doc_id, text."""
    long = docs.where((F.char_length("text") >= window) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key"))
    copies = checkpointed(
        long.groupBy(F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), "text_key", F.char_length("text").alias("n"))
        .agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("other"))
        .select("sha", "text_key", "rep", F.col("n").cast("long").alias("n"), (F.col("rep") < F.col("other")).alias("copied"))
    )
    rows = grams(long, None, window, gram)
    several = checkpointed(rows.groupBy("gram").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b")).where("a < b").select("gram"))
    again = grams(long, bitmap(several, "gram"), window, gram)
    lists = again.join(several, "gram", "left_semi").groupBy("text_key").agg(F.collect_set("gram").alias("grams"))
    chosen = checkpointed(lists.join(copies, "text_key").select(F.col("rep").alias("doc_id"), "grams"))
    texts = checkpointed(only(long, bitmap(hashed_ids(chosen), "h")).join(chosen, "doc_id"))
    # most of a long stretch is covered by the windows at its grams; only the rest is looked up place by place
    anchors = repeated(candidate_windows(texts.select("doc_id", "text", "grams"), "anchors", window, gram))
    covered = checkpointed(anchors.groupBy("doc_id").agg(F.collect_list("pos").alias("covered")))
    every = candidate_windows(texts.select("doc_id", "text", "grams"), "all", window, gram)
    still = candidate_windows(texts.join(covered, "doc_id", "left").select("doc_id", "text", "grams", "covered"), "open", window, gram)
    rest = repeated(still, every)
    kept = rest.unionByName(covered.select("doc_id", F.explode("covered").alias("pos"))).groupBy("doc_id").agg(F.collect_list("pos").alias("places"))
    single = copies.where("not copied").select(F.col("rep").alias("doc_id"))
    kept = kept.join(single, "doc_id", "left_semi")
    whole = (
        long.select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"))
        .join(copies.where("copied").select("sha", "n"), "sha")
        .select("doc_id", F.lit(1).cast("long").alias("start_pos"), F.col("n").alias("end_pos"))
    )
    return merge(kept, window).unionByName(whole)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the number of its characters and how many of them lie in shared stretches."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"))
    spans = p8_found(spark, sf_dir).groupBy("doc_id").agg(F.sum(F.col("end_pos") - F.col("start_pos") + 1).alias("shared"))
    return docs.join(spans, "doc_id", "left").select("doc_id", "n_chars", F.coalesce("shared", F.lit(0)).cast("long").alias("shared_chars"))


SQL = {
    "p8_found": """
WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) >= 200),
w AS (SELECT doc_id, i, md5(substring(text, CAST(i AS INTEGER), 200)) AS h FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 199)) AS i FROM d)),
r AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)),
p AS (SELECT doc_id, i FROM w SEMI JOIN r ON w.h = r.h),
m AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM p),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT doc_id, CAST(min(i) AS BIGINT) AS start_pos, CAST(max(i) + 199 AS BIGINT) AS end_pos FROM g GROUP BY doc_id, run"""
}
SQL["p8_shares"] = f"""
WITH s AS ({SQL["p8_found"]})
SELECT d.doc_id, CAST(coalesce(length(d.text), 0) AS BIGINT) AS n_chars, CAST(coalesce(sum(s.end_pos - s.start_pos + 1), 0) AS BIGINT) AS shared_chars
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id, d.text"""
