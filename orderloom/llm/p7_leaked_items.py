"""Problem 7: passages of evaluation items in a training corpus.

Method: a distributed positional inverted index, stored. Each worker builds, for its share of the documents (a shard
of about 2 MB), the postings of all words: for each term the sorted positions where it stands. The index is written
once to the shared folder and read for every block of test items and every slop. A query window of 12 words is
answered in every shard by taking the postings of its rarest term there, shifting them by the term's offset, and
intersecting them with the shifted lists of the other terms from rare to common. A slop of 0 gives exact phrases. With
a larger one (proximity) a window matches at a place if every word lies at most that many places from where the
phrase would have it there; all places that the rarest term allows are tried, so the result doesn't depend on shards.

The index is partitioned by document, so neither building nor searching shuffles anything, and a hot term is split
over all shards. Test items are read in blocks of at most BLOCK_BYTES of text; longer items are cut, windows kept
whole. More blocks than one are searched one after another, each with its result written, so the driver and the
workers hold one block only.

Defined cases: null and empty texts, items under 12 words and rows without an id match nothing; repeated documents each match;
words are maximal runs of letters and digits, compared case-folded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LIMIT, U64, checkpointed, codepoints, folded, mix, powers, slices, table, word_table

WORDS = 12
#: Text of test items that a block holds; its windows take about 50 bytes a byte of it.
BLOCK_BYTES = 2 << 20
SHARD_BYTES = 2 << 20
BASES = (0x5851F42D4C957F2D, 0x14057B7EF767814F)
INDEX = "docs array<long>, first array<int>, terms array<long>, checks array<long>, ends array<int>, positions array<int>"


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first hash, second hash, row) of every word of a string column, in order."""
    points, starts = codepoints(folded(column))
    values = word_table()[np.minimum(points, LIMIT)]
    inside = np.concatenate([[False], values > 0, [False]])
    row = np.repeat(np.arange(len(column)), np.diff(starts))
    cut = np.zeros(len(points) + 2, bool)
    cut[starts[:-1][np.diff(starts) > 0] + 1] = True  # a text's first character begins a word even behind a letter
    begin = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[1:-1]))
    stop = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[2:])) + 1
    out = []
    for base in BASES:
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(values.astype(U64) + U64(base)) * powers(base, len(values)), dtype=U64)])
        back = powers(pow(base, -1, 1 << 64), len(values) + 1)
        out.append(mix((sums[stop] - sums[begin]) * back[begin]))
    return out[0], out[1], row[begin]


class Queries:
    """The windows of the test items, as numbers of the terms of a sorted vocabulary."""

    def __init__(self, ids: list[int], texts: list[str], width: int = WORDS):
        h, g, row = words(pa.array(texts, pa.string()))
        self.hash, first = np.unique(h, return_index=True)
        self.check = g[first]
        term = np.searchsorted(self.hash, h).astype(np.int32)
        n = len(term) - width + 1
        at = np.flatnonzero(row[:n] == row[width - 1 :]) if n > 0 else np.zeros(0, np.int64)
        self.terms = term[at[:, None] + np.arange(width)] if len(at) else np.zeros((0, width), np.int32)
        self.items = np.asarray(ids, np.int64)[row[at]]


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per shard: its documents, the position of the first word of each, its terms, and where each stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ["text"], shard_bytes):
            h, g, row = words(batch.column(1))
            if not len(h):
                continue
            # documents' positions don't touch: one place lies between, and a search stays within a document
            position = (np.arange(len(row), dtype=np.int64) + row).astype(np.int32)
            first = (np.searchsorted(row, np.arange(batch.num_rows)) + np.arange(batch.num_rows)).astype(np.int32)
            order = np.argsort(h, kind="stable")
            sorted_h = h[order]
            head = np.flatnonzero(np.concatenate([[True], sorted_h[1:] != sorted_h[:-1]]))
            ends = np.append(head[1:], len(h)).astype(np.int32)
            long = lambda x: pa.array([x.view(np.int64)], pa.list_(pa.int64()))
            short = lambda x: pa.array([x], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())), short(first), long(sorted_h[head]), long(g[order][head]), short(ends), short(position[order])],
                ["docs", "first", "terms", "checks", "ends", "positions"],
            )

    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, INDEX)


class Shard:
    """A shard's postings: sorted numbers of term (of the block's vocabulary) and position."""

    SHIFT = 32

    def __init__(self, queries: Queries, first: np.ndarray, terms: np.ndarray, checks: np.ndarray, ends: np.ndarray, positions: np.ndarray):
        self.first = first.astype(np.int64)
        terms, checks = terms.view(U64), checks.view(U64)
        at = np.minimum(np.searchsorted(terms, queries.hash), len(terms) - 1)
        here = np.flatnonzero((terms[at] == queries.hash) & (checks[at] == queries.check))
        stop = ends[at[here]].astype(np.int64)
        start = np.where(at[here] > 0, ends[np.maximum(at[here] - 1, 0)], 0).astype(np.int64)
        n = stop - start
        self.count = np.zeros(len(queries.hash), np.int64)
        self.count[here] = n
        self.edge = np.concatenate([[0], np.cumsum(self.count)])
        place = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        self.keys = np.repeat(here.astype(np.int64), n) << self.SHIFT | positions[place].astype(np.int64)


def search_shard(shard: Shard, queries: Queries, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(window, document) of every match in a shard.

    The document is the rarest term's own, and every other term is looked for within it: with a slop, a window's
    place may lie before the document.
    """
    count, keys, first = shard.count, shard.keys, shard.first
    live = np.flatnonzero((count[queries.terms] > 0).all(axis=1)) if len(queries.terms) else np.zeros(0, np.int64)
    if not len(live):
        return live, live
    order = np.argsort(count[queries.terms[live]], axis=1, kind="stable")
    rarest = queries.terms[live, order[:, 0]]
    n = count[rarest]
    window = np.repeat(np.arange(len(live)), n)
    nth = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
    at = keys[shard.edge[rarest][window] + nth] & ((1 << Shard.SHIFT) - 1)
    doc = np.searchsorted(first, at, "right") - 1
    low, high = first[doc], np.append(first[1:], 1 << Shard.SHIFT)[doc] - 1
    shifts = np.arange(-slop, slop + 1)
    start = ((at - order[window, 0])[:, None] + shifts).ravel()
    window, doc, low, high = (np.repeat(x, len(shifts)) for x in (window, doc, low, high))
    for k in range(1, order.shape[1]):
        offset = order[window, k]
        least, most = np.maximum(start + offset - slop, low), np.minimum(start + offset + slop, high)
        term = queries.terms[live[window], offset].astype(np.int64) << Shard.SHIFT
        at = np.searchsorted(keys, term + least)
        ok = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] <= term + most) & (least <= most)
        window, start, doc, low, high = window[ok], start[ok], doc[ok], low[ok], high[ok]
    return live[window], doc


def search_index(index: DataFrame, queries: Queries, slop: int = 0) -> DataFrame:
    """(doc_id, item_id) of every document in which a window of the item matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                docs, *parts = (np.asarray(batch.column(k)[i].values) for k in range(6))
                window, doc = search_shard(Shard(queries, *parts), queries, slop)
                if not len(window):
                    continue
                pairs = np.unique(np.stack([docs[doc], queries.items[window]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["doc_id", "item_id"])

    return index.mapInArrow(run, "doc_id long, item_id long")


def item_blocks(items: DataFrame, most: int = BLOCK_BYTES, width: int = WORDS) -> Iterator[tuple[list[int], list[str]]]:
    """The items in blocks of at most `most` bytes of text; a longer item is cut, width - 1 words repeated at each cut."""
    items = items.where("item_id IS NOT NULL AND item_text <> ''").select(F.col("item_id").cast("long"), "item_text")
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for item, text in items.toLocalIterator():
        pieces = [text]
        if len(text) * 4 > most:
            spans = [m.span() for m in re.finditer(r"[^\W_]+", text)]
            step = max(width, most // 8 // max(1, max((b - a for a, b in spans), default=1)))
            pieces = [text[spans[i][0] : spans[min(i + step + width - 1, len(spans)) - 1][1]] for i in range(0, len(spans), step)]
        for piece in pieces:
            if size and size + len(piece) * 4 > most:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(item)
            texts.append(piece)
            size += len(piece) * 4
    yield ids, texts


def leaked(index: DataFrame, items: DataFrame, width: int = WORDS, slop: int = 0, most: int = BLOCK_BYTES) -> DataFrame:
    """index: as `build_index` gives it, stored; items: item_id, item_text."""
    out = None
    blocks = item_blocks(items, most, width)
    ids, texts = next(blocks)
    while True:
        following = next(blocks, None)
        found = search_index(index, Queries(ids, texts, width), slop).distinct()
        if out is None and following is None:
            return found
        found = checkpointed(found)
        out = found if out is None else out.unionByName(found)
        if following is None:
            return out.distinct()
        ids, texts = following


def stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpointed(build_index(table(spark, sf_dir, "documents").select("doc_id", "text")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(stored_index(spark, sf_dir), table(spark, sf_dir, "eval_items"))


def p7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proximity matches: 12 consecutive words of an item, each at most two places from where the phrase has it."""
    return leaked(stored_index(spark, sf_dir), table(spark, sf_dir, "eval_items"), slop=2)


def p7_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents affected, with the number of items that leaked into each."""
    return p7_found(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"))


_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, regexp_extract_all(lower(item_text), '[\p{L}\p{N}]+') AS w FROM eval_items),
ds AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM dw WHERE len(w) >= 12)),
qs AS (SELECT item_id, array_to_string(w[i:i + 11], ' ') AS s FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM iw WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM ds JOIN qs USING (s)"""
SQL = {"p7_found": _SQL, "p7_documents": f"SELECT doc_id, count(*) AS n_items FROM ({_SQL}) GROUP BY doc_id"}
