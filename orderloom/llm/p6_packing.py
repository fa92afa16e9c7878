"""Problem 6: documents put whole into containers of a fixed number of tokens.

Method: harmonic packing. Lengths fall into reciprocal-capacity classes (class k holds lengths from C/(k+1) to C/k),
and each class fills its bins with exactly k of its documents, independently on every worker. Then, still on the same
worker, the room that a bin has left takes the largest smaller documents that fit; harmonic classes alone would
leave up to half of a bin empty. A worker is a hash share of about ITEMS_PER_WORKER documents, so its work is
bounded; only (id, piece, tokens) is shuffled, never text. A text above the capacity is cut into full pieces and a
rest that is packed like a document.

Defined cases: null and empty texts have no tokens and no container (null); equal texts are packed each by itself;
rows
without an id are left out; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checkpointed, slices, table

CAPACITY = 2048
ITEMS_PER_WORKER = 50_000
TOKENIZER = "byte_bpe_multi_50k.tiktoken"


@functools.lru_cache(2)
def encoding(path: str | None):
    """The public tokenizer: its vocabulary file (None: the installed one for many languages)."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(TOKENIZER), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sizes(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(doc_id, piece_no, start_token, n_tokens): one row per document, or per piece of one above the capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path)._core_bpe.encode_to_tiktoken_buffer
        none: set[str] = set()
        for batch in slices(batches, ["text"]):
            rows: list[int] = []
            out: list[tuple[int, int, int]] = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                n = memoryview(encode(text, none)).nbytes // 4 if text else 0
                for no, start in enumerate(range(0, max(n, 1), capacity), 1):
                    rows.append(i)
                    out.append((no, start, min(capacity, n - start)))
            no, start, n = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(no, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int32())], ["doc_id", "piece_no", "start_token", "n_tokens"]
            )

    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece_no int, start_token long, n_tokens int")


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin, counted from 0, of each length from 1 to capacity."""
    order = np.argsort(lengths, kind="stable")
    edge = np.searchsorted(lengths[order], np.arange(capacity + 2))
    left = np.diff(edge)  # documents of each length that have no bin yet
    lower = list(range(capacity + 1))  # union-find: the nearest length at or below that has documents

    def largest(n: int) -> int:
        root = n
        while lower[root] != root or (root and not left[root]):
            if lower[root] == root:
                lower[root] = root - 1
            root = lower[root]
        while lower[n] != root and n != root:
            lower[n], n = root, lower[n]
        return root

    bins = np.full(len(lengths), -1, np.int64)
    number = 0

    def put(n: int) -> None:
        left[n] -= 1
        bins[order[edge[n] + left[n]]] = number

    while top := largest(capacity):
        k = capacity // top  # the class of the longest that is left: lengths over capacity / (k + 1)
        floor, room = capacity // (k + 1), capacity
        for _ in range(k):
            if (n := largest(top)) <= floor:
                break  # the class has run out
            put(n)
            room -= n
        while room and (n := largest(room)):
            put(n)
            room -= n
        number += 1
    return bins


def containers(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, per_worker: int = ITEMS_PER_WORKER) -> DataFrame:
    """(doc_id, piece_no, start_token, n_tokens, container)."""
    sized = checkpointed(sizes(docs, capacity, path))
    workers = max(1, round(sized.count() / per_worker))

    def run(group: pa.Table) -> pa.Table:
        n = group.column("n_tokens").to_numpy()
        has = n > 0
        worker = group.column("worker")[0].as_py()
        number = np.zeros(len(n), np.int64)
        number[has] = pack(n[has], capacity) + (worker << 32)
        return group.drop_columns(["worker"]).append_column("container", pa.array(number, mask=~has))

    return (
        sized.withColumn("worker", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(workers)).cast("long"))
        .groupBy("worker")
        .applyInArrow(run, "doc_id long, piece_no int, start_token long, n_tokens int, container long")
    )


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers(table(spark, sf_dir, "documents"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are: their number, tokens, and the tokens of room left."""
    own = p6_containers(spark, sf_dir).where("container IS NOT NULL")
    return own.agg(F.count_distinct("container").alias("n_containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens")).withColumn(
        "room_left", F.col("n_containers") * CAPACITY - F.col("n_tokens")
    )
