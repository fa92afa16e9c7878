"""What the operators of this subpackage have in common: tables, paths, code-point arrays and hashes."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters and digits lie below this code point; a table of this length answers for all of Unicode.
LIMIT = 0x33480
U64 = np.uint64
MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Unset, a session on one machine gets a temporary one;
    on a cluster that is an error, for each executor would write to a disk of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="orderloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the folder that all executors share and read again: a lost executor costs only the tasks it ran.

    What was written stays until `clean` or the end of the session's process: results read it lazily.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _WRITTEN:
        atexit.register(clean, spark)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Deletes the tables that `checkpointed` wrote in this process; call it when their results have been read."""
    try:
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        while _WRITTEN:
            path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
            path.getFileSystem(conf).delete(path, True)
    except Exception:  # the session has ended: its folder is the cluster's to clean
        _WRITTEN.clear()


#: A bitmap of 2 ** 26 bits, 8 MB whatever the data, as a filter before a shuffle; more keys make it let more through.
FILTER_BITS = 26


def bitmap(df: DataFrame, column: str) -> np.ndarray:
    """The filter of a column of 64-bit hashes, built by a partial aggregation into at most 2 ** 20 words."""
    word = F.shiftrightunsigned(F.col(column), 64 - FILTER_BITS + 6)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.shiftrightunsigned(F.col(column), 64 - FILTER_BITS).bitwiseAND(F.lit(63))).cast("int"))
    got = df.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), U64)
    out[got.column("w").to_numpy()] = got.column("b").to_numpy().view(U64)
    return out


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False for hashes that the filter's column doesn't hold."""
    place = hashes >> U64(64 - FILTER_BITS)
    return (bits[(place >> U64(6)).astype(np.int64)] >> (place & U64(63))) & U64(1) == 1


def slices(batches: Iterable[pa.RecordBatch], weigh: list[str], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the named string columns of a piece hold about `most` bytes (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = np.zeros(n, np.int64)
        for name in weigh:
            length = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0)
            size += length.to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def codepoints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all rows one after another, offsets of length rows + 1). Null counts as empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    raw = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    text = b"" if data is None else memoryview(data)[int(raw[0]) : int(raw[-1])]
    points = np.frombuffer(str(text, "utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = pc.utf8_length(column).to_numpy(zero_copy_only=False)
    return points, np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


@functools.cache
def word_table() -> np.ndarray:
    """Code point -> its case-folded code point if it is a letter or digit, else 0; the last entry stands for all others.

    A letter whose folding is longer than one character keeps the first; callers that compare exactly
    fold such texts beforehand (see `folded`).
    """
    out = np.zeros(LIMIT + 1, np.uint32)
    for c in range(LIMIT):
        x = chr(c)
        if x.isalnum():
            out[c] = ord(x.casefold()[0])
    return out


@functools.cache
def long_folds() -> frozenset[str]:
    return frozenset(x for x in map(chr, range(LIMIT)) if x.isalnum() and len(x.casefold()) > 1)


def folded(column: pa.Array) -> pa.Array:
    """The column with those rows case-folded that hold a letter whose folding is longer than itself."""
    column = pc.fill_null(column, "")
    hit = pc.match_substring_regex(column, "[" + "".join(sorted(long_folds())) + "]")
    if not pc.any(hit).as_py():
        return column
    return pa.array([s.casefold() if h else s for s, h in zip(column.to_pylist(), hit.to_pylist())], pa.string())


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def mix_one(x: int) -> int:
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base & MASK, U64)
        steps[0] = 1
        have = _POWERS[base] = np.cumprod(steps)
    return have[:n]


def row_hashes(values: np.ndarray, keep: np.ndarray, starts: np.ndarray, base: int) -> np.ndarray:
    """For each row the polynomial hash, modulo 2 ** 64, of the kept values between its offsets."""
    running = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])
    first = running[starts[:-1]]
    kept = mix(values[keep].astype(U64) + U64(0x9E3779B97F4A7C15))
    row_of = np.repeat(np.arange(len(starts) - 1), running[starts[1:]] - first)
    place = np.arange(len(kept)) - first[row_of]
    terms = kept * powers(base, int(place.max()) + 1 if len(place) else 1)[place]
    total = np.concatenate([np.zeros(1, U64), np.cumsum(terms, dtype=U64)])
    return total[running[starts[1:]]] - total[first]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())
