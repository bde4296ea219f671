"""Helpers of several operators: stored tables, Arrow batches in bounded slices, word hashes."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

# Bytes of text that one step inside a task works on at a time.
SLICE_BYTES = 2 << 20

MASK64 = (1 << 64) - 1
# Odd multiplier of the position hash and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path under ``spark.checkpoint.dir``, which driver and executors share.

    Only a single-process session (``local[...]``) may do without that setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "recordlens-llm")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back; lost executors don't undo it."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of at most ``limit`` bytes of text each, or a single longer row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


@dataclass
class Block:
    """Texts laid end to end: ``data[starts[i]:starts[i + 1]]`` are the UTF-8 bytes of text i."""

    data: np.ndarray
    starts: np.ndarray

    def sizes(self) -> np.ndarray:
        return np.diff(self.starts)


def block_of(texts: pa.Array) -> Block:
    """The bytes of a string column; null counts as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    if not len(offsets):
        return Block(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    return Block(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a finaliser of multiply and shift steps)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


# A random 64-bit value per byte, by a rule.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n; kept for the next call."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((BASE, BASE_INVERSE)):
            out = np.ones(1, np.uint64)
            while len(out) < size:
                out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
            _powers[k] = out
    return _powers[0][:n], _powers[1][:n]


def release_memory() -> None:
    """Give memory that is not in use back to the system, and forget the tables of :func:`powers`."""
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, which leaves a worker as small as it can when its task ends; workers go on to tasks of other stages."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return tidy


class RangeHash:
    """64-bit hashes of any byte ranges of a block, each from two prefix sums.

    Equal bytes have equal hashes wherever they lie, also in other blocks.
    """

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        lengths = (stop - start).astype(np.uint64)
        return mix((self.sums[stop] - self.sums[start]) * self.down[start] + lengths * np.uint64(BASE))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def within(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for every n in ``counts``, end to end."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def keyed(documents: DataFrame, columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """(_key, doc_id, *columns): a unique key that orders the rows as doc_id does.

    That is doc_id itself where it has no nulls and no repeats. Otherwise rows get their rank by
    (doc_id, columns), nulls last, from a range partitioning that is stored, and one offset
    per partition; rows equal in all of these differ in rank only.
    """
    from pyspark.sql import functions as F

    plain = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *columns)
    ids = plain.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if ids.filter("n > 1 or doc_id is null").isEmpty():
        return plain.select(F.col("doc_id").alias("_key"), "doc_id", *columns)
    order = [F.asc_nulls_last("doc_id"), *[F.asc_nulls_last(c) for c in columns]]
    return ranked(plain, order).withColumnRenamed("_rank", "_key")


def ranked(df: DataFrame, order: list) -> DataFrame:
    """``df`` with ``_rank`` from 0 in ``order``: a stored range partitioning plus an offset per partition."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    parts = store(
        df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
        .withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}),
        "ranked",
    )
    # One row per partition.
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # The low 33 bits count the rows of a partition.
    at = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return parts.join(offsets, "_part").withColumn("_rank", F.col("_before") + at).drop("_part", "_at", "_before")


# Most keys of a table that are joined by broadcast; no table of counted keys has more that are that frequent.
FREQUENT_KEYS = 100_000


def join_counted(rows: DataFrame, table: DataFrame, on: list[str], size: str, how: str = "left") -> DataFrame:
    """``rows`` joined (left or inner) with a stored ``table``, whose column ``size`` says how many of the rows each of its keys meets.

    Keys of many rows are few: those above ``total / FREQUENT_KEYS`` number at most FREQUENT_KEYS whatever the size of the
    table, and are joined by broadcast, so no hot key is gathered in one task. All others are joined as the optimizer likes.
    """
    from pyspark.sql import functions as F

    total = table.agg(F.sum(size)).first()[0] or 0  # one number
    bound = max(1_000, total // FREQUENT_KEYS)
    often = table.filter(F.col(size) > bound)
    if often.isEmpty():
        return rows.join(table, on, how)
    often = F.broadcast(often)
    hot, rest = rows.join(often, on), table.filter(F.col(size) <= bound)
    others = rows if how == "inner" else rows.join(often.select(*on), on, "left_anti")
    return hot.unionByName(others.join(rest, on, how))


def pack(*arrays: np.ndarray) -> bytes:
    """Columns of equal length as one compressed value; sorted integers go in as differences."""
    return pa.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int, *dtypes: str) -> list[np.ndarray]:
    size = n * sum(np.dtype(t).itemsize for t in dtypes)
    raw = pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True)
    out, at = [], 0
    for t in dtypes:
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def space_words(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches without ASCII white space; none crosses texts."""
    return _stretches(block, NOT_SPACE)


def plain_words(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of ASCII letters and digits and of all bytes beyond ASCII."""
    return _stretches(block, WORD_BYTE)


NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
WORD_BYTE = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def _stretches(block: Block, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = member[block.data]
    n = len(inside)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    # A text's edge also parts words.
    cut = block.starts[(block.starts > 0) & (block.starts < n)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def window_hashes(values: np.ndarray, group: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, hash) of every ``k`` neighbours of one group; a shorter group gives one of all it has.

    ``group`` is non-decreasing. The hash depends on the order.
    """
    n = len(values)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.concatenate([begin, [n]]))
    out = np.zeros(n, np.uint64)
    for j in range(min(k, n)):
        shifted = values[j:] * np.uint64(pow(BASE, j + 1, 1 << 64))
        if j:
            shifted = np.where(group[j:] == group[:-j], shifted, np.uint64(0))
        out[: n - j] += shifted
    counts = np.maximum(sizes - k + 1, 1)
    first = np.repeat(begin, counts) + within(counts)
    return first, mix(out[first])
