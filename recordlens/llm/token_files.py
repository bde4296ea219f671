"""Token ids in files: a concatenated id array with Elias-Fano coded document boundaries.

A dataset is a Parquet folder, so that any store Spark can write will do and lost or repeated tasks
leave no halves behind. Each of its rows is one shard in the format below; shards are in
ascending doc_id order by (part, seq).

Shard, little-endian: magic ``RLTF``, version u16, bytes per id u16, documents u64, ids u64, documents
without doc_id u64, least doc_id i64, sizes of the next two u64 each; Elias-Fano ends of the
documents in the id array; Elias-Fano doc_ids above the least one; ids.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordlens.llm.common import keyed, shared_path, shuffle_partitions, text_slices
from recordlens.llm.elias_fano import EliasFano
from recordlens.llm.tokens import BATCH_BYTES, encoder

MAGIC = b"RLTF"
_HEAD = struct.Struct("<4sHHQQQqQQ")
# Ids of a shard, more only for a single document.
SHARD_IDS = 2 << 20
SHARD_SCHEMA = "part int, seq int, n_docs long, n_ids long, shard binary"


def write_shard(doc_ids: np.ndarray, known: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """Documents in ascending doc_id order, those without one last."""
    own = doc_ids[known].astype(np.int64)
    least = int(own[0]) if len(own) else 0
    ends = EliasFano.of(np.cumsum(counts)).to_bytes()
    names = EliasFano.of(own - least).to_bytes()
    head = _HEAD.pack(
        MAGIC, 1, ids.dtype.itemsize, len(counts), len(ids), int((~known).sum()), least, len(ends), len(names)
    )
    return head + ends + names + ids.astype(ids.dtype.newbyteorder("<")).tobytes()


class Shard:
    """A shard's bytes; documents are found by :meth:`span` without decoding the others."""

    def __init__(self, raw: bytes):
        magic, version, width, self.n, self.n_ids, self.unnamed, self.least, a, b = _HEAD.unpack_from(raw)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token shard")
        at = _HEAD.size
        self.ends = EliasFano.from_bytes(raw[at : at + a])
        self.names = EliasFano.from_bytes(raw[at + a : at + a + b])
        self.ids = np.frombuffer(raw, f"<u{width}", self.n_ids, at + a + b)

    def span(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        start, stop = self.span(i)
        return self.ids[start:stop]

    def doc_ids(self) -> tuple[np.ndarray, np.ndarray]:
        """(doc_ids, known)"""
        known = np.arange(self.n) < self.n - self.unnamed
        out = np.zeros(self.n, np.int64)
        out[known] = self.names.all() + self.least
        return out, known


def write_tokens(
    documents: DataFrame, folder: str, tokenizer: str, end_id: int, spaces: bool = False, shard_ids: int = SHARD_IDS
) -> None:
    """Encode every whole text of ``documents`` (doc_id, text) and write shards to ``folder``, by doc_id.

    ``end_id`` follows every document. A null text is empty, so it has the end id alone. Documents
    that repeat a doc_id follow each other by text; those without one come last. Other columns are
    left out; an empty table gives an empty dataset.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0
        enc = encoder(tokenizer, spaces)

        def flush() -> pa.RecordBatch:
            doc_ids, known, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(counts)], pa.int64()),
                 pa.array([len(ids)], pa.int64()), pa.array([write_shard(doc_ids, known, counts, ids)], pa.binary())],
                names=["part", "seq", "n_docs", "n_ids", "shard"],
            )

        for batch in batches:
            for piece in text_slices(batch, limit=BATCH_BYTES):
                ids, counts = enc.encode_ended(piece.column("text"), end_id)
                column = piece.column("doc_id")
                known = np.asarray(column.is_valid())
                held.append((np.asarray(column.fill_null(0)), known, counts, ids))
                size += len(ids)
                if size >= shard_ids:
                    yield flush()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield flush()

    spark = documents.sparkSession
    ordered = (
        keyed(documents)
        .repartitionByRange(shuffle_partitions(spark), "_key").sortWithinPartitions("_key")
        .select("doc_id", "text")
    )
    ordered.mapInArrow(run, SHARD_SCHEMA).write.option("compression", "zstd").parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) of every document of a dataset; ``ids`` as little-endian unsigned 32-bit integers.

    ``start`` counts the ids of all documents before it. Only the sizes of shards are summed up for it.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(folder)
    sizes = shards.select("part", "seq", "n_ids")
    within_part = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row per part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    starts = (
        sizes.withColumn("own", F.coalesce(F.sum("n_ids").over(within_part), F.lit(0)))
        .join(bases, "part").select("part", "seq", (F.col("base") + F.col("own")).alias("base"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.column("shard")[i].as_py())
                ends = shard.ends.all()
                begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                doc_ids, known = shard.doc_ids()
                base = batch.column("base")[i].as_py()
                wide = shard.ids.astype("<u4")
                for lo in range(0, shard.n, 4096):
                    hi = min(lo + 4096, shard.n)
                    body = wide[begin[lo] : ends[hi - 1]]
                    offsets = (np.concatenate([begin[lo:hi], ends[hi - 1 : hi]]) - begin[lo]) * 4
                    values = pa.LargeBinaryArray.from_buffers(
                        pa.large_binary(), hi - lo, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body)]
                    )
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids[lo:hi], mask=~known[lo:hi]), pa.array(begin[lo:hi] + base),
                         values.cast(pa.binary())],
                        names=["doc_id", "start", "ids"],
                    )

    return (
        shards.select("part", "seq", "shard").join(starts, ["part", "seq"]).select("base", "shard")
        .mapInArrow(run, "doc_id long, start long, ids binary")
    )


def round_trip(
    documents: DataFrame, tokenizer: str, end_id: int, spaces: bool = False, folder: str | None = None
) -> DataFrame:
    """Write ``documents`` to a dataset (in the shared folder unless given) and read it back."""
    folder = folder or shared_path(documents.sparkSession, "tokens")
    write_tokens(documents, folder, tokenizer, end_id, spaces)
    return read_tokens(documents.sparkSession, folder)
