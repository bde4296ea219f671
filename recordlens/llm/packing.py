"""Packing of documents into sequences with a controlled mixture of sources.

Every source is a queue of documents, read as one stream of token ids and cut into quanta. The
deficit counter of a source grows by its share with every quantum that any source sends, and it sends
its next one when the counter is half a quantum short of zero; ties go round in the order of the
sources. So quantum i of a source with weight w is due at (i + 1/2) / w, whatever the other sources
hold, and its place in the whole schedule is the number of quanta due before it, a closed form
over the sources. Sequences are consecutive quanta of the schedule. Deficits thus carry over from
window to window, and from partition to partition without any message between them; once a
source has run dry the others go on in proportion.

What does not fill a quantum or a sequence at the end is laid end to end, cut into full
sequences, and the rest of that into sequences whose lengths are powers of two. Nothing is padded.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordlens.llm.common import freed, store, text_slices, within
from recordlens.llm.tokens import encoder, forget_encoders

SEQUENCE = 2048
QUANTUM = 256
# Bytes of text that a task encodes at a time.
SLICE_BYTES = 2 << 20
# Sources of at most this many quanta are counted by one sorted table of their due times, larger ones by the closed form.
FEW_QUANTA = 64

TOKEN_SCHEMA = "chunk int, queue string, doc_id long, before long, n long, ids binary"
PIECE_SCHEMA = "doc_id long, queue string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Schedule:
    """Which place of which sequence every id of every queue gets; a few numbers per queue."""

    def __init__(self, lengths: list[int], weights: list[float], sequence: int = SEQUENCE, quantum: int = QUANTUM):
        if sequence % quantum:
            raise ValueError("the quantum must divide the sequence")
        self.sequence, self.quantum, self.slots = sequence, quantum, sequence // quantum
        self.weights = np.array(weights, np.float64)
        lengths = np.array(lengths, np.int64)
        self.full = lengths // quantum
        self.rest = lengths % quantum
        total = int(self.full.sum())
        self.windows = total // self.slots
        # Behind the full windows: whole quanta left over, then what is less than one, by queue.
        left = (total - self.windows * self.slots) * quantum
        self.rest_at = left + np.cumsum(self.rest) - self.rest
        self.tail = left + int(self.rest.sum())
        cuts = [sequence] * (self.tail // sequence)
        size = sequence
        while size > 1:
            size //= 2
            if self.tail % sequence & size:
                cuts.append(size)
        self.cut_at = np.concatenate([[0], np.cumsum(cuts)]).astype(np.int64)

    @cached_property
    def few(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct due times of the small queues' quanta, and the quanta in order as (place of the due time, queue) in one number."""
        small = np.flatnonzero((self.full > 0) & (self.full <= FEW_QUANTA))
        counts = self.full[small]
        queue = np.repeat(small, counts)
        times, at = np.unique(self.due(queue, within(counts)), return_inverse=True)
        return times, np.sort(at * len(self.full) + queue)

    def due(self, queue: int | np.ndarray, i: np.ndarray) -> np.ndarray:
        return (i + 0.5) / self.weights[queue]

    def rank(self, queue: int | np.ndarray, i: np.ndarray) -> np.ndarray:
        """Quanta sent before quantum ``i`` of a queue, or of a queue each, by (due, queue)."""
        queue = np.broadcast_to(queue, i.shape)
        when = self.due(queue, i)
        times, quanta = self.few
        at = np.searchsorted(times, when)
        equal = np.append(times, np.inf)[at] == when
        # The table counts a small queue's own quanta too.
        out = np.searchsorted(quanta, at * len(self.full) + np.where(equal, queue, 0)) + np.where(self.full[queue] > FEW_QUANTA, i, 0)
        for q in np.flatnonzero(self.full > FEW_QUANTA).tolist():
            # The first guess is off by rounding at most; the comparison of due times itself decides.
            k = np.clip((when * self.weights[q] + 0.5).astype(np.int64), 0, self.full[q])
            for _ in range(2):
                back = self.due(q, k - 1)
                k = np.where((k > 0) & ~((back < when) | ((back == when) & (q < queue))), k - 1, k)
            for _ in range(2):
                here = self.due(q, k)
                k = np.where((k < self.full[q]) & ((here < when) | ((here == when) & (q < queue))), k + 1, k)
            out += np.where(queue == q, 0, k)
        return out

    def pieces(self, queue: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, start in it, length, sequence, offset) of stretches ``[begin, begin + n)`` of a queue each."""
        first, last = begin // self.quantum, (begin + n - 1) // self.quantum
        counts = last - first + 1
        doc = np.repeat(np.arange(len(begin)), counts)
        i = first[doc] + within(counts)
        lo = np.maximum(begin[doc], i * self.quantum)
        hi = np.minimum((begin + n)[doc], (i + 1) * self.quantum)
        queue = queue[doc]
        whole = i < self.full[queue]
        at = np.empty(len(i), np.int64)
        # Documents are consecutive, so a quantum of several documents comes up several times.
        order = np.lexsort((i[whole], queue[whole]))
        quanta = np.stack([queue[whole], i[whole]])[:, order]
        new = np.concatenate([[True], (quanta[:, 1:] != quanta[:, :-1]).any(axis=0)])[: quanta.shape[1]]
        place = np.empty(len(order), np.int64)
        place[order] = self.rank(quanta[0, new], quanta[1, new])[np.cumsum(new) - 1]
        at[whole] = place * self.quantum + lo[whole] - i[whole] * self.quantum
        body = self.windows * self.sequence
        at[~whole] = body + self.rest_at[queue[~whole]] + lo[~whole] - i[~whole] * self.quantum
        size = hi - lo
        start = lo - begin[doc]
        done = at < body
        out = [(doc[done], start[done], size[done], at[done] // self.sequence, at[done] % self.sequence)]
        # The tail's cuts may fall inside a quantum.
        d, s, z, a = doc[~done], start[~done], size[~done], at[~done] - body
        while len(d):
            k = np.searchsorted(self.cut_at, a, side="right") - 1
            room = np.minimum(z, self.cut_at[k + 1] - a)
            out.append((d, s, room, self.windows + k, a - self.cut_at[k]))
            more = z > room
            d, s, z, a = d[more], (s + room)[more], (z - room)[more], (a + room)[more]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _queue() -> Column:
    """A queue per source; a null source is a source of its own."""
    return F.coalesce(F.concat(F.lit("s:"), F.col("source").cast("string")), F.lit("none"))


def encode_documents(documents: DataFrame, tokenizer: str, end_id: int, spaces: bool) -> DataFrame:
    """Stored ids of every document, with the ids of its queue before it in the task that encoded it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId()
        enc = encoder(tokenizer, spaces)
        seen: dict[str, int] = {}
        for batch in batches:
            for piece in text_slices(batch, limit=SLICE_BYTES):
                ids, counts = enc.encode_ended(piece.column("text"), end_id)
                ends = np.cumsum(counts)
                raw = ids.tobytes()
                width = ids.dtype.itemsize
                queues = piece.column("queue").to_pylist()
                before = []
                for q, n in zip(queues, counts.tolist(), strict=True):
                    before.append(seen.get(q, 0))
                    seen[q] = before[-1] + n
                values = [raw[a * width : b * width] for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(counts), chunk), pa.int32()), piece.column("queue"), piece.column("doc_id"),
                     pa.array(before, pa.int64()), pa.array(counts), pa.array(values, pa.binary())],
                    names=["chunk", "queue", "doc_id", "before", "n", "ids"],
                )

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _queue().alias("queue"))
    return store(rows.mapInArrow(freed(run), TOKEN_SCHEMA), "packing")


def pack_documents(
    documents: DataFrame, tokenizer: str, end_id: int, spaces: bool = True, targets: Mapping[str | None, float] | None = None,
    sequence: int = SEQUENCE, quantum: int = QUANTUM,
) -> DataFrame:
    """Pieces of all documents (doc_id, text, source): doc_id, queue, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` are little-endian unsigned 32-bit integers, of which every id of every document is in exactly one piece.
    ``targets`` gives weights by source (null for rows without one); a source it lacks has the
    least weight named. Without targets each source's share of every window is that of its tokens. A null
    text is empty and has the end id alone. Rows that repeat a doc_id, or have none, are packed
    each on its own. Other columns are left out; an empty table gives no rows. Every source has a queue, however many
    there are.
    """
    tokens = encode_documents(documents, tokenizer, end_id, spaces)
    by_chunk = tokens.groupBy("chunk", "queue").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("queue").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_chunk.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select("chunk", "queue", "base")
    totals = {r["queue"]: r["n"] for r in by_chunk.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # a row per source
    names = sorted(totals)
    if targets is None:
        weights = [float(totals[q]) for q in names]
    else:
        named = {("none" if s is None else f"s:{s}"): float(w) for s, w in targets.items()}
        if any(w <= 0 for w in named.values()):
            raise ValueError("weights must be positive")
        weights = [named.get(q, min(named.values(), default=1.0)) for q in names]
    schedule = Schedule([totals[q] for q in names], weights, sequence, quantum)
    numbers = {q: i for i, q in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The workers that encoded are used again here.
        forget_encoders()
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                queue = np.array([numbers[q] for q in part.column("queue").to_pylist()], np.int64)
                begin = np.asarray(part.column("at"))
                n = np.asarray(part.column("n"))
                doc, start, length, seq, offset = schedule.pieces(queue, begin, n)
                order = np.lexsort((start, doc))
                doc, start, length, seq, offset = (x[order] for x in (doc, start, length, seq, offset))
                raw = part.column("ids").to_pylist()
                width = len(raw[0]) // int(n[0])
                wide = np.frombuffer(b"".join(raw), f"<u{width}").astype("<u4").tobytes()
                at = (np.cumsum(n) - n)[doc] + start
                values = [wide[4 * a : 4 * (a + z)] for a, z in zip(at.tolist(), length.tolist(), strict=True)]
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(take), part.column("queue").take(take), pa.array(start), pa.array(length),
                     pa.array(values, pa.binary()), pa.array(n[doc]), pa.array(seq), pa.array(offset)],
                    names=["doc_id", "queue", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    placed = tokens.join(bases, ["chunk", "queue"]).select(
        "doc_id", "queue", (F.col("base") + F.col("before")).alias("at"), "n", "ids"
    )
    return placed.mapInArrow(freed(run), PIECE_SCHEMA)


def sequences(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """(sequence_id, length, ids): pieces put together; a group is one sequence, so it is bounded."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(table["offset"]))
        parts = table["ids"].to_pylist()
        ids = b"".join(parts[i] for i in order)
        return pa.table(
            {"sequence_id": table["sequence_id"].slice(0, 1), "length": pa.array([len(ids) // 4], pa.int64()),
             "ids": pa.array([ids], pa.binary())}
        )

    return pieces.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(
        run, "sequence_id long, length long, ids binary"
    )
