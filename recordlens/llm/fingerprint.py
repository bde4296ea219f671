"""Document fingerprints as a homomorphic multiset hash of paragraphs.

Every paragraph (a line with something in it, trimmed) is hashed to a wide vector, and a document's fingerprint is
the sum of its paragraphs' vectors: 4 lanes modulo 2^64 that decide equality, and 128 lanes modulo 2^32 to which every
word shingle of the paragraph adds or takes one. So the order of paragraphs does not matter, and paragraphs are put in
or taken out by adding or subtracting their vectors. The squared distance of the second lanes estimates how many
shingles two documents don't share, from which their likeness follows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.llm.common import (
    Block, RangeHash, block_of, keyed, pack, shuffle_partitions, space_words, text_slices, window_hashes,
)

EQUAL_LANES, COUNT_LANES = 4, 128
SHINGLE_WORDS = 3
STEP_BYTES = 1 << 20

SCHEMA = (
    "doc_id long, n_chars long, edited_text_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def vectors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Per text the lanes of equality (uint64) and of counts (int32)."""
    equal = np.zeros((len(texts), EQUAL_LANES), np.uint64)
    counts = np.zeros((len(texts), COUNT_LANES), np.int32)
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > STEP_BYTES:
            equal[lo:i], counts[lo:i] = _vectors(texts[lo:i])
            lo = i
            size = 0
        size += len(t)
    if lo < len(texts):
        equal[lo:], counts[lo:] = _vectors(texts[lo:])
    return equal, counts


def _vectors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lines = [[s for x in t.split(b"\n") if (s := x.strip())] for t in texts]
    per_text = np.fromiter(map(len, lines), np.int64, len(texts))
    flat = [x for ls in lines for x in ls]
    digests = b"".join([hashlib.blake2b(x, digest_size=8 * EQUAL_LANES).digest() for x in flat])
    owner = np.repeat(np.arange(len(texts)), per_text)
    equal = np.zeros((len(texts), EQUAL_LANES), np.uint64)
    begin = np.cumsum(per_text) - per_text
    has = per_text > 0
    if flat:
        equal[has] = np.add.reduceat(np.frombuffer(digests, "<u8").reshape(-1, EQUAL_LANES), begin[has], axis=0)
    sizes = np.fromiter(map(len, flat), np.int64, len(flat))
    block = Block(np.frombuffer(b"".join(flat), np.uint8), np.concatenate([[0], np.cumsum(sizes)]))
    starts, ends = space_words(block)
    line = np.searchsorted(block.starts, starts, side="right") - 1
    first, h = window_hashes(RangeHash(block.data).of(starts, ends), line, SHINGLE_WORDS)
    lane = owner[line[first]] * COUNT_LANES + (h & np.uint64(COUNT_LANES - 1)).astype(np.int64)
    sign = ((h >> np.uint64(32)) & np.uint64(1)).astype(np.float64) * 2 - 1
    total = np.bincount(lane, weights=sign, minlength=len(texts) * COUNT_LANES)
    return equal, total.astype(np.int64).astype(np.int32).reshape(len(texts), COUNT_LANES)


def encode(equal: np.ndarray, counts: np.ndarray) -> str:
    return base64.b64encode(equal.astype("<u8").tobytes() + counts.astype("<i4").tobytes()).decode()


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    return np.frombuffer(raw, "<u8", EQUAL_LANES), np.frombuffer(raw, "<i4", COUNT_LANES, 8 * EQUAL_LANES)


def fingerprint(text: str | None) -> str:
    equal, counts = vectors([(text or "").encode()])
    return encode(equal[0], counts[0])


def insert(fp: str, paragraphs: str) -> str:
    """The fingerprint after putting in paragraphs."""
    (a, b), (c, d) = decode(fp), decode(fingerprint(paragraphs))
    return encode(a + c, b + d)


def delete(fp: str, paragraphs: str) -> str:
    """The fingerprint after taking out paragraphs that are in it."""
    (a, b), (c, d) = decode(fp), decode(fingerprint(paragraphs))
    return encode(a - c, b - d)


def likeness(e: np.ndarray, c: np.ndarray, f: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Row by row, 0 to 1: the estimated share of shingles in common; 1 for equal multisets of paragraphs."""
    apart = ((c - d).astype(np.float64) ** 2).sum(axis=1)
    both = (c.astype(np.float64) ** 2).sum(axis=1) + (d.astype(np.float64) ** 2).sum(axis=1)
    near = np.clip(1 - apart / np.maximum(both, 1), 0, 1)
    return np.where((e == f).all(axis=1), 1.0, near)


def likeness_of(a: str, b: str) -> float:
    (e, c), (f, d) = decode(a), decode(b)
    return float(likeness(e[None], c[None], f[None], d[None])[0])


def _in_ranges(documents: DataFrame, tops: np.ndarray) -> DataFrame:
    """Packed texts by range of keys; the top row of each range also goes, as a guest, to the range above it.

    The range above ends with the row just over it, whose next row in descending order is that guest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch, limit=16 << 20):
                keys = np.asarray(piece.column("_key"))
                ids = piece.column("doc_id")
                bucket = np.searchsorted(tops, keys)
                top = np.flatnonzero(tops[bucket] == keys)
                row = np.concatenate([np.arange(len(keys)), top])
                where = np.concatenate([bucket, (bucket[top] + 1) % len(tops)])
                guest = np.concatenate([np.zeros(len(keys), np.int64), np.ones(len(top), np.int64)])
                known, values = np.asarray(ids.is_valid()).astype(np.int64), np.asarray(ids.fill_null(0))
                order = np.argsort(where, kind="stable")
                for chunk in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
                    if len(chunk):
                        r = row[chunk]
                        block = block_of(piece.column("text").take(pa.array(r)))
                        body = pack(keys[r], values[r], known[r], guest[chunk], block.sizes(), block.data)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([where[chunk[0]]], pa.int32()), pa.array([len(r)], pa.int64()),
                             pa.array([len(block.data)], pa.int64()), pa.array([body], pa.binary())],
                            names=["bucket", "n", "size", "payload"],
                        )

    return documents.mapInArrow(run, "bucket int, n long, size long, payload binary")


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text of ``documents`` (doc_id, text) and of its edited text, and their likeness.

    (doc_id, n_chars, edited_text_sha256, fingerprint, edited_fingerprint, near_edited, near_next). The edited text has
    its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document's, in descending
    doc_id order; after the last comes the first. A null text is empty. Rows that repeat a doc_id follow each other by text
    in that order, and rows without a doc_id come first in it, so every row has a next one. Other columns are left out; an
    empty table gives no rows.
    """
    docs = keyed(documents)
    parts = shuffle_partitions(documents.sparkSession)
    shares = [i / parts for i in range(1, parts)] or [0.5]
    # Keys of the table itself, so each top is a row; their number is that of the shuffle partitions.
    row = docs.agg(
        F.percentile_approx("_key", shares, max(10_000, 20 * parts)).alias("tops"), F.max("_key").alias("last")
    ).first()
    if row["last"] is None:
        return documents.sparkSession.createDataFrame([], SCHEMA)
    tops = np.unique(np.array([*row["tops"], row["last"]], np.int64))

    def run(table: pa.Table) -> pa.Table:
        heads, texts = [], []
        for n, size, payload in zip(
            table["n"].to_pylist(), table["size"].to_pylist(), table["payload"].to_pylist(), strict=True
        ):
            raw = pa.decompress(payload, decompressed_size=n * 40 + size, codec="zstd", asbytes=True)
            head = np.frombuffer(raw, np.int64, n * 5).reshape(5, n)
            heads.append(head)
            ends = n * 40 + np.cumsum(head[4])
            texts += [raw[a:b] for a, b in zip((ends - head[4]).tolist(), ends.tolist(), strict=True)]
        key, doc_id, known, guest, _ = np.concatenate(heads, axis=1)
        order = np.lexsort((-key, guest))  # descending, the guest behind all others
        own = int((guest == 0).sum())
        out = []
        for lo in range(0, own, 1024):
            i = order[lo : lo + 1025]  # one more, as the next of the last
            some = [texts[j] for j in i]
            n = min(1024, own - lo)
            plain = [t.decode() for t in some]
            edited = [
                (a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()
                for a, b in zip(plain[:n], plain[1 : n + 1], strict=True)
            ]
            e, c = vectors(some)
            f, d = vectors(edited)
            out.append(pa.table([
                pa.array(doc_id[i[:n]], mask=known[i[:n]] == 0), pa.array([len(t) for t in plain[:n]], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in edited]),
                pa.array([encode(x, y) for x, y in zip(e[:n], c[:n], strict=True)]),
                pa.array([encode(x, y) for x, y in zip(f, d, strict=True)]),
                pa.array(likeness(e[:n], c[:n], f, d)), pa.array(likeness(e[:n], c[:n], e[1 : n + 1], c[1 : n + 1])),
            ], names=[x.split()[0] for x in SCHEMA.split(", ")]))
        return pa.concat_tables(out) if out else pa.schema([
            ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_text_sha256", pa.string()),
            ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
            ("near_next", pa.float64()),
        ]).empty_table()

    return _in_ranges(docs.select("_key", "doc_id", "text"), tops).groupBy("bucket").applyInArrow(run, SCHEMA)
