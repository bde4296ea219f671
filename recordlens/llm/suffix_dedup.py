"""Exact removal of repeated byte strings over a whole corpus, by suffix sorting.

A byte goes if a string of ``length`` bytes that covers it also starts earlier. The suffixes
that can matter are found first, so that few of them are sorted and little is shuffled:

1. Every window of ``length`` bytes picks an anchor, the place in it whose next ``ANCHOR`` bytes have
   the least hash. Equal windows pick the same anchor, so they meet at its hash. An anchor's
   context is the stretch of the windows that picked it.
2. Anchors are grouped by hash. Of equal contexts all but the first are repeats, whole. They
   are reduced before the shuffle, so a hot group has one row per task and distinct context.
3. First contexts that share an anchor with different ones are cut out of the texts and sorted:
   two-stage suffix sorting of the suffixes that start a window, then common prefixes of
   neighbours. Runs of at least ``length`` are equal windows; all but the first are repeats.
   An anchor with very many distinct contexts (a short line that many documents share) is split
   by the hash of each window instead, so no task gathers it.
4. Repeats are brought back to the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.llm.common import (
    BASE, Block, RangeHash, block_of, deltas, keyed, mix, pack, runs, shuffle_partitions, store, text_slices, unpack,
    within,
)
from recordlens.llm.suffix_sort import common_prefix, suffix_order, words_at

LENGTH = 100
ANCHOR = 32
# Distinct contexts of one anchor that one task sorts together.
SORTED_TOGETHER = 2_048
PLACE_BITS = 22  # places of a slice, in the low bits of what the windows take the least of

ANCHOR_SCHEMA = "bucket int, n long, payload binary"
PART_SCHEMA = "part int, kind int, n long, payload binary"
COVERED, WANTED = 0, 1


def _part_of(key: np.ndarray, parts: int) -> np.ndarray:
    return (mix(key.view(np.uint64) + np.uint64(BASE)) % np.uint64(parts)).astype(np.int64)


def _by(where: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, its places in order) of small integers."""
    order = np.argsort(where, kind="stable")
    at = where[order]
    cuts = np.flatnonzero(np.diff(at)) + 1
    for chunk in np.split(order, cuts):
        if len(chunk):
            yield int(where[chunk[0]]), chunk


def find_anchors(block: Block, length: int, anchor: int):
    """(place, first window, last window, hash) of every anchor, and the range hashes of the block."""
    hashes = RangeHash(block.data)
    width = length - anchor + 1
    counts = np.maximum(block.sizes() - length + 1, 0)
    windows = np.repeat(block.starts[:-1], counts) + within(counts)
    if not len(windows):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), hashes)
    at = np.arange(len(block.data) - anchor + 1)
    h = hashes.of(at, at + anchor)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (h & ~low) | at.astype(np.uint64)
    step = 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < width:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    picked = (least[windows] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (picked[1:] != picked[:-1]) | (windows[1:] != windows[:-1] + 1)]))
    last = np.concatenate([new[1:], [len(windows)]]) - 1
    place = picked[new]
    return place, windows[new], windows[last], h[place], hashes


def _anchors(documents: DataFrame, length: int, anchor: int, buckets: int) -> DataFrame:
    """Packed anchors by bucket of their hash; of equal contexts in a batch only the first, the rest as covered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in text_slices(batch, limit=12 << 20):
                found = []
                for part in text_slices(some, limit=1 << 20):
                    if _too_long(part):
                        yield from found_long(part)
                    else:
                        found.append(one(block_of(part.column("text")), np.asarray(part.column("_key"))))
                if found:
                    yield pieces(found)

    def _too_long(part: pa.RecordBatch) -> bool:
        return part.num_rows == 1 and (pc.binary_length(part.column("text"))[0].as_py() or 0) >= 1 << PLACE_BITS

    def found_long(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """A single very long text in stretches that overlap by all but one byte of a window."""
        block, key = block_of(part.column("text")), np.asarray(part.column("_key"))
        step = 1 << 20
        for lo in range(0, max(1, len(block.data) - length + 1), step):
            data = block.data[lo : lo + step + length - 1]
            piece = one(Block(data, np.array([0, len(data)])), key)
            piece["first"] = piece["first"] + lo
            yield pieces([piece])

    def one(block: Block, keys: np.ndarray) -> dict[str, np.ndarray]:
        place, first, last, h, hashes = find_anchors(block, length, anchor)
        doc = np.searchsorted(block.starts, place, side="right") - 1
        c = hashes.of(first, last + length) + (place - first).astype(np.uint64) * np.uint64(BASE)
        return {
            "h": h, "c": mix(c), "key": keys[doc], "first": first - block.starts[doc],
            "span": (last - first).astype(np.uint8), "pre": (place - first).astype(np.uint8),
        }

    def pieces(found: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        a = {k: np.concatenate([f[k] for f in found]) for k in found[0]}
        order = np.lexsort((a["first"], a["key"]))
        a = {k: v[order] for k, v in a.items()}
        # The first of equal contexts goes on; the others only need to say where they are.
        _, at = np.unique(a["h"] ^ (a["c"] * np.uint64(BASE)), return_index=True)
        fresh = np.zeros(len(order), bool)
        fresh[at] = True
        rows = []
        where = (a["h"] % np.uint64(buckets)).astype(np.int64)
        for b, i in _by(np.where(fresh, where, -1)):
            if b >= 0:
                rows.append((b, len(i), pack(
                    a["h"][i], a["c"][i], deltas(a["key"][i]), deltas(a["first"][i]), a["span"][i], a["pre"][i]
                )))
        i = np.flatnonzero(~fresh)
        if len(i):
            rows.append((-1, len(i), pack(
                deltas(a["key"][i]), deltas(a["first"][i]), a["span"][i].astype(np.int64) + length
            )))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
             pa.array([r[2] for r in rows], pa.binary())],
            names=["bucket", "n", "payload"],
        )

    return documents.select("_key", "text").mapInArrow(run, ANCHOR_SCHEMA)


def _rows(found: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return pa.table(
        [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()),
         pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.binary())],
        names=["part", "kind", "n", "payload"],
    )


def _covered_rows(key: np.ndarray, start: np.ndarray, size: np.ndarray, parts: int) -> list[tuple]:
    """Covered stretches (key, start, size), merged where they overlap, packed by the part of their document."""
    if not len(key):
        return []
    order = np.lexsort((start, key))
    key, start, stop = key[order], start[order], (start + size)[order]
    keep = _merge(key, start, stop)
    key, start, stop = keep
    return [
        (p, COVERED, len(i), pack(deltas(key[i]), deltas(start[i]), stop[i] - start[i]))
        for p, i in _by(_part_of(key, parts))
    ]


def _merge(key: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted stretches with overlapping and touching ones of a document joined."""
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    # The running end within a document: lift every document above the one before.
    span = int(stop.max()) + 1
    top = np.maximum.accumulate(stop + group * span) - group * span
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (start[1:] > top[:-1])])
    at = np.flatnonzero(new)
    end = np.concatenate([at[1:], [len(key)]]) - 1
    return key[at], start[at], top[end]


def _meet(anchors: DataFrame, length: int, parts: int, together: int) -> DataFrame:
    """Per bucket: repeats of equal contexts, and the first contexts that have to be sorted."""

    def run(table: pa.Table) -> pa.Table:
        kinds: list[list[np.ndarray]] = []
        for n, payload in zip(table["n"].to_pylist(), table["payload"].to_pylist(), strict=True):
            h, c, key, first, span, pre = unpack(payload, n, "u8", "u8", "i8", "i8", "u1", "u1")
            kinds.append([h, c, np.cumsum(key), np.cumsum(first), span, pre])
        h, c, key, first, span, pre = (np.concatenate(x) for x in zip(*kinds, strict=True))
        order = np.lexsort((first, key, c, h))
        h, c, key, first, span, pre = (x[order] for x in (h, c, key, first, span, pre))
        new_h = np.concatenate([[True], h[1:] != h[:-1]])
        new_c = new_h | np.concatenate([[True], c[1:] != c[:-1]])
        found = _covered_rows(key[~new_c], first[~new_c], span[~new_c].astype(np.int64) + length, parts)
        group = np.cumsum(new_h) - 1
        contexts = np.bincount(group, weights=new_c)[group]
        i = np.flatnonzero(new_c & (contexts > 1))
        if len(i):
            order = np.lexsort((first[i], key[i]))
            i = i[order]
            many = (contexts[i] > together).astype(np.uint8)
            for p, j in _by(_part_of(key[i], parts)):
                k = i[j]
                found.append((p, WANTED, len(k), pack(
                    h[k], deltas(key[k]), deltas(first[k]), span[k], pre[k], many[j]
                )))
        return _rows(found)

    return anchors.filter("bucket >= 0").groupBy("bucket").applyInArrow(run, PART_SCHEMA)


def _texts_by_part(documents: DataFrame, parts: int) -> DataFrame:
    """(part, n, payload, size): whole documents, packed by part; read by two later steps, shuffled once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, doc_ids = np.asarray(batch.column("_key")), batch.column("doc_id")
            for p, i in _by(_part_of(keys, parts)):
                # A very long text has a row of its own.
                for piece in text_slices(batch.take(pa.array(i)), limit=32 << 20):
                    block = block_of(piece.column("text"))
                    k, ids = np.asarray(piece.column("_key")), piece.column("doc_id")
                    known = np.asarray(pc.is_valid(ids)).astype(np.uint8)
                    values = np.asarray(pc.fill_null(ids, 0))
                    body = pack(k, values, block.sizes(), known.astype(np.int64), block.data)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p], pa.int32()), pa.array([len(k)], pa.int64()), pa.array([body], pa.binary()),
                         pa.array([len(block.data)], pa.int64())],
                        names=["part", "n", "payload", "size"],
                    )
            del doc_ids

    return documents.select("_key", "doc_id", "text").mapInArrow(run, "part int, n long, payload binary, size long")


def _open(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Block]]:
    """(keys, doc_ids, known, block) of every packed row."""
    for n, body, size in zip(
        table["n"].to_pylist(), table["payload"].to_pylist(), table["size"].to_pylist(), strict=True
    ):
        raw = pa.decompress(body, decompressed_size=n * 32 + size, codec="zstd", asbytes=True)
        head = np.frombuffer(raw, np.int64, n * 4).reshape(4, n)
        data = np.frombuffer(raw, np.uint8, size, n * 32)
        yield head[0], head[1], head[3].astype(bool), Block(data, np.concatenate([[0], np.cumsum(head[2])]))


def _cut_contexts(texts: DataFrame, wanted: DataFrame, length: int, buckets: int) -> DataFrame:
    """Per part of documents: the wanted contexts' bytes, or window hashes of anchors with very many contexts."""

    def run(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        whole: list[tuple] = []
        windows: list[tuple] = []
        if wanted.num_rows:
            asked = []
            for n, payload in zip(wanted["n"].to_pylist(), wanted["payload"].to_pylist(), strict=True):
                h, key, first, span, pre, many = unpack(payload, n, "u8", "i8", "i8", "u1", "u1", "u1")
                asked.append([h, np.cumsum(key), np.cumsum(first), span, pre, many])
            h, key, first, span, pre, many = (np.concatenate(x) for x in zip(*asked, strict=True))
            for keys, _, _, block in _open(texts):
                order = np.argsort(keys, kind="stable")
                at = np.minimum(np.searchsorted(keys[order], key), len(keys) - 1)
                here = keys[order][at] == key
                start = np.where(here, block.starts[order[at]] + first, 0)
                i = np.flatnonzero(here & (many == 0))
                if len(i):
                    sizes = span[i].astype(np.int64) + length
                    data = block.data[np.repeat(start[i], sizes) + within(sizes)]
                    whole.append((h[i], key[i], first[i], span[i].astype(np.int64), pre[i].astype(np.int64), data))
                i = np.flatnonzero(here & (many == 1))
                if len(i):
                    windows.append(by_window(block, start[i], key[i], first[i], span[i]))
        rows: list[tuple[int, int, bytes, int]] = []
        if whole:
            h, key, first, span, pre, data = (np.concatenate(x) for x in zip(*whole, strict=True))
            sizes = span + length
            begin = np.cumsum(sizes) - sizes
            for b, i in _by((mix(h) % np.uint64(buckets)).astype(np.int64)):
                n = sizes[i]
                body = data[np.repeat(begin[i], n) + within(n)]
                rows.append((b, len(i), pack(h[i], key[i], first[i], span[i], pre[i], body), len(body)))
        if windows:
            g, key, first, word = (np.concatenate(x) for x in zip(*windows, strict=True))
            for b, i in _by((mix(g) % np.uint64(buckets)).astype(np.int64)):
                rows.append((b, len(i), pack(g[i], key[i], first[i], word[i].view(np.int64), np.full(len(i), -1)), 0))
        return pa.table(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
             pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.int64())],
            names=["bucket", "n", "payload", "size"],
        )

    def by_window(block: Block, start: np.ndarray, key: np.ndarray, first: np.ndarray, span: np.ndarray) -> tuple:
        """One entry per window: its hash for the group, another of the same bytes for the context."""
        n = span.astype(np.int64) + 1
        at = np.repeat(start, n) + within(n)
        word = np.zeros(len(at), np.uint64)
        for k in range(0, length, 8):
            piece = np.zeros(len(at), np.uint64)
            for j in range(k, min(k + 8, length)):
                piece = (piece << np.uint64(8)) | block.data[at + j]
            word = mix(word ^ piece)
        return RangeHash(block.data).of(at, at + length), np.repeat(key, n), np.repeat(first, n) + within(n), word

    return (
        texts.groupBy("part").cogroup(wanted.groupBy("part"))
        .applyInArrow(run, "bucket int, n long, payload binary, size long")
    )


def repeated_windows(
    data: np.ndarray, starts: np.ndarray, span: np.ndarray, key: np.ndarray, first: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray]:
    """(context, window) of the windows of ``length`` bytes that also start earlier, by (key, first + window)."""
    counts = span + 1
    context = np.repeat(np.arange(len(span)), counts)
    window = within(counts)
    at = starts[context] + window
    words = words_at(data, length + 16)
    order = suffix_order(data, at, length, words)
    same = common_prefix(words, order, length) >= length
    group = np.cumsum(~same)
    place = np.full(len(data) + 1, -1)
    place[at] = np.arange(len(at))
    who = place[order]
    rank = np.lexsort(((first[context] + window)[who], key[context][who], group))
    earliest = np.concatenate([[True], group[rank][1:] != group[rank][:-1]])
    later = who[rank[~earliest]]
    return context[later], window[later]


def _sort_contexts(contexts: DataFrame, length: int, parts: int) -> DataFrame:
    """Per bucket: suffixes of the contexts sorted, repeats of equal windows found."""

    def run(table: pa.Table) -> pa.Table:
        metas, bodies, hashed = [], [], []
        for n, payload, size in zip(
            table["n"].to_pylist(), table["payload"].to_pylist(), table["size"].to_pylist(), strict=True
        ):
            raw = pa.decompress(payload, decompressed_size=n * 40 + size, codec="zstd", asbytes=True)
            meta = np.frombuffer(raw, np.int64, n * 5).reshape(5, n)
            if size:
                metas.append(meta)
                bodies.append(np.frombuffer(raw, np.uint8, size, n * 40))
            else:
                hashed.append(meta)
        found = []
        if metas:
            _, key, first, span, _ = np.concatenate(metas, axis=1)
            sizes = span + length
            data = np.concatenate(bodies)
            context, window = repeated_windows(data, np.cumsum(sizes) - sizes, span, key, first, length)
            found += _covered_rows(key[context], first[context] + window, np.full(len(context), length), parts)
        if hashed:
            g, key, first, word, _ = np.concatenate(hashed, axis=1)
            order = np.lexsort((first, key, word, g))
            again = (np.diff(g[order]) == 0) & (np.diff(word[order]) == 0)
            i = order[1:][again]
            found += _covered_rows(key[i], first[i], np.full(len(i), length), parts)
        return _rows(found)

    return contexts.groupBy("bucket").applyInArrow(run, PART_SCHEMA)


def _cut_texts(texts: DataFrame, covered: DataFrame) -> DataFrame:
    """Every document with its removed spans and what is left of it."""
    schema = "_key long, doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(texts: pa.Table, covered: pa.Table) -> pa.Table:
        got = []
        for n, payload in zip(covered["n"].to_pylist(), covered["payload"].to_pylist(), strict=True):
            key, start, size = unpack(payload, n, "i8", "i8", "i8")
            got.append([np.cumsum(key), np.cumsum(start), size])
        key, start, size = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64),) * 3
        if len(key):
            order = np.lexsort((start, key))
            key, start, stop = _merge(key[order], start[order], (start + size)[order])
        else:
            stop = start
        tables = []
        for keys, doc_ids, known, block in _open(texts):
            lo, hi = np.searchsorted(key, keys), np.searchsorted(key, keys, side="right")
            raw = block.data.tobytes()
            kept = []
            for b, e, x, y in zip(block.starts[:-1].tolist(), block.starts[1:].tolist(), lo.tolist(), hi.tolist(), strict=True):
                text = raw[b:e]
                if x < y:
                    cuts = [0, *np.column_stack([start[x:y], stop[x:y]]).ravel().tolist(), len(text)]
                    text = b"".join([text[cuts[i] : cuts[i + 1]] for i in range(0, len(cuts), 2)])
                kept.append(text)
            n = hi - lo
            at = np.repeat(lo, n) + within(n)
            spans = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()),
                pa.StructArray.from_arrays([pa.array(start[at]), pa.array(stop[at])], names=["start", "end"]),
            )
            tables.append(pa.table(
                [pa.array(keys), pa.array(doc_ids, mask=~known), pa.array(block.sizes()), spans.cast(span_type),
                 pa.array(kept, pa.binary())],
                names=["_key", "doc_id", "n_bytes", "spans", "kept"],
            ))
        if not tables:
            return pa.table(
                [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), span_type, pa.binary())],
                names=["_key", "doc_id", "n_bytes", "spans", "kept"],
            )
        return pa.concat_tables(tables)

    return texts.groupBy("part").cogroup(covered.groupBy("part")).applyInArrow(run, schema).drop("_key")


def dedup_substrings(
    documents: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, together: int = SORTED_TOGETHER
) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row of ``documents`` (doc_id, text).

    ``spans`` are the maximal removed runs, as byte offsets (start, end exclusive), and ``kept`` is the
    rest of the UTF-8 bytes, which may end inside a character. Strings are judged on the input, overlaps
    count, and none crosses documents. Earlier is by (doc_id, start); rows that repeat a
    doc_id follow each other by text, and rows without a doc_id come last, so of equal rows the
    first keeps its bytes. A null text is empty, texts shorter than ``length`` lose nothing, other columns
    are left out, and an empty table gives no rows.
    """
    if not 8 <= anchor <= length or length - anchor > 250:
        raise ValueError("anchor must be 8 to length bytes, and at most 250 less than length")
    spark = documents.sparkSession
    parts = shuffle_partitions(spark)
    buckets = parts
    docs = keyed(documents)
    anchors = store(_anchors(docs, length, anchor, buckets), "anchors")
    met = store(_meet(anchors, length, parts, together), "met")
    texts = _texts_by_part(docs, parts)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Repeats found within a batch, by the part of their document."""
        for batch in batches:
            for n, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key, start, size = unpack(payload, n, "i8", "i8", "i8")
                yield from _rows(_covered_rows(np.cumsum(key), np.cumsum(start), size, parts)).to_batches()

    early = anchors.filter("bucket = -1").select("n", "payload").mapInArrow(spread, PART_SCHEMA)
    contexts = _cut_contexts(texts, met.filter(F.col("kind") == WANTED), length, buckets)
    late = _sort_contexts(contexts, length, parts)
    covered = met.filter(F.col("kind") == COVERED).unionByName(early).unionByName(late)
    return _cut_texts(texts, covered)
