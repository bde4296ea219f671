"""Benchmark passages in documents, by SimHash over windows as long as the items.

Windows of a document that share a word shingle with some item get a fingerprint; all others have a
similarity of nothing. A table per block of bits lists the items whose block is within
radius // blocks bits, so every item within the radius is found in some block. Pairs within the
radius are checked by the weighted Jaccard similarity of their shingles, each weighted by
how often it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.llm.common import RangeHash, block_of, plain_words, text_slices, window_hashes, within

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BITS = 64
# At a similarity of 0.8, 64-bit fingerprints of equally long windows differ in 9.7 +- 2.9 bits; this is 5 deviations more.
RADIUS = 24
BLOCKS = 8
# Items sent to the executors at a time; more are taken in further passes.
ITEMS_AT_ONCE = 20_000
ITEM_BYTES_AT_ONCE = 64 << 20

FOUND_SCHEMA = "doc_id long, item_id long, start long, end long, words long, distance int, similarity double"


def words_of(texts: pa.Array):
    """Words' hash, text, start and end, lower-cased, and the block; null counts as empty."""
    block = block_of(pc.utf8_lower(pc.fill_null(texts, "")))
    starts, ends = plain_words(block)
    text = np.searchsorted(block.starts, starts, side="right") - 1
    return RangeHash(block.data).of(starts, ends), text, starts, ends, block


def simhash(bits: np.ndarray) -> np.ndarray:
    """Sums of +1 and -1 per bit to fingerprints: 1 where more than half of the shingles have it."""
    packed = np.packbits((bits > 0).astype(np.uint8), axis=1, bitorder="little")
    return packed.view(np.uint64).ravel()


def signs(h: np.ndarray) -> np.ndarray:
    raw = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return raw.astype(np.int32) * 2 - 1


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two multisets of shingles: the sum of the lesser counts over the sum of the greater ones."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    least = int(np.minimum(n[i], m[j]).sum())
    return least / (len(a) + len(b) - least)


@dataclass
class Items:
    """Items with at least one word: ids, lengths, shingles, fingerprints, and the block tables."""

    ids: np.ndarray
    words: np.ndarray
    shingles: list[np.ndarray]
    fingerprints: np.ndarray
    known: np.ndarray
    owners: list[np.ndarray]
    shingle: int

    @classmethod
    def of(cls, ids: list[int], texts: list[str], k: int) -> Items:
        word, text, *_ = words_of(pa.array(texts, pa.string()))
        first, h = window_hashes(word, text, k)
        words = np.bincount(text, minlength=len(ids))
        owner = text[first] if len(first) else np.zeros(0, np.int64)
        keep = np.flatnonzero(words)
        parts = [h[owner == i] for i in keep]
        prints = np.array([simhash(signs(p).sum(axis=0)[None, :])[0] for p in parts], np.uint64)
        # Items of fewer words than a shingle are looked up as a whole.
        number = np.searchsorted(keep, owner)
        long = words[keep][number] >= k
        number, h = number[long], h[long]
        order = np.lexsort((number, h))
        known, begin = np.unique(h[order], return_index=True)
        owners = [np.unique(x) for x in np.split(number[order], begin[1:])] if len(known) else []
        return cls(np.array(ids, np.int64)[keep], words[keep], parts, prints, known, owners, k)

    def short(self) -> dict[int, dict[int, list[int]]]:
        """By number of words: the items of a single short shingle by its hash."""
        out: dict[int, dict[int, list[int]]] = {}
        for i in np.flatnonzero(self.words < self.shingle):
            out.setdefault(int(self.words[i]), {}).setdefault(int(self.shingles[i][0]), []).append(int(i))
        return out

    def tables(self, radius: int, blocks: int) -> list[tuple[int, int, list[np.ndarray]]]:
        """Per block: shift, width, and by value the items within ``radius // blocks`` bits of it."""
        out = []
        edges = np.linspace(0, BITS, blocks + 1).astype(int)
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            width = int(hi - lo)
            mask = np.uint64((1 << width) - 1)
            own = (self.fingerprints >> np.uint64(lo)) & mask
            values = np.arange(1 << width, dtype=np.uint64)
            near = np.bitwise_count(values[:, None] ^ own[None, :]) <= radius // blocks
            out.append((int(lo), width, [np.flatnonzero(row) for row in near]))
        return out


def find_in(
    texts: pa.Array, items: Items, tables: list, bitmap: np.ndarray, k: int, radius: int, similarity: float
) -> Iterator[tuple]:
    """(text, item, start byte, end byte, words, distance, similarity): the best window of each text and item."""
    word, text, starts, ends, block = words_of(texts)
    for n, wanted in items.short().items():
        first, h = window_hashes(word, text, n)
        seen = set()
        for j in np.flatnonzero(np.isin(h, np.array(list(wanted), np.uint64))):
            a, t = int(first[j]), int(text[first[j]])
            base = int(block.starts[t])
            for i in wanted[int(h[j])]:
                if (t, i) not in seen:
                    seen.add((t, i))
                    yield t, int(items.ids[i]), int(starts[a]) - base, int(ends[a + n - 1]) - base, n, 0, 1.0
    first, h = window_hashes(word, text, k)
    if not len(h) or not len(items.known):
        return
    hit = np.flatnonzero(bitmap[(h >> np.uint64(44)).astype(np.int64)])
    at = np.minimum(np.searchsorted(items.known, h[hit]), len(items.known) - 1)
    ok = items.known[at] == h[hit]
    hit, at = hit[ok], at[ok]
    owner = text[first]
    for t in np.unique(owner[hit]):
        mine = hit[owner[hit] == t]
        lo, hi = np.searchsorted(owner, t), np.searchsorted(owner, t, side="right")
        own = h[lo:hi]
        n_words = int(np.searchsorted(text, t, side="right") - np.searchsorted(text, t))
        word0 = int(np.searchsorted(text, t))
        lengths = np.unique(items.words[np.unique(np.concatenate([items.owners[x] for x in at[owner[hit] == t]]))])
        sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(signs(own), axis=0, dtype=np.int32)])
        best: dict[int, tuple] = {}
        for length in lengths.tolist():
            size = max(1, min(length, n_words) - k + 1)
            last = len(own) - size
            # All windows of this length that hold a shingle of some item.
            begin = np.clip(mine - lo - size + 1, 0, last)
            stop = np.minimum(mine - lo, last)
            counts = stop - begin + 1
            window = np.unique(np.repeat(begin, counts) + within(counts))
            prints = simhash(sums[window + size] - sums[window])
            pairs = []
            for shift, width, table in tables:
                value = ((prints >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
                for v in np.unique(value):
                    who = table[v][items.words[table[v]] == length]
                    if len(who):
                        w = np.flatnonzero(value == v)
                        pairs.append(np.column_stack([np.repeat(w, len(who)), np.tile(who, len(w))]))
            if not pairs:
                continue
            pairs = np.unique(np.concatenate(pairs), axis=0)
            distance = np.bitwise_count(prints[pairs[:, 0]] ^ items.fingerprints[pairs[:, 1]])
            for (w, i), d in zip(pairs[distance <= radius].tolist(), distance[distance <= radius].tolist(), strict=True):
                a = int(window[w])
                score = weighted_jaccard(own[a : a + size], items.shingles[i])
                if score >= similarity and (i not in best or (-score, a) < best[i][:2]):
                    z = min(a + length, n_words)
                    best[i] = (-score, a, word0 + a, word0 + z, z - a, d)
        for i, (score, _, a, z, n, d) in sorted(best.items()):
            base = int(block.starts[t])
            yield int(t), int(items.ids[i]), int(starts[a]) - base, int(ends[z - 1]) - base, n, d, -score


def find_items(
    documents: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE_WORDS, similarity: float = SIMILARITY,
    radius: int = RADIUS, blocks: int = BLOCKS,
) -> DataFrame:
    """Benchmark items (item_id, text) in documents (doc_id, text): a row per document row and item.

    (doc_id, item_id, start, end, words, distance, similarity): the best window of the item's number of
    words, as byte offsets into the lower-cased text, with the Hamming distance of the fingerprints and
    the weighted similarity of ``shingle``-word shingles, at least ``similarity``; of equal ones the
    first. Words are ASCII letters and digits and all characters beyond ASCII, without case. Items shorter than a
    shingle are one shingle. Null or empty texts match nothing. Rows that repeat a doc_id or
    item_id give a row each; a null id stays null. Other columns are left out.

    The items are the stated query set: they go to the executors in blocks of bounded number and size, one
    pass over the documents for each.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = benchmark.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = spark.createDataFrame([], FOUND_SCHEMA)
    for ids, texts in _item_blocks(wanted):
        out = out.unionByName(_one_pass(rows, ids, texts, shingle, similarity, radius, blocks))
    return out


def _item_blocks(wanted: DataFrame) -> Iterator[tuple[list, list[str]]]:
    ids: list = []
    texts: list[str] = []
    size = 0
    for r in wanted.toLocalIterator():
        if ids and (len(ids) >= ITEMS_AT_ONCE or size + len(r["text"]) > ITEM_BYTES_AT_ONCE):
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += len(r["text"])
    if ids:
        yield ids, texts


def _one_pass(rows: DataFrame, ids: list, texts: list[str], k: int, similarity: float, radius: int, blocks: int) -> DataFrame:
    shipped = rows.sparkSession.sparkContext.broadcast(Items.of(list(range(len(ids))), texts, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shipped.value
        tables = items.tables(radius, blocks)
        bitmap = np.zeros(1 << 20, bool)
        bitmap[(items.known >> np.uint64(44)).astype(np.int64)] = True
        for batch in batches:
            for part in text_slices(batch):
                found = list(find_in(part.column("text"), items, tables, bitmap, k, radius, similarity))
                if found:
                    t, i, start, end, words, d, score = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(t)), pa.array([ids[x] for x in i], pa.int64()),
                         pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(words, pa.int64()),
                         pa.array(d, pa.int32()), pa.array(score, pa.float64())],
                        names=["doc_id", "item_id", "start", "end", "words", "distance", "similarity"],
                    )

    return rows.mapInArrow(run, FOUND_SCHEMA)


def keep_clean(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``documents`` with no benchmark item in them, all columns kept.

    Rows that repeat the doc_id of a match go with it; rows without a doc_id stay.
    """
    hit = find_items(documents, benchmark, **options).select(F.col("doc_id").alias("_hit")).distinct()
    return documents.join(hit, documents["doc_id"].cast("long") == hit["_hit"], "left_anti")
