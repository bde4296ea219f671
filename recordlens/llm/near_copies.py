"""Near copies: operator 9 finds pairs by SimHash, the exact Jaccard similarity of word shingles decides, and band values complete them.

1. Every text gets its SimHash fingerprint of operator 9 and the set of hashes of its shingles.
2. Fingerprints that are equal or within operator 9's radius, by its generalised pigeonhole, give the first candidates.
3. Pairs of the similarity may lie beyond that radius, so each set also gets 32 band values of five minimum hashes each. A pair
   of similarity s shares no band value with probability (1 - s^5)^32, whatever the length of the texts: 3e-6 at 0.8.
   Each text of a list of equal band values is a candidate with its neighbour in a random order of the list, which joins
   dense groups with few pairs; then all pairs of a list that are not yet in one component, by a task that holds the list's sets.
4. Of long candidates by band values, those go whose wide SimHash fingerprints are farther apart than sets of that similarity
   ever are, short of a chance below 1e-6; no sets are shipped for them.
5. Every other pair is decided by its two whole sets. Pairs from the similarity on become components.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, comb, pi

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.llm.common import (
    BASE, Block, RangeHash, block_of, freed, mix, shuffle_partitions, space_words, store, text_slices, window_hashes, within,
)
from recordlens.llm.components import components
from recordlens.llm.simhash import fingerprint, near_links

BANDS, ROWS = 32, 5
# Members of a list, and hashes of their sets, that one task compares with each other; longer lists are cut into pairs of parts.
LIST_PART, LIST_HASHES = 16_384, 2 << 20
# Bits of a SimHash fingerprint, and the size from which sets are told apart by it.
SIM_BITS, SIM_LEAST = 256, 64
# A chance that a pair of the similarity has more differing bits than allowed.
SIM_MISS = 1e-6

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Constants of the minimum hashes, by a rule.
_FLIP = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(BASE))
_TIMES = mix(_FLIP ^ np.uint64(BASE)) | np.uint64(1)
_PLACE = np.array([pow(BASE, j + 1, 1 << 64) for j in range(ROWS)], np.uint64)


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct shingle hashes of text i, sorted, are ``hashes[bounds[i]:bounds[i + 1]]``.

    Words are parted by ASCII white space, A-Z count as a-z. A text of fewer words is one shingle, one without words has none.
    """
    block = block_of(texts)
    block = Block(_LOWER[block.data], block.starts)
    begin, end = space_words(block)
    text = np.searchsorted(block.starts, begin, side="right") - 1
    first, hashes = window_hashes(RangeHash(block.data).of(begin, end), text, shingle)
    text = text[first]
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    text, hashes = text[new], hashes[new]
    return hashes, np.searchsorted(text, np.arange(len(texts) + 1))


def bands(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of band values for every set that is not empty."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.zeros((len(starts), BANDS), np.uint64)
    if len(starts):
        for b in range(BANDS):
            for j in range(ROWS):
                k = b * ROWS + j
                out[:, b] += np.minimum.reduceat((hashes ^ _FLIP[k]) * _TIMES[k], starts) * _PLACE[j]
        out = mix(out + np.arange(BANDS, dtype=np.uint64) * np.uint64(BASE))
    return out


def simhashes(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of SIM_BITS bits, in 64-bit numbers, for every set: a bit is 1 if more than half of the hashes have it."""
    sizes = np.diff(bounds)
    full = np.flatnonzero(sizes)
    out = np.zeros((len(sizes), SIM_BITS // 64), np.uint64)
    for k in range(SIM_BITS // 64 if len(full) else 0):
        bits = np.unpackbits(mix(hashes ^ _FLIP[k]).view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, bounds[:-1][full], axis=0, dtype=np.int32)
        out[full, k] = np.packbits(ones * 2 > sizes[full, None], axis=1).view(np.uint64).ravel()
    return out


def most_differing(similarity: float) -> int:
    """The bits in which fingerprints of two sets of that similarity differ at most, but for a chance of SIM_MISS.

    Sets of Jaccard similarity s meet at an angle whose cosine is 2s / (1 + s), or more if their sizes differ; a bit
    differs with the share of the angle in half a turn.
    """
    p = acos(2 * similarity / (1 + similarity)) / pi
    most, above = SIM_BITS, 0.0
    while most and above + comb(SIM_BITS, most) * p**most * (1 - p) ** (SIM_BITS - most) < SIM_MISS:
        above += comb(SIM_BITS, most) * p**most * (1 - p) ** (SIM_BITS - most)
        most -= 1
    return most


def _numbers(sims: pa.Array | list) -> np.ndarray:
    raw = sims if isinstance(sims, list) else sims.to_pylist()
    return np.frombuffer(b"".join(raw), np.uint64).reshape(len(raw), SIM_BITS // 64)


def _named(hashes: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    return [xxhash.xxh3_128_digest(hashes[a:b].tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _sets(texts: DataFrame, shingle: int, banded: bool) -> DataFrame:
    """The set of each text: its name ``fp`` and either its size, band values and the text's ``print`` of operator 9, or its wide fingerprint and hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                hashes, bounds = shingle_sets(part.column("text"), shingle)
                fp = pa.array(_named(hashes, bounds), pa.binary())
                if banded:
                    rows = iter(bands(hashes, bounds))
                    sizes = np.diff(bounds)
                    keys = [next(rows).tobytes() if n else None for n in sizes.tolist()]
                    prints = [fingerprint(t) for t in pc.fill_null(part.column("text"), "").cast(pa.binary()).to_pylist()]
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("doc_id"), part.column("seal"), fp, pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                            pa.array(prints, pa.binary()),
                        ],
                        names=["doc_id", "seal", "fp", "n", "keys", "print"],
                    )
                else:
                    grams = [hashes[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                    sims = [s.tobytes() for s in simhashes(hashes, bounds)]
                    yield pa.RecordBatch.from_arrays(
                        [fp, pa.array(sims, pa.binary()), pa.array(grams, pa.binary())], names=["fp", "sim", "grams"]
                    )

    return texts.mapInArrow(
        freed(run),
        "doc_id long, seal long, fp binary, n long, keys binary, print binary" if banded else "fp binary, sim binary, grams binary",
    )


def _by_fingerprint(rows: DataFrame) -> DataFrame:
    """(a, b): sets of texts whose fingerprints are equal or linked by operator 9, as pairs of one set per fingerprint.

    The links are enough to join all fingerprints that the radius joins, so pairs grow with the texts.
    """
    prints = store(rows.groupBy(F.col("print").alias("fp")).agg(F.min("fp").alias("of")), "near-prints")
    left, right = (prints.select(F.col("fp").alias(c), F.col("of").alias(f"of_{c}")) for c in "ab")
    linked = near_links(prints.select("fp")).join(left, "a").join(right, "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    # Sets of texts with one fingerprint, as shingles that repeat or move leave it as it is.
    equal = rows.select("print", "fp").distinct().join(prints.select(F.col("fp").alias("print"), "of"), "print")
    pairs = linked.unionByName(equal.select(F.col("fp").alias("a"), F.col("of").alias("b")))
    return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _listed(distinct: DataFrame) -> DataFrame:
    """(key, fp, n): every set under each of its band values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                keys = np.frombuffer(b"".join(part.column("keys").to_pylist()), np.int64)
                at = pa.array(np.repeat(np.arange(part.num_rows), BANDS))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), part.column("fp").take(at), part.column("n").take(at)], names=["key", "fp", "n"]
                )

    return distinct.filter("keys is not null").select("fp", "n", "keys").mapInArrow(run, "key long, fp binary, n long")


def _neighbours(listed: DataFrame, most: int) -> DataFrame:
    """(a, b): each member of a list with the next one of a random order; links across partitions are left to :func:`_across`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if last is None else [last, batch])
            last = batch.slice(max(batch.num_rows - 1, 0))
            key, n, fp = np.asarray(table["key"]), np.asarray(table["n"]), table["fp"].to_pylist()
            sims = _numbers(table["sim"].to_pylist())
            near = (key[1:] == key[:-1]) & (
                (np.minimum(n[1:], n[:-1]) < SIM_LEAST) | (np.bitwise_count(sims[1:] ^ sims[:-1]).sum(axis=1) <= most)
            )
            pairs = [(fp[i], fp[i + 1]) for i in np.flatnonzero(near).tolist()]
            found = [(min(p), max(p)) for p in pairs if p[0] != p[1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], names=["a", "b"]
            )

    order = ["key", F.xxhash64("fp", "key")]
    near = listed.repartitionByRange(shuffle_partitions(listed.sparkSession), *order).sortWithinPartitions(*order)
    return near.select("key", "fp", "n", "sim").mapInArrow(freed(run), "a binary, b binary").distinct()


def _across(listed: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between members of a list that are not yet in one component; a tree of them per list.

    A task holds the sets of a list, or of two parts of a longer one, and decides its pairs itself, so rows grow
    with the members and not with their pairs. A pair of several lists is decided in the first of them.
    """
    most = most_differing(similarity)
    known = roots.select(F.col("node").alias("fp"), "root")
    rows = listed.join(known, "fp", "left").select("key", "fp", "n", "sim", "keys", F.coalesce("root", "fp").alias("root"))
    rows = store(rows, "near-rooted")
    mixed = rows.groupBy("key").agg(
        F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("hashes")
    ).filter("x <> y")
    parts = F.greatest(F.ceil(F.col("m") / LIST_PART), F.ceil(F.col("hashes") / LIST_HASHES))
    rows = rows.join(mixed.select("key", parts.cast("int").alias("parts")), "key")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    together = (
        rows.join(sets.select("fp", "grams"), "fp").select(
            "key", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"),
            (F.col("own") > F.col("other")).cast("int").alias("side"), "fp", "n", "sim", "keys", "root", "grams",
        )
        .repartition(shuffle_partitions(listed.sparkSession), "key", "left", "right")
        .sortWithinPartitions("key", "left", "right", "n")
    )

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, held = None, []
        for batch in batches:
            for *group, side, fp, n, sim, keys, root, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != now:
                    if len(held) > 1:
                        yield now, held
                    now, held = group, []
                held.append((side, fp, n, sim, keys, root, grams))
        if len(held) > 1:
            yield now, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, left, right), held in lists(batches):
            sides, fps, sizes, sims, keys, roots, grams = zip(*held, strict=True)
            found = links_in_list(
                np.array(sides) if left != right else None, np.array(sizes, np.int64), _numbers(list(sims)),
                np.frombuffer(b"".join(keys), np.int64).reshape(len(held), BANDS), key, np.unique(np.array(roots, object), return_inverse=True)[1],
                [np.frombuffer(g, np.uint64) for g in grams], similarity, most,
            )
            if found:
                pairs = [(min(fps[i], fps[j]), max(fps[i], fps[j])) for i, j in found]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*pairs, strict=True)], names=["a", "b"])

    return together.mapInArrow(freed(run), "a binary, b binary").distinct()


def links_in_list(
    side: np.ndarray | None, n: np.ndarray, sims: np.ndarray, keys: np.ndarray, key: int, root: np.ndarray,
    grams: list[np.ndarray], similarity: float, most: int,
) -> list[tuple[int, int]]:
    """Pairs of members of one list, sorted by size, that are alike and join two components each; exact.

    One sorted index of all hashes of the list gives what a member shares with every other at once.
    """
    together = np.concatenate(grams)
    owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    order = np.argsort(together, kind="stable")
    together, owner = together[order], owner[order]
    band = (keys == key).argmax(axis=1)
    # Partners of a set end where sizes outgrow it.
    far = np.searchsorted(n * similarity, n + 1e-9, side="right")
    component = root.copy()
    out = []
    for i in range(len(n)):
        j = np.arange(i + 1, far[i])
        j = j[(component[j] != component[i]) & ((side[j] != side[i]) if side is not None else True)]
        if len(j) and n[i] >= SIM_LEAST:
            j = j[np.bitwise_count(sims[j] ^ sims[i]).sum(axis=1) <= most]
        if len(j) and band[i]:
            j = j[~(keys[j, : band[i]] == keys[i, : band[i]]).any(axis=1)]
        if not len(j):
            continue
        lo, hi = np.searchsorted(together, grams[i]), np.searchsorted(together, grams[i], side="right")
        shared = np.bincount(owner[np.repeat(lo, hi - lo) + within(hi - lo)], minlength=len(n))[j]
        # Of whole numbers, with room for the rounding of the similarity.
        for k in j[shared >= similarity * (n[i] + n[j] - shared) - 1e-9].tolist():
            if component[k] != component[i]:
                out.append((i, k))
                component[component == component[k]] = component[i]
    return out


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column("x"), batch.column("y")
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(xs[i].as_buffer(), np.uint64), np.frombuffer(ys[i].as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                # Of whole numbers, with room for the rounding of the similarity.
                keep[i] = shared >= similarity * (len(both) - shared) - 1e-9
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], names=["a", "b"])

    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("grams").alias("x")), "a")
    both = both.join(sets.select(F.col("fp").alias("b"), F.col("grams").alias("y")), "b")
    # A row holds two whole sets; the engine bounds the bytes of a batch.
    return both.select("a", "b", "x", "y").mapInArrow(freed(run), "a binary, b binary")


def near_copies(documents: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(doc_id, seal, fp, component_id) of every row of ``documents`` (doc_id, text; other columns are left out).

    ``seal`` is the XXH64 value of the text, ``fp`` names its set of shingles. ``component_id`` is the least doc_id that
    pairs of at least the similarity reach, itself included. Null texts and texts without words are alike. Repeated
    doc_ids each keep a row. Rows without a doc_id take part; if all of a component's are null, its id is null.
    """
    plain = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    plain = plain.withColumn("seal", F.xxhash64("text"))
    rows = store(_sets(plain, shingle, banded=True), "near-sets")
    distinct = rows.groupBy("fp").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "seal")).alias("one"), F.first("n").alias("n"), F.first("keys").alias("keys")
    )
    distinct = store(distinct, "near-distinct")
    listed = _listed(distinct)
    crowded = listed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("key")
    listed = store(listed.join(crowded, "key"), "near-crowded")
    pairs = store(_by_fingerprint(rows), "near-pairs")
    met = listed.select("fp").unionByName(pairs.select(F.col("a").alias("fp"))).unionByName(pairs.select(F.col("b").alias("fp")))
    wanted = distinct.join(met.distinct(), "fp", "left_semi").select("one.*")
    texts = plain.join(
        wanted.select(F.col("doc_id").alias("_id"), F.col("seal").alias("_seal")),
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("seal") == F.col("_seal")), "left_semi",
    )
    sets = _sets(texts.select("text"), shingle, banded=False).groupBy("fp").agg(F.first("sim").alias("sim"), F.first("grams").alias("grams"))
    sets = store(sets, "near-grams")
    listed = store(listed.join(sets.select("fp", "sim"), "fp").join(distinct.select("fp", "keys"), "fp"), "near-listed")
    first = store(pairs.unionByName(_neighbours(listed, most_differing(similarity))).distinct(), "near-first")
    links = store(_verified(first, sets, similarity), "near-links")
    roots = components(links)
    more = store(_across(listed, roots, sets, similarity), "near-more")
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    roots = store(roots, "near-roots")
    ids = (
        distinct.join(roots, distinct["fp"] == roots["node"], "left")
        .select("fp", "least", F.coalesce("root", "fp").alias("root"))
    )
    best = ids.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(ids.join(best, "root").select("fp", "component_id"), "fp").select("doc_id", "seal", "fp", "component_id")


def keep_first(documents: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The rows of ``documents`` whose doc_id is that of their component; one doc_id per component.

    All columns are kept. Of rows that repeat a doc_id only those go whose own text is a copy. Rows without a doc_id stay.
    """
    found = near_copies(documents, shingle, similarity)
    gone = found.filter("doc_id is not null and doc_id <> component_id")
    gone = gone.select(F.col("doc_id").alias("_gone"), F.col("seal").alias("_seal")).distinct()
    same = (documents["doc_id"].cast("long") == gone["_gone"]) & (F.xxhash64(documents["text"].cast("string")) == gone["_seal"])
    return documents.join(gone, same, "left_anti")
