"""SimHash near-duplicates by generalised pigeonhole: exact within the Hamming radius.

1. Every text gets a fingerprint of its word shingles, of 64 bits or a multiple.
2. The distinct fingerprints' bits are put into groups of correlated bits.
3. Every group gets a threshold of its own. If the thresholds of m groups add up to
   radius - m + 1, two fingerprints within the radius are within the threshold in at least one
   group. Dynamic programming picks the thresholds that cost least, by the number of
   candidates counted for each group over all fingerprints.
4. A fingerprint is listed under its value in each group and probes the larger values within
   the threshold. Members of a list that are within the radius are linked.
5. Links become components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.llm.common import shuffle_partitions, store, text_slices, within
from recordlens.llm.components import components

BITS = 64
SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4

# Costs of a listed or probed value, which is shuffled and sorted, and of a compared pair, in like units.
SIGNATURE_COST, PAIR_COST = 1000.0, 1.0
# Members of a list that one task compares with each other; longer lists are cut into pairs of parts.
LIST_PART = 16_384


def fingerprint(text: bytes, shingle: int = SHINGLE_WORDS, seed: int = SEED, bits: int = BITS) -> bytes:
    """A bit is 1 if more than half of the shingles' XXH64 values have it; no words give 0.

    Big-endian bytes. Every further 64 bits come from XXH64 with the next seed.
    """
    words = text.lower().split()  # bytes: A-Z only, and the six white-space bytes
    if not words:
        return bytes(bits // 8)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return b"".join(xxhash.xxh64_digest(joined, seed + k) for k in range(bits // 64))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-shingle] + 1])
    digest = xxhash.xxh64_digest
    pieces = [joined[a:b] for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    out = b""
    for k in range(bits // 64):
        raw = b"".join([digest(x, seed + k) for x in pieces])
        ones = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        out += np.packbits(ones * 2 > len(starts)).tobytes()
    return out


def fingerprints(documents: DataFrame, shingle: int = SHINGLE_WORDS, seed: int = SEED, bits: int = BITS) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text, in big-endian bytes. A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                known: dict[bytes, bytes] = {}
                out = []
                for t in pc.fill_null(part.column("text"), "").cast(pa.binary()).to_pylist():
                    if t not in known:
                        known[t] = fingerprint(t, shingle, seed, bits)
                    out.append(known[t])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, fp binary"
    )


def _numbers(column: pa.Array) -> np.ndarray:
    """Fingerprints as rows of 64-bit numbers, the last of which has the lowest bits."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, ">u8").astype(np.uint64).reshape(len(column), -1)


def _bytes(fp: np.ndarray) -> pa.Array:
    width = fp.shape[1] * 8
    raw = fp.astype(">u8").tobytes()
    return pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.binary())


def _joint_bits(fps: DataFrame, bits: int) -> np.ndarray:
    """For every two bits, the number of fingerprints that have both; one row per pair of bits from every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((bits, bits), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                fp = _numbers(batch.column(0).slice(lo, 4096))
                ones = np.stack([_values(fp, [b]) for b in range(bits)], axis=1).astype(np.float64)
                total += (ones.T @ ones).astype(np.int64)
        if total.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(bits * bits)), pa.array(total.ravel())], names=["pair", "n"]
            )

    # bits * bits rows come to the driver.
    rows = fps.select("fp").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(bits * bits)
    for r in rows:
        out[r["pair"]] = r["n"]
    return out.reshape(bits, bits)


def group_bits(joint: np.ndarray, n: int, m: int) -> list[list[int]]:
    """``m`` groups of like size; each is filled with the bits most correlated with what it has."""
    p = np.diag(joint) / max(n, 1)
    cov = joint / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    bits = len(joint)
    left = set(range(bits))
    groups = []
    for g in range(m):
        size = bits // m + (g < bits % m)
        group = [max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())]
        left.remove(group[0])
        while len(group) < size:
            best = max(sorted(left), key=lambda b: corr[b, group].sum())
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def ball(width: int, t: int) -> int:
    """Values within ``t`` bits."""
    return sum(comb(width, j) for j in range(t + 1))


def choose_groups(n: int, radius: int, bits: int = BITS, most: int = 24) -> int:
    """How many groups cost least for ``n`` evenly spread fingerprints."""

    def cost(m: int) -> float:
        width, total = bits // m, radius - m + 1
        ts = [total // m + (i < total % m) for i in range(m)]
        return sum(n * ball(width, t) * (SIGNATURE_COST + PAIR_COST * n / 2.0**width) for t in ts if t >= 0)

    return min(range(2, min(most, radius + 1) + 1), key=cost) if radius else 1


def allocate(costs: list[list[float]], total: int) -> list[int]:
    """Thresholds t_i >= -1 that add up to ``total`` at the least cost; ``costs[i][t + 1]`` is that of t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        now: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for k, more in enumerate(row):
                key, value = s + k - 1, c + more
                if key not in now or value < now[key][0]:
                    now[key] = (value, [*ts, k - 1])
        best = now
    return best[total][1]


def _values(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bits of a group as a number; bit 0 is the lowest."""
    out = np.zeros(len(fp), np.uint64)
    last = fp.shape[1] - 1
    for k, b in enumerate(bits):
        out |= ((fp[:, last - b // 64] >> np.uint64(b % 64)) & np.uint64(1)) << np.uint64(k)
    return out


def _listed(fps: DataFrame, groups: list[list[int]]) -> DataFrame:
    """(key, n): how many fingerprints have a value in a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = _numbers(batch.column(0))
            keys = [_values(fp, g) | np.uint64(i << 56) for i, g in enumerate(groups)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64))], names=["key"])

    return fps.select("fp").mapInArrow(run, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def _signatures(fps: DataFrame, groups: list[list[int]], thresholds: list[int]) -> DataFrame:
    """(key, fp, probe): a listed value of every group in use, and the larger values within its threshold.

    Of two unequal values within the threshold the smaller one's fingerprint probes, so each pair meets once.
    """
    masks = [
        np.array(
            [sum(1 << b for b in c) for j in range(1, t + 1) for c in combinations(range(len(g)), j)], np.uint64
        )
        for g, t in zip(groups, thresholds, strict=True)
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                fp = _numbers(batch.column(0).slice(lo, 4096))
                keys, who, probe = [], [], []
                for i, (g, t) in enumerate(zip(groups, thresholds, strict=True)):
                    if t < 0:
                        continue
                    own = _values(fp, g)
                    keys.append(own | np.uint64(i << 56))
                    who.append(fp)
                    probe.append(np.zeros(len(fp), bool))
                    if len(masks[i]):
                        other = own[:, None] ^ masks[i][None, :]
                        at, which = np.nonzero(other > own[:, None])
                        keys.append(other[at, which] | np.uint64(i << 56))
                        who.append(fp[at])
                        probe.append(np.ones(len(at), bool))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(keys).view(np.int64)), _bytes(np.concatenate(who)),
                        pa.array(np.concatenate(probe)),
                    ],
                    names=["key", "fp", "probe"],
                )

    return fps.select("fp").mapInArrow(run, "key long, fp binary, probe boolean")


class _Forest:
    """Union-find over the fingerprints of one task; only edges that join two trees go out."""

    def __init__(self):
        self.up: dict[bytes, bytes] = {}

    def root(self, x: bytes) -> bytes:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> list[tuple[bytes, bytes]]:
        out = []
        for x, y in zip(_bytes(a).to_pylist(), _bytes(b).to_pylist(), strict=True):
            r, s = self.root(x), self.root(y)
            if r != s:
                self.up[max(r, s)] = min(r, s)
                out.append((x, y))
        return out


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Whether fingerprints, their words on the last axis, are within the radius."""
    out = np.bitwise_count(a[..., 0] ^ b[..., 0])
    for k in range(1, a.shape[-1]):
        out = out + np.bitwise_count(a[..., k] ^ b[..., k])
    return out <= radius


def _links(listed: DataFrame, radius: int) -> DataFrame:
    """(a, b): links among the rows of each (key, left, right), which lie together and sorted.

    ``side`` is 0 for members of the left part and 1 for those of the right one; within a part
    all are compared, between parts each with each. Two probes need not be compared.
    """

    def compare(fp: np.ndarray, probe: np.ndarray, side: np.ndarray, split: bool):
        # Members come before probes, so a member meets what follows it.
        rows = np.flatnonzero(side == 0) if split else np.flatnonzero(~probe)
        cols = np.flatnonzero(side == 1) if split else np.arange(len(fp))
        step = max(1, 500_000 // max(len(cols), 1))
        for lo in range(0, len(rows), step):
            x = rows[lo : lo + step]
            ok = _near(fp[x][:, None], fp[cols][None, :], radius)
            ok &= ~(probe[x][:, None] & probe[cols][None, :]) if split else x[:, None] < cols[None, :]
            i, j = np.nonzero(ok)
            yield fp[x[i]], fp[cols[j]]

    def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        """Sorted columns that hold whole groups only."""
        rest = None
        for batch in batches:
            got = [_numbers(batch.column(i)) if i == 1 else np.asarray(batch.column(i)) for i in range(5)]
            if rest is not None:
                got = [np.concatenate([a, b]) for a, b in zip(rest, got, strict=True)]
            same = (got[0] == got[0][-1]) & (got[3] == got[3][-1]) & (got[4] == got[4][-1])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            rest = [g[cut:] for g in got]
            if cut:
                yield tuple(g[:cut] for g in got)
        if rest is not None and len(rest[0]):
            yield tuple(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        for key, fp, flags, left, right in groups_of(b for b in batches if b.num_rows):
            probe, side = (flags & 1).astype(bool), flags >> 1
            new = np.flatnonzero(
                np.concatenate([[True], (key[1:] != key[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
            )
            sizes = np.diff(np.concatenate([new, [len(key)]]))
            found: list[tuple[bytes, bytes]] = []
            small = np.repeat((sizes <= 64) & (left[new] == right[new]), sizes)
            gid = np.repeat(np.arange(len(new)), sizes)
            for shift in range(1, int(min(64, sizes.max(initial=1)))):
                i = np.flatnonzero(small[:-shift] & (gid[:-shift] == gid[shift:]))
                if not len(i):
                    break
                i = i[~(probe[i] & probe[i + shift])]
                i = i[_near(fp[i], fp[i + shift], radius)]
                found += forest.join(fp[i], fp[i + shift])
            for g in np.flatnonzero((sizes > 64) | (left[new] != right[new])):
                s = slice(new[g], new[g] + sizes[g])
                split = bool(left[new[g]] != right[new[g]])
                for a, b in compare(fp[s], probe[s], side[s], split):
                    found += forest.join(a, b)
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return listed.mapInArrow(run, "a binary, b binary")


def near_links(fps: DataFrame, radius: int = RADIUS, bits: int = BITS) -> DataFrame:
    """(a, b) among distinct fingerprints ``fp``: enough links within ``radius`` to join all that are linked.

    No link between different components' members exists beyond these; pairs already joined
    within a task are left out, so a dense group gives a tree and not all its pairs.
    """
    spark = fps.sparkSession
    n = max(fps.count(), 1)  # an empty table costs something too, or any thresholds would do
    m = choose_groups(n, radius, bits)
    groups = group_bits(_joint_bits(fps, bits), n, m)
    listed = store(_listed(fps, groups), "listed")
    pairs = {
        r["g"]: float(r["s"])
        for r in listed.groupBy(F.shiftright("key", 56).alias("g"))
        .agg(F.sum(F.col("n").cast("decimal(20,0)") * F.col("n")).alias("s"))
        .collect()  # a row per group of bits
    }
    total = radius - m + 1
    costs = [
        [0.0]
        + [
            ball(len(g), t) * (SIGNATURE_COST * n + PAIR_COST * pairs.get(i, 0.0))
            for t in range(0, min(radius, len(g)) + 1)
        ]
        for i, g in enumerate(groups)
    ]
    thresholds = allocate(costs, total)
    rows = _signatures(fps, groups, thresholds)
    long = listed.filter(F.col("n") > LIST_PART)
    if long.isEmpty():
        rows = rows.withColumns({"left": F.lit(0), "right": F.lit(0), "side": F.lit(0)})
    else:
        # A long list is cut into parts by a hash, and every two parts meet in a group of their own.
        parts = long.select("key", F.ceil(F.col("n") / LIST_PART).cast("int").alias("parts"))
        own = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int")
        rows = rows.join(parts, "key", "left").withColumn("own", own)
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        rows = rows.withColumns(
            {
                "left": F.least("own", "other"), "right": F.greatest("own", "other"),
                "side": (F.col("own") > F.col("other")).cast("int"),
            }
        )
    flags = (F.col("probe").cast("int") + F.col("side") * 2).alias("flags")
    together = (
        rows.select("key", "fp", flags, "left", "right")
        .repartition(shuffle_partitions(spark), "key", "left", "right")
        .sortWithinPartitions("key", "left", "right", "flags", "fp")
    )
    return _links(together, radius)


def near_duplicates(
    documents: DataFrame, shingle: int = SHINGLE_WORDS, radius: int = RADIUS, seed: int = SEED, bits: int = BITS
) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``documents`` (doc_id, text; other columns are left out).

    ``component_id`` is the least doc_id that links of at most ``radius`` bits reach, itself
    included. A null text is empty, and texts without words have fingerprint 0, linked like any
    other. Repeated doc_ids each keep a row. Rows without a doc_id take part in linking; if all of
    a component's are null, its id is null. An empty table gives no rows.
    """
    fps = store(fingerprints(documents, shingle, seed, bits), "fingerprints")
    distinct = store(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    # Only fingerprints that have a link occur in the components.
    roots = store(components(near_links(distinct.select("fp"), radius, bits)), "roots")
    ids = (
        distinct.join(roots, distinct["fp"] == roots["node"], "left")
        .select("fp", "least", F.coalesce("root", "fp").alias("root"))
    )
    best = ids.groupBy("root").agg(F.min("least").alias("component_id"))
    named = ids.join(best, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")
