"""Hard negatives by exact integer scores, computed with subset-sum tables instead of multiplications (Four Russians).

1. Every vector becomes integers, and these become bit planes: a byte holds one bit of eight neighbouring dimensions.
2. For an anchor and eight dimensions, a table gives the sum of the anchor's components over each of the 256 subsets of them.
   A candidate's byte of a plane picks its entry, so a plane's share of the score is one look-up per eight dimensions; planes
   are added by shifts, the sign plane with a minus. A score is exact.
3. All anchors meet all rows in blocks: up to 512 anchors by up to 8,192 rows, a group each, whose tables are built once. Anchors first
   find their positives among the rows of their label, then the band of scores below each positive among the others. Each
   group sends its first few per anchor or per positive only, and the window over them keeps the first few of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordlens.llm.common import store

ANCHORS, ROWS = 512, 8_192
# Rows that one step scores together, so that its sums stay in the cache.
STEP = 512

PLANE_SCHEMA = "row long, vec_id long, label long, anchor boolean, groups int, planes int, bits binary"
POSITIVE_SCHEMA = "row long, vec_id long, other long, other_id long, score long"
NEGATIVE_SCHEMA = "row long, anchor_id long, other long, positive_id long, positive_score long, negative_id long, negative_score long"


def to_planes(values: np.ndarray) -> np.ndarray:
    """(rows, planes, groups) bytes of (rows, dimensions) integers in two's complement; the last plane has the sign."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    planes = max(max(high, -low - 1, 0).bit_length() + 1, 1)
    bits = (values[:, None, :] >> np.arange(planes)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")


def from_planes(planes: np.ndarray) -> np.ndarray:
    """The integers of :func:`to_planes`, with zeros up to eight dimensions a group."""
    bits = np.unpackbits(planes, axis=2, bitorder="little").astype(np.int64)
    weights = np.int64(1) << np.arange(planes.shape[1], dtype=np.int64)
    weights[-1] *= -1
    return np.tensordot(bits, weights, axes=([1], [0]))


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): sums of (anchors, dimensions) integers over all subsets of eight dimensions."""
    grouped = anchors.reshape(len(anchors), -1, 8).transpose(1, 2, 0)
    out = np.zeros((grouped.shape[0], 256, len(anchors)), anchors.dtype)
    for b in range(8):
        # Subsets with dimension b are those without it, and its component.
        np.add(out[:, : 1 << b], grouped[:, b : b + 1], out=out[:, 1 << b : 2 << b])
    return out


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, anchors) inner products: a look-up per plane and group, planes added by shifts from the sign down."""
    out = np.zeros((len(planes), tables.shape[2]), tables.dtype)
    found = np.empty_like(out)
    for j in range(planes.shape[1] - 1, -1, -1):
        np.left_shift(out, 1, out=out)
        for g in range(planes.shape[2]):
            np.take(tables[g], planes[:, j, g], axis=0, out=found, mode="clip")
            if j == planes.shape[1] - 1:
                np.subtract(out, found, out=out)
            else:
                np.add(out, found, out=out)
    return out


def _indexed(rows: DataFrame, scale: int) -> DataFrame:
    """Rows with their bit planes, stored; only rows with a label and a vector of finite numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pc.list_value_length(batch.column("vector")), dtype=np.int64)
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                values = np.asarray(pc.list_flatten(part.column("vector")), dtype=np.float64).reshape(part.num_rows, size)
                whole = np.floor(values * scale)
                if whole.size and np.abs(whole).max() >= 2.0**62:
                    raise OverflowError("scores of such components do not fit a long")
                padded = np.zeros((part.num_rows, -(-size // 8) * 8), np.int64)
                padded[:, :size] = whole
                planes = to_planes(padded)
                n = part.num_rows
                bits = [p.tobytes() for p in planes]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("vec_id"), part.column("label"), part.column("anchor"),
                     pa.array(np.full(n, planes.shape[2]), pa.int32()), pa.array(np.full(n, planes.shape[1]), pa.int32()), pa.array(bits, pa.binary())],
                    names=["row", "vec_id", "label", "anchor", "groups", "planes", "bits"],
                )

    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return store(rows.filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & finite).mapInArrow(run, PLANE_SCHEMA), "planes")


def _matrix(table: pa.Table) -> np.ndarray:
    """The planes of rows of any numbers of planes and groups: the sign plane repeats, groups beyond the end are zero."""
    planes = np.asarray(table["planes"])
    groups = np.asarray(table["groups"])
    most, widest = int(planes.max(initial=1)), int(groups.max(initial=0))
    out = np.zeros((table.num_rows, most, widest), np.uint8)
    bits = table["bits"].to_pylist()
    for p, g in {*zip(planes.tolist(), groups.tolist(), strict=True)}:
        at = np.flatnonzero((planes == p) & (groups == g))
        own = np.frombuffer(b"".join(bits[i] for i in at), np.uint8).reshape(len(at), p, g)
        out[at, :p, :g] = own
        out[at, p:, :g] = own[:, -1:, :]
    return out


def _blocks(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple[slice, np.ndarray]]:
    """Scores of all rows with all anchors, a step of rows at a time."""
    values, planes = from_planes(_matrix(anchors)), _matrix(rows)
    width = max(values.shape[1], planes.shape[2] * 8)
    values = np.pad(values, ((0, 0), (0, width - values.shape[1])))
    planes = np.pad(planes, ((0, 0), (0, 0), (0, width // 8 - planes.shape[2])))
    # The largest number on the way to any score.
    bound = int(np.abs(values).sum(axis=1, dtype=object).max()) << planes.shape[1] if values.size else 0
    if bound * 100 >= 1 << 63:
        raise OverflowError("scores of such components do not fit a long")
    tables = subset_sums(values.astype(np.int32 if bound < 1 << 31 else np.int64))
    for lo in range(0, len(planes), STEP):
        at = slice(lo, min(lo + STEP, len(planes)))
        yield at, scores(tables, planes[at])


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Ids in an order of whole numbers with nulls last."""
    return np.asarray(pc.fill_null(column, (1 << 63) - 1))


def _first(anchor: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of every anchor, higher scores first, then smaller ids."""
    order = np.lexsort((vec, -score, anchor))
    a = anchor[order]
    start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    rank = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
    return order[rank < k]


def _grid(table: DataFrame, keys: list[str], blocks: Column, parts: Column, rows: bool) -> DataFrame:
    """``table`` once for each block of anchors (rows) or part of rows (anchors) that its members meet."""
    own = F.pmod(F.xxhash64("row"), parts if rows else blocks).cast("int")
    every = F.explode(F.sequence(F.lit(0), (blocks if rows else parts) - 1))
    named = table.withColumn("part" if rows else "block", own).withColumn("block" if rows else "part", every)
    # Columns of their own, as both sides of a grid come from one table.
    return named.select(*[F.col(c).alias(c) for c in (*keys, "block", "part", *[c for c in table.columns if c not in keys])])


def _pieces(n: Column, most: int) -> Column:
    return F.greatest(F.ceil(n / most), F.lit(1)).cast("int")


def _positives(index: DataFrame, k: int, block: int, part: int) -> DataFrame:
    """The first k rows of each anchor's label, itself left out; stored."""
    counts = index.groupBy("label").agg(F.count_if("anchor").alias("anchors"), F.count(F.lit(1)).alias("rows")).filter("anchors > 0")
    counts = store(counts.select("label", _pieces(F.col("anchors"), block).alias("blocks"), _pieces(F.col("rows"), part).alias("parts")), "label-counts")
    sized = index.join(counts, "label")
    keys = ["label", "block", "part"]
    rows = _grid(sized, ["label"], F.col("blocks"), F.col("parts"), rows=True).drop("blocks", "parts")
    anchors = _grid(sized.filter("anchor"), ["label"], F.col("blocks"), F.col("parts"), rows=False).drop("blocks", "parts")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 3
        if left.num_rows and right.num_rows:
            own, row, vec = np.asarray(left["row"]), np.asarray(right["row"]), _numbers(right["vec_id"])
            for at, found in _blocks(left, right):
                found = found.astype(np.int64)
                r, a = np.nonzero(row[at][:, None] != own[None, :])
                out = [np.concatenate(x) for x in zip(out, (a, found[r, a], r + at.start), strict=True)]
                keep = _first(out[0], out[1], vec[out[2]], k)
                out = [x[keep] for x in out]
        a, s, r = (pa.array(x) for x in out)
        return pa.table(
            [left["row"].take(a), left["vec_id"].take(a), right["row"].take(r), right["vec_id"].take(r), s],
            names=["row", "vec_id", "other", "other_id", "score"],
        )

    found = anchors.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(run, POSITIVE_SCHEMA)
    first = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("other_id"), "other")
    return store(found.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k).drop("_n"), "positives")


def _bands(anchor: np.ndarray, score: np.ndarray, vec: np.ndarray, wanted: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(wanted pair, place): for each wanted (anchor, low, high), its first k of the scores within, in order."""
    order = np.lexsort((vec, -score, anchor))
    a, s = anchor[order], score[order]
    # Where an anchor's scores fall to ``high``: the rows are sorted by (anchor, -score).
    start, stop = np.searchsorted(a, wanted), np.searchsorted(a, wanted, side="right")
    begin = np.array([x + np.searchsorted(-s[x:y], -h) for x, y, h in zip(start.tolist(), stop.tolist(), high.tolist(), strict=True)], np.int64)
    at = begin[:, None] + np.arange(k)[None, :]
    fits = at < stop[:, None]
    if len(s):
        fits &= s[np.minimum(at, len(s) - 1)] >= low[:, None]
    pair, _ = np.nonzero(fits)
    return pair, order[at[fits]]


def _negatives(index: DataFrame, positives: DataFrame, k: int, floor: int, block: int, part: int) -> DataFrame:
    """For every positive, the first k rows of other labels with floor percent of its score to all of it."""
    # A band below a negative score is empty.
    wanted = positives.filter("score >= 0").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("other", "other_id", "score"))).alias("pairs"))
    anchors = store(index.filter("anchor").join(wanted, "row"), "anchors")
    n = index.agg(F.count(F.lit(1))).first()[0]
    blocks, parts = (max(-(-m // size), 1) for m, size in ((anchors.count(), block), (n, part)))
    keys = ["block", "part"]
    left = _grid(anchors, [], F.lit(blocks), F.lit(parts), rows=False)
    right = _grid(index.drop("anchor"), [], F.lit(blocks), F.lit(parts), rows=True)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["row", "anchor_id", "other", "positive_id", "positive_score", "negative_id", "negative_score"]
        if not (left.num_rows and right.num_rows):
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        lists = left["pairs"].combine_chunks()
        owner = np.asarray(pc.list_parent_indices(lists), dtype=np.int64)
        pairs = pc.list_flatten(lists)
        high = np.asarray(pc.struct_field(pairs, "score"))
        low = -((-floor * high) // 100)
        least = np.full(left.num_rows, np.iinfo(np.int64).max)
        np.minimum.at(least, owner, low)
        most = np.full(left.num_rows, -1)
        np.maximum.at(most, owner, high)
        label, vec = np.asarray(right["label"]), _numbers(right["vec_id"])
        own_label = np.asarray(left["label"])
        held = [np.zeros(0, np.int64)] * 3
        pair, place = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at, found in _blocks(left, right):
            r, a = np.nonzero((found >= least[None, :]) & (found <= most[None, :]) & (label[at][:, None] != own_label[None, :]))
            if not len(r):
                continue
            held = [np.concatenate(x) for x in zip(held, (a, found[r, a].astype(np.int64), r + at.start), strict=True)]
            pair, place = _bands(held[0], held[1], vec[held[2]], owner, low, high, k)
            # Rows that no band has among its first are done with.
            keep, place = np.unique(place, return_inverse=True)
            held = [x[keep] for x in held]
        at, who = pa.array(pair), pa.array(owner[pair])
        return pa.table(
            [left["row"].take(who), left["vec_id"].take(who), *[pc.struct_field(pairs, c).take(at) for c in ("other", "other_id", "score")],
             right["vec_id"].take(pa.array(held[2][place])), pa.array(held[1][place])], names=names,
        )

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, NEGATIVE_SCHEMA)
    order = Window.partitionBy("row", "other").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    embeddings: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, floor: int = 80, scale: int = 256,
    block: int = ANCHORS, part: int = ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from rows (vec_id, embedding, label).

    Rows where ``anchor`` is true are anchors. Components become floor(scale * x). Scores are inner products, higher first, then
    smaller vec_id. An anchor's positives are the first other rows of its label; each positive's negatives the first rows of
    other labels with ``floor`` percent of its score up to all of it. Rows with a null label, a null vector or a component
    that is null or not finite take no part. Vectors of unequal length count as if the shorter ended in zeros; an empty one
    scores 0 with all. Rows that repeat a vec_id are rows of their own, so a repeated anchor has its results
    as often; rows without a vec_id come last among equal scores and their results have a null id. Scores that could
    exceed a long raise OverflowError. Other columns are left out; an empty table gives no rows.
    """
    rows = embeddings.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col("embedding").cast("array<double>").alias("vector"),
    )
    index = _indexed(rows, scale)
    found = _negatives(index, _positives(index, positives, block, part), negatives, floor, block, part)
    return found.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
