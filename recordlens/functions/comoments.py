"""Pairwise co-moments of many columns: matrix products per block of rows, and a merge that keeps their precision.

For columns i and j, over the rows where both have a value: the number of rows, both means, both sums of squared deviations, and the
sum of products of deviations. Rows in which one of the two is not finite are counted apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Quantities per pair: n, mean of i, mean of j, squares of i, squares of j, products, rows that are not finite.
QUANTITIES = 7
MOMENT_SCHEMA = "i int, part int, moments binary"
# Rows of one matrix product, and the first level of the merge.
BLOCK, PARTS = 4_096, 64


def of_block(x: np.ndarray) -> np.ndarray:
    """(QUANTITIES, columns, columns) of (rows, columns) values; NaN in ``x`` is a missing value only where masked."""
    known = ~np.ma.getmaskarray(x)
    x = np.ma.getdata(x)
    finite = np.isfinite(x) & known
    m = finite.astype(np.float64)
    any_known = known.astype(np.float64)
    n = m.T @ m
    # Deviations from a value of the column near its mean: small numbers, and none for a constant column.
    with np.errstate(all="ignore"):
        mean = np.where(finite, x, 0).sum(axis=0) / m.sum(axis=0)
        nearest = np.where(finite, np.abs(x - mean), np.inf).argmin(axis=0)
        shift = np.where(m.any(axis=0), x[nearest, np.arange(x.shape[1])], 0.0)
        d = np.where(finite, x - shift, 0.0)
        s, ss, p = d.T @ m, (d * d).T @ m, d.T @ d
        mean_i = np.where(n > 0, s / n, 0.0)
    xx = np.maximum(ss - mean_i * s, 0)
    # Rounding of squares that cancel is no spread.
    xx[xx <= 1e-14 * ss] = 0
    return np.stack([n, mean_i + shift[:, None], (mean_i + shift[:, None]).T, xx, xx.T, p - mean_i * s.T, any_known.T @ any_known - n])


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a[0] + b[0]
    with np.errstate(all="ignore"):
        share = np.where(n > 0, b[0] / n, 0.0)
    # A side without rows has no mean.
    di, dj = (np.where((a[0] > 0) & (b[0] > 0), b[k] - a[k], 0.0) for k in (1, 2))
    w = a[0] * share
    first = a[0] > 0
    return np.stack([
        n, np.where(first, a[1] + di * share, b[1]), np.where(first, a[2] + dj * share, b[2]),
        a[3] + b[3] + di * di * w, a[4] + b[4] + dj * dj * w, a[5] + b[5] + di * dj * w, a[6] + b[6],
    ])


def moment_batch(columns: list[int], part: int, moments: np.ndarray) -> pa.RecordBatch:
    """A row per column i, with its quantities for all columns j."""
    rows = [np.ascontiguousarray(moments[:, k]).tobytes() for k in range(len(columns))]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns, pa.int32()), pa.array([part] * len(columns), pa.int32()), pa.array(rows, pa.binary())], names=["i", "part", "moments"]
    )


def moment_rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The co-moments of a task's rows (v: an array of k doubles)."""
    from pyspark import TaskContext

    total = None
    for batch in batches:
        flat = pc.list_flatten(batch.column(0))
        mask = np.asarray(flat.is_null()).reshape(-1, k)
        values = np.asarray(pc.fill_null(flat, 0.0)).reshape(-1, k)
        for lo in range(0, len(values), BLOCK):
            own = of_block(np.ma.array(values[lo : lo + BLOCK], mask=mask[lo : lo + BLOCK]))
            total = own if total is None else merge(total, own)
    if total is not None:
        part = TaskContext.get().partitionId() % PARTS
        for i in range(k):
            yield moment_batch([i], part, total[:, i : i + 1])


def merge_rows(table: pa.Table) -> np.ndarray:
    """(QUANTITIES, columns j) of all rows of one column i; a row is a task or a part of the tasks."""
    total = None
    for raw in table["moments"].to_pylist():
        own = np.frombuffer(raw, np.float64).reshape(QUANTITIES, -1)
        total = own if total is None else merge(total, own)
    return total
