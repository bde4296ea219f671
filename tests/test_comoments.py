import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordlens.functions import comoments
from recordlens.operators import describe as D


def test_equals_corr_of_every_pair(spark):
    rng = random.Random(2)
    rows = []
    for i in range(700):
        a = rng.gauss(1e9, 3)
        rows.append([
            a, None if rng.random() < 0.3 else a * 2 + rng.gauss(0, 5), rng.choice([None, 1.0, 2.0]), 0.1, None, rng.gauss(0, 1) if i % 2 else None,
            5.0 if i == 3 else None, math.nan if i == 7 else rng.random(), math.inf if i == 9 else rng.random(), 0.1 if i % 3 else None,
        ])
    names = [f"c {k}" for k in range(10)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in names)).repartition(6)
    got = {(r["var1"], r["var2"]): r["r"] for r in D.correlation_matrix(df, names).collect()}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    assert set(got) == set(pairs)
    for a, b in pairs:
        both = [(r[names.index(a)], r[names.index(b)]) for r in rows if r[names.index(a)] is not None and r[names.index(b)] is not None]
        x, y = np.array(both, float).reshape(-1, 2).T
        if len(both) and not np.isfinite(np.array(both)).all():
            assert math.isnan(got[a, b])
        elif len(both) < 2 or x.min() == x.max() or y.min() == y.max():
            assert got[a, b] is None, (a, b)
        else:
            x, y = x - x.mean(), y - y.mean()
            assert got[a, b] == pytest.approx((x * y).sum() / math.sqrt((x * x).sum() * (y * y).sum()), abs=1e-9), (a, b)
    empty = D.correlation_matrix(df.limit(0), names).collect()
    assert len(empty) == len(pairs) and all(r["r"] is None for r in empty)


def test_plan_does_not_grow_with_the_pairs(spark):
    sizes = []
    for k in (5, 440):
        df = spark.range(50).select(*[(F.sin(F.col("id") * (i + 1))).alias(f"x{i}") for i in range(k)])
        m = D.correlation_matrix(df, df.columns)
        sizes.append(len(m._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        assert m.filter("abs(r) <= 1.000001").count() == k * (k - 1) // 2
    assert sizes[0] == sizes[1]


def test_merge_in_any_order():
    rng = np.random.default_rng(0)
    x = np.ma.array(rng.normal(1e6, 1, (900, 4)), mask=rng.random((900, 4)) < 0.3)
    whole = comoments.of_block(x)
    parts = [comoments.of_block(x[lo : lo + 70]) for lo in range(0, 900, 70)]
    left = parts[0]
    for p in parts[1:]:
        left = comoments.merge(left, p)
    right = parts[-1]
    for p in reversed(parts[:-1]):
        right = comoments.merge(p, right)
    for m in (left, right):
        assert np.allclose(m, whole, rtol=1e-9, atol=1e-6)
