"""Hard negatives against a plain computation with Python integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordlens.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=10, positives=5, negatives=5):
    ok = [(i, v, k) for i, v, k in rows if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v], k) for i, v, k in ok]
    last = 1 << 63
    out = []
    for at, (i, v, k) in enumerate(whole):
        if i is None or i % every:
            continue
        scored = sorted(
            ((-sum(x * y for x, y in zip(v, w)), last if j is None else j, j, m) for b, (j, w, m) in enumerate(whole) if b != at), key=lambda r: r[:2]
        )
        for s, _, j, _ in [r for r in scored if r[3] == k][:positives]:
            p = -s
            band = [r for r in scored if r[3] != k and 80 * p <= -100 * r[0] <= 100 * p][:negatives]
            out += [(i, j, n, r[2], p, -r[0]) for n, r in enumerate(band, 1)]
    return sorted(out, key=repr)


def mined(spark, rows, schema=SCHEMA, **options):
    df = spark.createDataFrame(rows, schema) if not hasattr(rows, "columns") else rows
    return sorted((tuple(r) for r in hn.mine(df, F.col("vec_id") % 10 == 0, **options).collect()), key=repr)


def test_scores_are_exact():
    rng = np.random.default_rng(1)
    for high in (1, 7, 300, 1 << 20):
        a, b = (rng.integers(-high, high + 1, (n, 24)) for n in (5, 9))
        planes = hn.to_planes(b)
        assert (hn.from_planes(planes) == b).all()
        assert (hn.scores(hn.subset_sums(a), planes) == b @ a.T).all()


@pytest.mark.parametrize("block, part", [(512, 8192), (3, 16)])
def test_equals_brute_force(spark, block, part):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(4, 12))
    rows = [(i, [float(x) for x in (base[i % 4] + rng.normal(size=12) * 0.4)], int(i % 4 if i % 5 else (i + 1) % 4)) for i in range(160)]
    assert mined(spark, rows, block=block, part=part) == brute(rows)


def test_ties_repeats_nulls_and_odd_lengths(spark):
    v = [0.5, 0.25, -0.5]
    rows = [(i, v, i % 2) for i in range(25)] + [(10, v, 0), (10, v, 0), (20, v, 1)]
    rows += [(None, v, 0), (None, v, 1), (30, None, 0), (31, v, None), (32, [0.5, None, 0.1], 1), (33, [math.nan, 0.5, 0.1], 1), (34, [math.inf, 0.0, 0.0], 0)]
    rows += [(40, [0.5], 0), (41, [], 0), (42, [0.25] * 11, 1), (50, [-0.5, 0.0], 1)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, rows, block=2, part=4) == brute(rows)


def test_negative_and_zero_positive_scores(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [-1.0, 0.0], 0), (2, [0.0, 1.0], 0), (3, [0.0, 1.0], 1), (4, [-0.9, 0.0], 1)]
    got = mined(spark, rows)
    assert got == brute(rows) and {r[4] for r in got} == {0}


def test_extra_columns_and_empty(spark):
    rows = [(i, [0.1 * i, 0.2], i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    more = df.select("*", *[F.lit(1).alias(c) for c in ("row", "bits", "part", "block", "planes", "score", "anchor")])
    assert mined(spark, more) == mined(spark, df) == brute(rows)
    assert hn.mine(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert hn.mine(df.filter("vec_id % 10 <> 0"), F.col("vec_id") % 10 == 0).count() == 0


def test_scores_beyond_a_long(spark):
    df = spark.createDataFrame([(0, [1e12], 0), (1, [1e12], 0)], SCHEMA)
    with pytest.raises(Exception, match="do not fit a long"):
        hn.mine(df, F.col("vec_id") % 10 == 0).collect()
