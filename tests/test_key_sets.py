import random

from pyspark.sql import functions as F

from recordlens.operators import keys as K


def lists(seed):
    rng = random.Random(seed)
    return {
        "a": [rng.randrange(-70_000, 90_000) for _ in range(9_000)] + [None, 0, -1, 32_768, 32_769, -32_768],
        "b": [rng.randrange(0, 60_000) for _ in range(9_000)], "c": [], "d": [5, 5, 7],
    }


def frames(spark, data, kind="long"):
    return {n: spark.createDataFrame([(v,) for v in vs], f"k {kind}") for n, vs in data.items()}


def test_coverage_by_bitmaps_equals_coverage_by_key(spark):
    for data in (lists(1), {n: [v and v * 10**12 for v in vs] for n, vs in lists(2).items()}):
        tables = {n: (df, "k") for n, df in frames(spark, data).items()}
        got = {r["table_name"]: r for r in K.key_coverage_of(tables).collect()}
        want = {r["table_name"]: r for r in K.key_coverage(K.key_counts(tables), list(tables)).collect()}
        assert got == want and got["a"]["unique_keys"] == len(set(data["a"]) - {None}) and got["c"]["unique_keys"] == 0


def test_dense_and_sparse_sets(spark):
    dense, sparse = lists(3), {n: [v and v * 10**12 for v in vs] for n, vs in lists(3).items()}
    for data, want in ((dense, ["x"]), (sparse, [])):
        rows = [("x", t, v) for t, vs in data.items() for v in vs]
        assert K.dense_sets(spark.createDataFrame(rows, "name string, table_name string, value long")) == want
    tables = {n: (df, "k") for n, df in frames(spark, dense).items()}
    # One row per bucket and table reaches the shuffle.
    values = spark.createDataFrame([("x", t, v) for t, vs in dense.items() for v in vs], "name string, table_name string, value long")
    assert K.set_bitmaps(values).count() <= 2 * (160_000 // K.BITMAP_VALUES + 2) + 1
    assert K.key_coverage_of(tables).filter("table_name = 'd'").first()["unique_keys"] == 2


def test_overlap_of_numbers_and_texts(spark):
    data = lists(4)
    tables = {
        n: df.withColumn("s", (F.col("k") % 100).cast("string")).withColumn("far", F.col("k") * 10**12) for n, df in frames(spark, data).items()
    }
    tables["e"] = spark.createDataFrame([("1", 4)], "s string, other int")
    got = {(r["column"], r["table_name"], r["other_table"]): (r["distinct_values"], r["in_other"]) for r in K.field_overlap(tables).collect()}
    sets = {("k", n): {v for v in vs if v is not None} for n, vs in data.items()}
    sets |= {("far", n): v for (_, n), v in list(sets.items())}
    sets |= {("s", n): {str(v - 100 * int(v / 100)) for v in vs if v is not None} for n, vs in data.items()} | {("s", "e"): {"1"}}
    want = {
        (c, a, b): (len(x), len(x & sets[c, b])) for (c, a), x in sets.items() for (d, b) in sets if c == d and a != b
    }
    assert got == want
