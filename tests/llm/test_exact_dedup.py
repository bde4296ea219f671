"""Exact copies against a dictionary of normalised texts."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from recordlens.llm import exact_dedup

SCHEMA = "doc_id long, text string"
TABLE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(TABLE)].append(i)
    out = []
    for i, t in rows:
        text = (t or "").translate(TABLE)
        own = groups[text]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def seal(text):
    return hashlib.sha256((text or "").translate(TABLE).encode()).hexdigest()


def found(df, **options):
    return sorted((tuple(r) for r in exact_dedup.dedup(df, **options).collect()), key=repr)


ROWS = [
    (1, "A b"), (2, "a B"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, None), (8, "a b "), (9, "x" * 300_000), (10, "X" * 300_000),
    (11, "one"), (11, "one"), (11, "two"), (None, "one"), (None, "lonely"), (None, "pair"), (None, "PAIR"), (12, "K"), (13, "K"),
] + [(100 + i, "Hot text") for i in range(400)] + [(1000 + i, f"text {i % 150}") for i in range(300)]


@pytest.mark.parametrize("options", [
    {}, {"capacity": 4},
    # Poor keys: long chains, a directory of all 64 bits, negative keys.
    {"key": lambda t: F.length(t) % 3, "capacity": 1}, {"key": lambda t: -(F.length(t) % 7), "capacity": 2}, {"key": lambda t: F.lit(5)},
])
def test_equals_brute_force(spark, options):
    assert found(spark.createDataFrame(ROWS, SCHEMA), **options) == brute(ROWS)


def test_directory_doubles_where_buckets_are_overfull(spark):
    keys = [*range(40), *[k << 58 for k in range(-32, 32) if k]]
    rows = exact_dedup.directory(spark.createDataFrame([(k,) for k in keys], "key long"), 8).collect()
    held = defaultdict(set)
    for k in keys:
        unsigned = k & (1 << 64) - 1
        at = [r for r in rows if (unsigned >> (64 - r["depth"]) if r["depth"] else 0) == r["slot"] & (1 << 64) - 1]
        assert len(at) == 1, k
        low = at[0]["bucket"] + (1 << 63)
        assert unsigned >> (64 - at[0]["bucket_depth"]) == low >> (64 - at[0]["bucket_depth"])
        held[at[0]["bucket"]].add(k)
    assert all(len(v) <= 8 for v in held.values()) and sum(map(len, held.values())) == len(set(keys))
    assert {r["bucket"]: r["n"] for r in rows} == {b: len(v) for b, v in held.items()}
    # Its neighbours go without the bits that part the first forty keys.
    assert max(r["bucket_depth"] for r in rows) > 58 and min(r["bucket_depth"] for r in rows) < 8


def test_chains_and_owner_ranges(spark):
    index = exact_dedup.build_index(spark.createDataFrame(ROWS, SCHEMA), key=lambda t: F.length(t) % 3)
    chains = index.chains.collect()
    by_key = defaultdict(list)
    for r in chains:
        by_key[r["key"]].append(r)
    for chain in by_key.values():
        assert sorted(r["place"] for r in chain) == list(range(len(chain)))
        texts = [r["text"].encode() for r in sorted(chain, key=lambda r: r["place"])]
        assert texts == sorted(set(texts))


def test_extra_columns_empty_and_keep_one(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    more = df.select("*", *[F.lit(1).alias(c) for c in ("key", "seal", "size", "keep_id", "bucket", "_id", "_seal")])
    assert found(more) == found(df)
    kept = exact_dedup.keep_one(more)
    assert kept.columns == more.columns
    stays = [kept for _, _, _, kept, _ in (brute(ROWS)[k] for k in range(len(ROWS)))]
    assert kept.count() == sum(stays)
    assert {(r["doc_id"], (r["text"] or "").translate(TABLE)) for r in kept.collect()} == {
        (i, (t or "").translate(TABLE)) for i, t in ROWS if any(x[:1] == (i,) and x[3] and x[4] == seal(t) for x in brute(ROWS))
    }
    assert exact_dedup.dedup(df.limit(0)).count() == 0
    assert dict(exact_dedup.dedup(df.limit(0)).dtypes)["group_size"] == "bigint"


def test_no_python_in_the_plan(spark):
    plan = exact_dedup.dedup(spark.createDataFrame(ROWS, SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
