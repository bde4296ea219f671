import random

import numpy as np
import pytest

from recordlens.llm import near_copies, simhash, stages
from recordlens.llm.near_copies import keep_first

SCHEMA = "doc_id long, text string, lang string"


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def alike(x, y):
    return len(x & y) >= 0.8 * len(x | y)


def groups(rows):
    """Least doc_id by doc_id, by comparing all pairs."""
    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if alike(x, y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d, _ in rows}


def corpus(seed, n):
    rng = random.Random(seed)

    def text(size):
        return " ".join("".join(rng.choice("abcdefghijÉ") for _ in range(5)) for _ in range(size))

    out = []
    for size in (3, 5, 8, 9, 10, 14, 30, 120, 400):
        for _ in range(n):
            base = text(size)
            out.append(base)
            out.append(f"{base} {text(1)}")
            # A shared template: similarities from 0.5 to 1.
            w = base.split()
            cut = int(len(w) * rng.uniform(0.7, 1))
            out.append(" ".join(w[:cut] + text(len(w) - cut).split()))
    # A dense group around one text.
    w = text(100).split()
    for _ in range(60):
        v = list(w)
        for _ in range(rng.randint(0, 3)):
            v[rng.randrange(len(v))] = text(1)
        out.append(" ".join(v))
    return [*out, "", "  \n", None, "one", "ONE"]


@pytest.mark.parametrize("part", [None, 16])
def test_equals_all_pairs(spark, monkeypatch, part):
    if part:
        monkeypatch.setattr(near_copies, "LIST_PART", part)
    rows = [(i * 7 % 2003, t) for i, t in enumerate(corpus(part or 1, 8))]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA).repartition(5)
    want = groups(rows)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(df, 5, 0.8).collect()}
    assert got == want
    kept = stages.near_dedup(spark, df, "")
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(want.values())


def test_equals_all_pairs_of_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = groups([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"] for r in stages.near_dedup(spark, docs, "").collect()} == set(want.values())


def test_band_values_miss_few_pairs():
    rng = np.random.default_rng(0)
    for size in (5, 50, 500):
        shared, own = size * 8 // 10, size // 10
        missed = 0
        for _ in range(300):
            x = rng.integers(0, 1 << 63, shared + 2 * own + size % 5, dtype=np.uint64)
            a, b = x[: shared + own], np.concatenate([x[:shared], x[shared + own :]])
            v = near_copies.bands(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            missed += not (v[0] == v[1]).any()
        assert missed <= 1


def test_fingerprints_of_alike_sets_are_near():
    rng = np.random.default_rng(1)
    most = near_copies.most_differing(0.8)
    for size in (near_copies.SIM_LEAST + 6, 500):
        shared, own = -(-size * 8 // 9), size // 9
        far = []
        for _ in range(400):
            x = rng.integers(0, 1 << 63, shared + 2 * own, dtype=np.uint64)
            a, b = x[: shared + own], np.concatenate([x[:shared], x[shared + own :]])
            s = near_copies.simhashes(np.concatenate([a, b]), np.array([0, len(a), len(a), len(a) + len(b)]))
            far.append(int(np.bitwise_count(s[0] ^ s[2]).sum()))
            assert not s[1].any()
        assert max(far) <= most < near_copies.SIM_BITS // 2 - 30
    one = np.array([5, 9, 3], np.uint64)
    bits = near_copies.simhashes(one, np.array([0, 3]))[0]
    words = [near_copies.mix(one ^ f) for f in near_copies._FLIP[:4]]
    for k, w in enumerate(words):
        byte = lambda v, i: int(v).to_bytes(8, "little")[i]
        want = bytes(sum(((sum(byte(v, i) >> b & 1 for v in w) * 2 > 3) << b) for b in range(8)) for i in range(8))
        assert int(bits[k]).to_bytes(8, "little") == want


def test_very_long_texts(spark):
    base = [f"w{i}" for i in range(400_000)]
    near, far = [*base[:-20_000], *[f"v{i}" for i in range(20_000)]], [*base[:200_000], *[f"u{i}" for i in range(200_000)]]
    df = spark.createDataFrame([(i, " ".join(w), "") for i, w in enumerate([base, near, far])], SCHEMA)
    assert {r["doc_id"] for r in keep_first(df, 5, 0.8).collect()} == {0, 2}


def test_repeated_ids_lose_only_the_copy(spark):
    rows = [
        (1, "a b c d e f", ""), (2, "A B C D E F", ""), (2, "other words than the others here", ""), (None, "a b c d e f", ""),
        (4, None, ""), (8, "", ""), (None, "alone in the corpus it is", ""), (None, "alone in the corpus it is", ""),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = sorted(((r["doc_id"], r["text"]) for r in keep_first(df, 5, 0.8).collect()), key=str)
    assert kept == sorted([(d, t) for d, t, _ in rows if (d, t) not in ((2, "A B C D E F"), (8, ""))], key=str)
    assert keep_first(df.limit(0), 5, 0.8).count() == 0


def edited(rng, size):
    """A text, the same with its last word changed, and both once more with other spacing and case."""
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(size)]
    near = [*words[:-1], "other"]
    return [" ".join(words), " ".join(near), "  ".join(words).upper(), "\n".join(near)]


def test_operator_9_finds_pairs_without_band_values(spark, monkeypatch):
    """The stage lists candidates by SimHash within the operator's radius; without lists of band values these pairs are left."""
    listed = near_copies._listed
    monkeypatch.setattr(near_copies, "_listed", lambda distinct: listed(distinct).limit(0))
    rng = random.Random(3)
    texts = [t for size in (60, 120, 400, 700, 900) for t in edited(rng, size)]
    rows = [(i, t, "") for i, t in enumerate(texts)]
    prints = [int.from_bytes(simhash.fingerprint(t.encode())) for t in texts]
    want = {i: min(j for j in range(i + 1) if (prints[i] ^ prints[j]).bit_count() <= simhash.RADIUS) for i in range(len(texts))}
    assert any(prints[i] != prints[j] for i, j in want.items())  # not only equal fingerprints
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert {r["doc_id"] for r in stages.near_dedup(spark, df, "").collect()} == set(want.values())


def test_pairs_of_operator_9_are_checked(spark):
    """Fingerprints count repeats and sets do not: equal fingerprints of sets that share little are no near copies."""
    often = "a " * 2000
    rows = [(i, often + " ".join(f"{x}{k}" for k in range(30)), "") for i, x in enumerate("xyz")]
    assert len({simhash.fingerprint(t.encode()) for _, t, _ in rows}) == 1
    df = spark.createDataFrame(rows, SCHEMA)
    assert near_copies._by_fingerprint(near_copies._sets(df.withColumn("seal", df["doc_id"]), 5, True)).count() == 2
    assert {r["doc_id"] for r in stages.near_dedup(spark, df, "").collect()} == {0, 1, 2}
