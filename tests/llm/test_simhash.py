import random
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import recordlens.llm.simhash as simhash
from recordlens.llm.components import components
from recordlens.llm.simhash import allocate, ball, choose_groups, fingerprint, near_duplicates

SCHEMA = "doc_id long, text string, fp string"


def plain(text, k=4):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(rows, fp, radius):
    """Least doc_id by doc_id, by comparing all pairs."""
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, _) in enumerate(rows):
        for b, _ in rows[:i]:
            if (fp[a] ^ fp[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d, _ in rows}


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgÉ") for _ in range(rng.randint(1, 5)))
    texts = [" ".join(word() for _ in range(rng.randint(1, 120))) for _ in range(n)]
    for _ in range(n):
        w = rng.choice(texts).split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = word()
        texts.append(rng.choice([" ", "\t\n "]).join(w).upper() if rng.random() < 0.3 else " ".join(w))
    return texts + ["", "  \n", "one", "two words"]


def test_fingerprint_is_the_majority_of_the_hashes():
    for t in corpus(1, 40):
        assert int.from_bytes(fingerprint(t.encode()), "big") == plain(t)
        assert fingerprint(t.encode(), bits=128)[:8] == fingerprint(t.encode())


@pytest.mark.parametrize("radius, bits, part", [(4, 64, None), (4, 64, 16), (9, 64, None), (24, 128, None)])
def test_equals_all_pairs(spark, monkeypatch, radius, bits, part):
    if part:
        monkeypatch.setattr(simhash, "LIST_PART", part)
    texts = corpus(radius, 150)
    # A dense family: fingerprints around those of short texts.
    rows = [(i * 7 % 2003, t) for i, t in enumerate(texts)]
    fp = {d: int.from_bytes(fingerprint(t.encode(), bits=bits), "big") for d, t in rows}
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
    got = {r["doc_id"]: r for r in near_duplicates(df, radius=radius, bits=bits).collect()}
    want = groups(rows, fp, radius)
    assert len(set(want.values())) < len(rows)
    assert {d: r["component_id"] for d, r in got.items()} == want
    assert {d: int.from_bytes(r["fp"], "big") for d, r in got.items()} == fp


def test_dense_family(spark, monkeypatch):
    """Many fingerprints a bit or two apart, in long lists and cut into parts."""
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63)
    fps = {int(base)} | {int(base) ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (300, 2))}
    far = [int(x) for x in rng.integers(0, 1 << 63, 100)]
    rows = [(x.to_bytes(8, "big"),) for x in [*fps, *far]]
    for part in (16_384, 32):
        monkeypatch.setattr(simhash, "LIST_PART", part)
        links = simhash.near_links(spark.createDataFrame(rows, "fp binary"), 4).collect()
        assert all((int.from_bytes(r["a"], "big") ^ int.from_bytes(r["b"], "big")).bit_count() <= 4 for r in links)
        roots = components(spark.createDataFrame([(r["a"], r["b"]) for r in links], "a binary, b binary")).collect()
        assert len({r["root"] for r in roots}) == 1 and len(roots) == len(fps)


def test_thresholds():
    rng = random.Random(0)
    for _ in range(30):
        m, total = rng.randint(1, 4), rng.randint(-1, 5)
        costs = [[0.0, *sorted(rng.random() for _ in range(7))] for _ in range(m)]
        if total < -m:
            continue
        best = min(
            sum(costs[i][t + 1] for i, t in enumerate(ts)) for ts in product(range(-1, 7), repeat=m) if sum(ts) == total
        )
        ts = allocate(costs, total)
        assert sum(ts) == total and abs(sum(costs[i][t + 1] for i, t in enumerate(ts)) - best) < 1e-12
    assert ball(21, 1) == 22 and choose_groups(10**9, 4) <= choose_groups(10**3, 4)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 400)] + [(1000, 1001 + i) for i in range(300)] + [(5000, 5000), (7001, 7000)]
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(401)} == {0} and {got[1000 + i] for i in range(301)} == {1000} and got[7001] == 7000
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_nulls_and_repeats(spark):
    rows = [(None, "a b c d e f", ""), (9, "A B C D E F", ""), (9, "other words than the others here", ""), (4, None, ""), (8, "", ""), (None, "alone in the corpus it is", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r["doc_id"], r["component_id"]) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 9), (9, 9), (9, 9), (4, 4), (8, 4), (None, None)], key=str)
    assert near_duplicates(df.limit(0)).count() == 0
    assert near_duplicates(df.limit(0), bits=128, radius=24).count() == 0
    assert near_duplicates(df.limit(1), bits=128, radius=24).count() == 1
    assert pa.array([1]) is not None
