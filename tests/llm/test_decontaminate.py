import random
import re

import numpy as np
import pyarrow as pa

from recordlens.llm.decontaminate import Items, find_items, keep_clean, weighted_jaccard

SCHEMA = "doc_id long, text string, item_id long"


def words(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())


def shingles(ws, k=5):
    return [tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))] if ws else []


def similarity(a, b):
    keys = set(a) | set(b)
    return sum(min(a.count(x), b.count(x)) for x in keys) / sum(max(a.count(x), b.count(x)) for x in keys)


def brute(docs, items):
    """Best similarity over all windows of the item's length, per (doc_id, item_id)."""
    out = {}
    for d, text, *_ in docs:
        ws = words(text)
        for i, item in items:
            it = words(item)
            if not it or not ws:
                continue
            n = min(len(it), len(ws))
            best = max(similarity(shingles(ws[s : s + n]), shingles(it)) for s in range(len(ws) - n + 1))
            if best >= 0.8:
                out[d, i] = round(best, 9)
    return out


def test_equals_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(80)] + ["Été", "the", "of"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randint(12, 45))) for i in range(12)] + [(50, None), (51, ""), (52, "one two"), (1, text(20))]
    docs = [(0, None, 9), (1, "", 9), (2, "just one two", 9), (None, items[0][1], 9)]
    for d in range(3, 60):
        body = text(rng.randint(0, 60)).split()
        for _ in range(rng.randint(0, 2)):
            passage = rng.choice(items)[1] or ""
            ws = passage.split()
            for _ in range(rng.randint(0, 2)):
                if ws:
                    ws[rng.randrange(len(ws))] = rng.choice(vocab)
            at = rng.randint(0, len(body))
            body[at:at] = (", ".join(ws)).upper().split() if rng.random() < 0.3 else ws
        docs.append((d, " ".join(body), 9))
    docs.append((3, docs[4][1], 9))
    got = find_items(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    have = {}
    for r in got:
        key = r["doc_id"], r["item_id"]
        have[key] = max(have.get(key, 0), round(r["similarity"], 9))
    want = {}
    for d in docs:
        for key, s in brute([d], items).items():
            want[key] = max(want.get(key, 0), s)
    assert len(want) > 15
    assert have == want
    clean = {r["doc_id"] for r in keep_clean(
        spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    ).collect()}
    assert clean == {d for d, *_ in docs} - {d for d, _ in want if d is not None}


def test_block_tables_reach_every_item_within_the_radius():
    rng = np.random.default_rng(0)
    items = Items.of(list(range(30)), [" ".join(f"v{rng.integers(40)}" for _ in range(30)) for _ in range(30)], 5)
    tables = items.tables(24, 8)
    for fp in rng.integers(0, 1 << 63, 300).astype(np.uint64):
        near = set(np.flatnonzero(np.bitwise_count(items.fingerprints ^ fp) <= 24))
        found = set()
        for shift, width, table in tables:
            found |= set(table[int((int(fp) >> shift) & ((1 << width) - 1))])
        assert near <= found


def test_weighted_jaccard_and_empty_tables(spark):
    assert weighted_jaccard(np.array([1, 1, 2]), np.array([1, 2, 3])) == 2 / 4
    docs = spark.createDataFrame([(1, "a b c d e f", 1)], SCHEMA)
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_items(docs, none).count() == 0 and keep_clean(docs, none).count() == 1
    assert find_items(docs.limit(0), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0
    assert pa.array([1]) is not None
