import collections
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from recordlens.llm.packing import Schedule, pack_documents, sequences
from recordlens.llm.tokens import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.mark.parametrize("seed", range(6))
def test_schedule_is_a_deficit_round_robin(seed):
    rng = np.random.default_rng(seed)
    k = int(rng.integers(1, 6))
    lengths = rng.integers(0, 4000, k).tolist()
    weights = rng.integers(1, 50, k).astype(float).tolist() if seed % 2 else [float(max(x, 1)) for x in lengths]
    s = Schedule(lengths, weights, 64, 16)
    got = {}
    for q in range(k):
        for i in range(s.full[q]):
            got[int(s.rank(q, np.array([i]))[0])] = (q, i)
    # The literal scheduler: the source with the earliest due quantum goes next, ties in order.
    sent, want = [0] * k, []
    while any(sent[q] < s.full[q] for q in range(k)):
        q = min((q for q in range(k) if sent[q] < s.full[q]), key=lambda q: ((sent[q] + 0.5) / weights[q], q))
        want.append((q, sent[q]))
        sent[q] += 1
    assert [got[i] for i in range(len(want))] == want
    # No source is ever more than a quantum away from its share while all have tokens.
    live = min((s.full[q] / weights[q] for q in range(k)), default=0)
    count = collections.Counter()
    for at, (q, i) in enumerate(want):
        if (i + 0.5) / weights[q] >= live:
            break
        count[q] += 1
        for p in range(k):
            assert abs(count[p] - (at + 1) * weights[p] / sum(weights)) <= k


def test_pieces_cover_all_ids_without_padding(spark):
    t = Tokenizer.from_file(PATH)
    rows = [(i, " ".join(f"w{i}x{j % 7}" for j in range(i * 13 % 400)), ["a", "b", None][i % 3], "x") for i in range(120)]
    rows += [(7, None, "a", "x"), (None, "no id", "c", "x"), (7, "", "b", "x"), (500, "long " * 20000, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, offset string").repartition(4)
    pieces = pack_documents(df, PATH, 1).cache()
    found = pieces.collect()
    want = collections.Counter()
    for doc_id, text, _, _ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want[doc_id, len(ids)] += len(ids)
        if doc_id not in (7, None):
            mine = sorted((r["start"], r["length"], bytes(r["ids"])) for r in found if r["doc_id"] == doc_id)
            at = 0
            for start, length, raw in mine:
                assert start == at and raw == ids[start : start + length].tobytes()
                at += length
            assert at == len(ids)
    have = collections.Counter()
    for r in found:
        have[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert have == want
    by_seq = collections.defaultdict(list)
    for r in found:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(by_seq) == list(range(len(by_seq)))
    sizes = []
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        sizes.append(at)
    assert all(n == 2048 or n & (n - 1) == 0 for n in sizes) and sum(n < 2048 for n in sizes) <= 11
    whole = {r["sequence_id"]: r["length"] for r in sequences(pieces).collect()}
    assert sorted(whole.values()) == sorted(sizes)
    assert zlib.crc32(b"") == 0


def test_targets_and_many_sources(spark):
    rows = [(i, "the cat sat on the mat " * 60, "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = pack_documents(df, PATH, 1, targets={"a": 3.0, "b": 1.0}).collect()
    first = collections.Counter()
    for r in found:
        if r["sequence_id"] < 4:
            first[r["queue"]] += r["length"]
    assert first["s:a"] == 3 * first["s:b"]
    many = pack_documents(df, PATH, 1).collect()
    assert sum(r["length"] for r in many) == sum(r["length"] for r in found)
    assert pack_documents(df.limit(0), PATH, 1).count() == 0


@pytest.mark.parametrize("few", [0, 3, 64])
def test_schedule_of_many_queues(monkeypatch, few):
    monkeypatch.setattr("recordlens.llm.packing.FEW_QUANTA", few)
    rng = np.random.default_rng(few)
    lengths = [*rng.integers(0, 100, 300).tolist(), *[64] * 20, 5000, 3000]
    for weights in ([float(max(x, 1)) for x in lengths], [float(1 + i % 3) for i in range(len(lengths))]):
        s = Schedule(lengths, weights, 64, 16)
        want = sorted((s.due(q, i), q, i) for q in range(len(lengths)) for i in range(s.full[q]))
        got = s.rank(np.array([q for _, q, _ in want]), np.array([i for _, _, i in want]))
        assert got.tolist() == list(range(len(want)))


@pytest.mark.parametrize("n", [256, 257, 300])
def test_every_source_keeps_its_target(spark, n):
    rows = [(i, "the cat sat on the mat " * 60, "ab"[i % 2]) for i in range(60)]
    rows += [(100 + i, "a tail", f"tail{i}") for i in range(n - 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    found = pack_documents(df, PATH, 1, targets={"a": 3.0, "b": 1.0}).collect()
    first = collections.Counter()
    for r in found:
        if r["sequence_id"] < 4:
            first[r["queue"]] += r["length"]
    assert first["s:a"] == 3 * first["s:b"] and len({r["queue"] for r in found}) == n
    by_doc = collections.Counter()
    for r in found:
        by_doc[r["doc_id"]] += r["length"]
    assert all(by_doc[r["doc_id"]] == r["doc_tokens"] for r in found) and len(by_doc) == len(rows)
