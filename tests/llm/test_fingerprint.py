import hashlib
import random

import pytest

from recordlens.llm.fingerprint import delete, fingerprint, fingerprint_documents, insert, likeness_of

SCHEMA = "doc_id long, text string, fingerprint string"


def sample(n, seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    return ["\n".join(" ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 9))) for _ in range(n)]


def test_multiset_of_paragraphs():
    a, b, c = "one two three four", "five six", "seven eight nine ten eleven"
    fp = fingerprint(f"{a}\n{b}\n{a}")
    assert fp == fingerprint(f"{b}\n\n{a}\n {a} ") != fingerprint(f"{a}\n{b}")
    assert insert(fp, c) == fingerprint(f"{c}\n{a}\n{a}\n{b}")
    assert delete(insert(fp, c), a) == fingerprint(f"{a}\n{b}\n{c}")
    assert fingerprint(None) == fingerprint("") == delete(fingerprint(a), a)
    assert likeness_of(fp, fp) == 1.0 and likeness_of(fingerprint(""), fingerprint(None)) == 1.0


def test_likeness_follows_what_is_shared():
    texts = [t for t in sample(120, 3) if len(t) > 400]
    for s, t in zip(texts, texts[1:]):
        lines = s.split("\n")
        assert likeness_of(fingerprint(s), fingerprint(t)) < 0.35
        words = [len(x.split()) for x in lines]
        most = "\n".join(lines[:-1])
        share = 1 - words[-1] / sum(words) / 2
        assert abs(likeness_of(fingerprint(s), fingerprint(most)) - share) < 0.3


@pytest.mark.parametrize("parts", ["1", "8"])
def test_equals_brute_force(spark, parts):
    texts = [None, "", "a", "ab", "äöü\nß"] + sample(150)
    rows = [((i * 29) % 1009, t, "x") for i, t in enumerate(texts)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r["doc_id"]: r for r in fingerprint_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for (doc_id, text, _), (_, other, _) in zip(order, order[1:] + order[:1]):
        text, other = text or "", other or ""
        n = len(text) // 2
        edited = text[: len(text) - n] + other[:n]
        r = got[doc_id]
        assert r["n_chars"] == len(text) and r["edited_text_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fingerprint(text) and r["edited_fingerprint"] == fingerprint(edited)
        assert r["near_edited"] == likeness_of(fingerprint(text), fingerprint(edited))
        assert r["near_next"] == likeness_of(fingerprint(text), fingerprint(other))


def test_nulls_repeats_and_small_tables(spark):
    rows = [(None, "n m", ""), (3, "b b", ""), (3, "a a", ""), (3, "a a", ""), (9, "long text here", "")]
    got = fingerprint_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 5 and sum(r["doc_id"] is None for r in got) == 1
    one = fingerprint_documents(spark.createDataFrame([(1, "abcd", "")], SCHEMA)).first()
    assert one["edited_text_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1.0
    assert fingerprint_documents(spark.createDataFrame([], SCHEMA)).count() == 0
