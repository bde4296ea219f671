import random

import pytest

from recordlens.llm.suffix_dedup import dedup_substrings

SCHEMA = "doc_id long, text string, kept string"


def brute(docs, length):
    """docs in order; removed byte positions by a dictionary of first starts."""
    seen, out = {}, []
    for d, text in enumerate(docs):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if seen.setdefault(w, (d, i)) != (d, i):
                gone[i : i + length] = b"\1" * length
        spans, i = [], 0
        while i < len(raw):
            if gone[i]:
                j = i
                while j < len(raw) and gone[j]:
                    j += 1
                spans.append((i, j))
                i = j
            else:
                i += 1
        out.append((len(raw), spans, bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["alpha", "bé", "gamma delta", "x", "yy", "ñandú", "\n", "  ", "0" * 7]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(6)]
    docs = [None, "", "a" * 500, "ab" * 300, "short"]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(passages)
            if rng.random() < 0.5:
                i = rng.randrange(len(p))
                p = p[:i] + rng.choice(words) + p[i + rng.randint(0, 3) :]
            parts.append(p + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 150))))
        docs.append(" ".join(parts))
    docs += docs[5:12]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed, together", [(1, 2048), (2, 2048), (3, 1)])
def test_equals_brute_force(spark, seed, together):
    docs = corpus(seed)
    rows = [(i * 3, t, "clash") for i, t in enumerate(docs)]
    df = spark.createDataFrame(random.Random(0).sample(rows, len(rows)), SCHEMA)
    got = {r["doc_id"]: r for r in dedup_substrings(df, together=together).collect()}
    assert len(got) == len(rows)
    for (doc_id, _, _), (n, spans, kept) in zip(rows, brute(docs, 100)):
        r = got[doc_id]
        assert (r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) == (n, spans, kept)


def test_nulls_repeats_and_empty_table(spark):
    text = "".join(chr(97 + (i * i) % 26) for i in range(300))
    other = "".join(chr(97 + (i * 7 + i // 26) % 26) for i in range(200))
    rows = [(None, text, ""), (5, text, ""), (5, other, ""), (5, other, ""), (7, None, None)]
    got = dedup_substrings(spark.createDataFrame(rows, SCHEMA)).collect()
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0, bytes(r["kept"]).decode()) for r in got)
    docs = sorted([text, other, other])
    want = [(n, k.decode()) for n, _, k in brute([*docs, None, text], 100)]
    assert kept == sorted(
        [(False, 5, k) for _, k in want[:3]] + [(False, 7, "")] + [(True, 0, want[4][1])]
    )
    assert dedup_substrings(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_text_is_cut_into_stretches(spark, monkeypatch):
    rng = random.Random(5)
    long = "".join(rng.choice("abcd ") for _ in range(4_300_000))
    piece = long[1_048_500:1_048_700]
    got = {
        r["doc_id"]: r for r in dedup_substrings(
            spark.createDataFrame([(1, long, ""), (2, "zz" + piece + "yy", "")], SCHEMA)
        ).collect()
    }
    assert bytes(got[2]["kept"]) == b"zzyy" and got[1]["spans"] == []
