import re

import numpy as np
import pyarrow as pa

from recordlens.llm.common import block_of
from recordlens.llm.quality import (
    ABUSE_LABELLERS, ABUSIVE, FUNCTION_WORDS, HARMFUL_WISHES, INSULTING_ADJECTIVES, INSULTING_NOUNS, LABELLERS, abuse_measures, features, fit,
    fit_scorer, fit_weak_labels, keep_good, measures, score_documents, votes,
)

SCHEMA = "doc_id long, text string, score string"


def plain_measures(t):
    raw = t.encode()
    w = raw.split()
    n = max(len(w), 1)
    lines = [x for x in raw.split(b"\n") if x]
    upper = sum(65 <= b < 91 for b in raw)
    letters = upper + sum(97 <= b < 123 or b > 127 for b in raw)
    sym = sum(not (chr(b).isalnum() and b < 128 or b > 127 or b in b" \t\n\r\x0b\x0c.,;:'\"!?-()") for b in raw)
    known = {x.encode() for x in FUNCTION_WORDS.split()}
    return {
        "symbols": sym / max(len(raw), 1), "capitals": upper / max(letters, 1), "bars": raw.count(b"|") / n,
        "repeats": sum(a == b for a, b in zip(w, w[1:])) / n, "distinct": len(set(w)) / n, "cries": raw.count(b"!") / n,
        "word_length": sum(map(len, w)) / n, "function_words": sum(x in known for x in w) / n,
        "lines": len(set(lines)) / max(len(lines), 1),
    }


TEXTS = ["", "a", "the the THE\nthe é|x !!", "\n\n", "one two\n\none two\nthree", "A### b*** | c", "x" * 500, " lead and trail ", "der Ñandú\tist 12,5"]


def test_measures_equal_a_plain_count():
    found, words, lines = measures(block_of(pa.array([*TEXTS, None])))
    for i, t in enumerate([*TEXTS, ""]):
        for k, v in plain_measures(t).items():
            assert abs(found[k][i] - v) < 1e-12, (t, k)
        assert words[i] == len(t.encode().split()) and lines[i] == sum(bool(x) for x in t.split("\n"))


def test_expectation_maximisation_finds_the_accuracies():
    rng = np.random.default_rng(0)
    bad = rng.random(200_000) < 0.2
    right = [0.95, 0.9, 0.8, 0.7]
    pattern = np.zeros(len(bad), np.int64)
    for k, p in enumerate(right):
        vote = np.where((rng.random(len(bad)) < p) == bad, 2, 1) * (rng.random(len(bad)) < 0.9)
        pattern += vote * 3**k
    patterns, counts = np.unique(pattern, return_counts=True)
    model = fit_weak_labels(patterns, counts.astype(float), 4)
    assert abs(model.bad - 0.2) < 0.02
    assert np.abs(model.accuracies() - right).max() < 0.02


def test_scorer_separates():
    rng = np.random.default_rng(1)
    x = rng.random((500, 20)).astype(np.float32)
    y = (x[:, 3] > x[:, 5]).astype(float)
    w = fit_scorer(x, y, steps=500)
    assert ((x @ w[:-1] + w[-1] > 0) == (y > 0.5)).mean() > 0.95
    assert features(block_of(pa.array(["", "ab", "abc"]))).shape == (3, 2048)


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r["doc_id"]: r for r in score_documents(docs).collect()}
    assert len(got) == docs.count()
    # The labels are used here only, not in training.
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    # The score of writing is right for all; whether a document stays also depends on abuse.
    good = [got[r["doc_id"]]["score"] < 0.5 for r in labels if r["quality"] == 1]
    bad = [got[r["doc_id"]]["score"] < 0.5 for r in labels if r["quality"] == 0]
    stays = [got[r["doc_id"]]["keep"] for r in labels if r["quality"] == 1 and r["toxic"] == 0]
    assert sum(stays) / len(stays) > 0.99
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.05
    model, _ = fit(docs)
    assert len(model.accuracies()) == len(LABELLERS)


def test_edge_rows(spark):
    rows = [(1, None, "x"), (1, "", "x"), (None, "fine words and more of the same in a line", "x"), (2, "### *** " * 5000, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert score_documents(df).count() == 4
    assert keep_good(df).columns == df.columns
    assert score_documents(df.limit(0)).count() == 0 and keep_good(df.limit(0)).count() == 0
    assert votes(block_of(pa.array([None], pa.string()))).tolist() == [votes(block_of(pa.array([""]))).tolist()[0]]


INSULTS = ["", "You IDIOT, you Moron!", "idiotic idiots' idiot_idiot trash-can", "Un crétin, CRÉTIN; die die hate", "I hate to die", "clownfish " * 40 + "clown"]


def test_abuse_measures_equal_a_plain_count():
    nouns, adjectives, wishes = (set(x.split()) for x in (INSULTING_NOUNS, INSULTING_ADJECTIVES, HARMFUL_WISHES))
    found, words, _ = abuse_measures(block_of(pa.array([*INSULTS, None])))
    for i, t in enumerate([*INSULTS, ""]):
        small = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", small)
        bad = [x for x in w if x in nouns | adjectives]
        assert words[i] == len(w)
        assert found["nouns"][i] == len(set(w) & nouns) and found["adjectives"][i] == len(set(w) & adjectives)
        assert found["insults"][i] == len(bad) and abs(found["insult_share"][i] - len(bad) / max(len(w), 1)) < 1e-12
        assert found["wishes"][i] == (sum(x in wishes for x in w) if bad else 0)


def test_well_written_abuse_goes_and_a_quotation_stays(spark):
    rng = np.random.default_rng(5)
    plain = "the of and to in that is with".split() * 20 + [a + b for a in "bar ten lor min sal ped vir con".split() for b in "der ing mal on at est ur il".split()] * 4

    def prose(n):
        return " ".join(rng.choice(plain, n)) + "."

    clean = [(i, prose(120), "x") for i in range(180)]
    abuse = [(200 + i, f"{prose(60)} You are a worthless idiot and a pathetic loser. {prose(60)}", "x") for i in range(20)]
    quoted = [(300, f"{prose(100)} He was once called a fool. {prose(100)}", "x"), (301, prose(100) + " Put the trash out.", "x")]
    df = spark.createDataFrame([*clean, *abuse, *quoted], SCHEMA)
    assert sorted(r["doc_id"] for r in keep_good(df).collect()) == [*range(180), 300, 301]
    # Without any abuse in the table nobody is accused of it.
    assert keep_good(spark.createDataFrame(clean, SCHEMA)).count() == 180


def test_abuse_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    insulting = {r["doc_id"] for r in docs.collect() if r["text"] and re.search(r"\b(idiot|moron|worthless|pathetic|stupid|scum)\b", r["text"].lower())}
    kept = {r["doc_id"] for r in keep_good(docs).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    toxic = [r["doc_id"] for r in labels if r["toxic"] == 1 and r["doc_id"] in insulting]
    clean = [r["doc_id"] for r in labels if r["toxic"] == 0 and r["quality"] == 1]
    assert toxic and sum(d in kept for d in toxic) / len(toxic) < 0.05 and sum(d in kept for d in clean) / len(clean) > 0.99
    model, _ = fit(docs, trait=ABUSIVE)
    assert len(model.accuracies()) == len(ABUSE_LABELLERS)
