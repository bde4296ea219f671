"""The filter audit against a simulation of every order."""

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordlens.llm import filter_audit

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def failures(rows):
    out = []
    for i, text, source in rows:
        t = text or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
        }
        out.append((i, source or "", {k for k, v in fails.items() if v}))
    return out


def brute(rows, labels):
    docs = failures(rows)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out, shapley = [], Counter()
    for part in {p for _, p, _ in docs}:
        own = [(i, f) for i, p, f in docs if p == part]
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                shapley[part, x] += len(gone)
                out.append([
                    part, "".join(order), step, len(left), len(gone), sum(x in f for _, f in own) - len(gone), sum(f == {x} for _, f in own),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def audited(spark, rows, labels, **options):
    found = filter_audit.audit_filters(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS), **options)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return sorted(tuple(r) for r in found.collect())


def corpus(n):
    rng = np.random.default_rng(3)
    words = ["alpha", "Beta", "gamma", "d|lta", "Eps", "zeta\tEta", "x y", "ünder"]
    rows = []
    for i in range(n):
        k = int(rng.integers(0, 5))
        text = " ".join(f"w{j}" for j in range(210)) if k == 0 else " ".join(str(x) for x in rng.choice(words, int(rng.integers(0, 9)) * (40 if k == 1 else 1)))
        rows.append((i, text, ["a", "b", "", None][int(rng.integers(0, 4))] if i % 3 else "hot"))
    return rows + [(n + i, rows[i * 3 % n][1], "late") for i in range(12)]


@pytest.mark.parametrize("range_ids", [filter_audit.RANGE_IDS, 7])
def test_equals_simulation(spark, range_ids):
    rows = corpus(120)
    labels = [(i, int(i % 2 == 0), int(i % 5 == 0)) for i in range(0, 150, 2)]
    assert audited(spark, rows, labels, range_ids=range_ids) == brute(rows, labels)


def test_nulls_repeats_long_texts(spark):
    rows = [
        (1, None, None), (2, "", ""), (3, None, "p"), (None, "", "p"), (None, "Same", "p"), (4, "Same", "p"), (4, "Same", "p"), (4, "other", "q"),
        (5, "a " * 500_000, "p"), (6, "\t \n", "p"), (7, "x" * 1_000_000 + "#", "q"), (8, "Same", "q"),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (None, 1, 1), (4, 1, None), (5, None, 1), (99, 1, 1)]
    assert audited(spark, rows, labels) == brute(rows, labels)


def test_extra_columns_and_empty(spark):
    rows, labels = corpus(30), [(1, 1, 1)]
    docs = spark.createDataFrame(rows, DOCS).select("*", *[F.lit(1).alias(c) for c in ("part", "key", "A", "seal", "words", "good", "n")])
    marks = spark.createDataFrame(labels, LABELS).select("*", *[F.lit(1).alias(c) for c in ("text", "source", "good", "A", "part")])
    assert sorted(tuple(r) for r in filter_audit.audit_filters(docs, marks).collect()) == brute(rows, labels)
    assert filter_audit.audit_filters(docs.limit(0), marks).count() == 0
    assert audited(spark, rows, [(None, None, None)]) == brute(rows, [])


sorted_ids = st.lists(st.integers(0, 60), unique=True).map(sorted).map(lambda x: np.array(x, np.int64))


@settings(max_examples=200, deadline=None)
@given(st.lists(sorted_ids, min_size=1, max_size=5), sorted_ids)
def test_merges(lists, other):
    both = filter_audit.union(lists)
    assert both.tolist() == sorted(set().union(*(x.tolist() for x in lists)))
    assert both[filter_audit.within_list(both, other)].tolist() == sorted(set(both.tolist()) & set(other.tolist()))
