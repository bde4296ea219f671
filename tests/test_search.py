import re

import pytest
from pyspark.sql import functions as F

from recordlens.functions import terms as T
from recordlens.operators import search as X

TEXTS = [
    "生成AI", "AI活用", "ＡＩ", "ａｉ", "ＡＩ技術", "Thailand aid", "A.I.", "Ａ.Ｉ.", "the AI.", "", None,
    "AI AI,ai", "A.I.x", "deep LEARNING と Big data", "robotİcs", "ıot", "Smart ſmart", "LLM/ＬＬＭ",
    "自動化ロボット", "Bot bots bot", "AI_x", "AI9", "xＡＩx", "éAI", "AIé",
]
PATTERNS = (*T.BROAD_TERMS, *T.RELAXED_PATTERNS, *T.COMPOUND_PATTERNS, *T.EXACT_PATTERNS)


@pytest.fixture(scope="module")
def cells(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string")
    return X.text_cells([X.SearchTable("x", df, "id", ("t", "absent"))])


def test_terms_occur_as_in_python(cells):
    got = {(r["entity_id"], r["term"]) for r in X.search_terms(cells, {"f": PATTERNS}).collect()}
    want = {
        (i, p) for i, t in enumerate(TEXTS) if t for p in PATTERNS if re.search(p, t, re.IGNORECASE)
    }
    assert got == want


def test_occurrences_as_in_python(cells):
    patterns = (*T.RELAXED_PATTERNS, *T.COMPOUND_PATTERNS)
    got = {
        (r["entity_id"], r["pattern"], r["matched_text"], r["start"], r["end"])
        for r in X.search_occurrences(cells, patterns).collect()
    }
    want = {
        (i, p, m.group(), m.start(), m.end())
        for i, t in enumerate(TEXTS) if t for p in patterns for m in re.finditer(p, t, re.IGNORECASE)
    }
    assert got == want


def test_places_in_long_and_random_texts(spark):
    """Running sums over many groups of matches, letters of all kinds, and no Python worker for patterns both languages share."""
    import random

    rng = random.Random(9)
    letters = ["AI", "ai", "ＡＩ", "生成AI", "x", " ", "é", "é", "²", "½", "ア", "ン", "_", "9", "😀", "İ", "ı", ".", "A.I.", "Ａ.Ｉ.", "ſ", "K", "\n"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(150)] + ["AI x" * 20_000, "AI" * 65, "x" + "ai" * 64]
    cells = X.text_cells([X.SearchTable("x", spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", ("t",))])
    shared = (*T.RELAXED_PATTERNS, *T.COMPOUND_PATTERNS, "a[i_]?", "\\w+", "[éx\\w]+")
    assert all(X.placed_in_sql(p) for p in shared)
    found = X.search_occurrences(cells, shared)
    assert "Python" not in found._jdf.queryExecution().toString()
    assert not any(X.placed_in_sql(p) for p in (*T.EXACT_PATTERNS, "x*", "(a)b", "a|b", "[^a]", "\\d", "a{2}", "", "[a&&b]"))
    mixed = (*shared, T.EXACT_PATTERNS[2], "a|x")
    for patterns, df in ((shared, found), (mixed, X.search_occurrences(cells, mixed))):
        got = {(r["entity_id"], r["pattern"], r["matched_text"], r["start"], r["end"]) for r in df.collect()}
        want = {
            (i, p, m.group(), m.start(), m.end()) for i, t in enumerate(texts) for p in patterns for m in re.finditer(p, t, re.IGNORECASE)
        }
        assert got == want


def test_strict_matches_count_per_pattern(cells):
    got = {}
    for r in X.strict_matches(cells).collect():
        got[(r["entity_id"], r["pattern_no"])] = got.get((r["entity_id"], r["pattern_no"]), 0) + 1
    want = {}
    for i, t in enumerate(TEXTS):
        for n, p in enumerate(T.EXACT_PATTERNS):
            hits = [m for m in re.finditer(p, t or "", re.IGNORECASE) if m.group().upper() in T.EXACT_TEXTS]
            if hits:
                want[(i, n)] = len(hits)
    assert got == want


def test_families_nest(cells):
    families = {"current": T.CURRENT_PATTERNS, "relaxed": T.RELAXED_PATTERNS, "compound": T.COMPOUND_PATTERNS}
    row = X.compare_families(cells, families, "current").first()
    assert row["cells_checked"] == len([t for t in TEXTS if t])
    assert row["potential_total"] == row["current_entities"] + row["missed_total"]
    assert row["compound_entities"] <= row["relaxed_entities"]


def test_detail_of_a_large_entity_is_divided(spark):
    df = spark.range(300).selectExpr("7 as id", "id as pos", "'the AI' as t")
    cells = X.text_cells([X.SearchTable("x", df, "id", ("t",), "pos")])
    matches = X.strict_matches(cells)
    whole = X.match_detail(matches, ["x"]).collect()
    assert len(whole) == 1 and whole[0]["match_count"] == 600
    parts = X.match_detail(matches, ["x"], limit=100).collect()
    assert len(parts) == 6 and sum(r["match_count"] for r in parts) == 600
    assert sum(r["match_detail"].count("x.t: AI") for r in parts) == 600


def test_records_without_a_position_are_told_apart(spark):
    df = spark.createDataFrame([("7", "the AI"), ("7", "an AI"), ("7", "AI it is"), ("x9", "AI"), (None, "AI")], "id string, t string")
    got = X.strict_entities(X.text_cells([X.SearchTable("x", df, "id", ("t",))])).collect()
    assert [(r["entity_id"], r["records"]) for r in got] == [(7, 3)]


def test_key_alias():
    assert T.key_column(["a", "事業ID", "予算事業コード"]) == "予算事業コード"
    assert T.key_column(["a"]) is None


def test_plan_computes_bits_once(cells):
    plan = X.search_terms(cells, {"f": T.BROAD_TERMS})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Contains(_folded") > 0 and "Filter (" not in plan.split("_m0")[0]
