from pyspark.sql import functions as F

from recordlens.operators import amounts as A
from recordlens.operators import cohorts as C
from recordlens.operators import describe as D
from recordlens.operators import keys as K
from recordlens.operators import profile as R


def keyed(spark):
    t1 = spark.range(1, 101).withColumnRenamed("id", "k")
    t2 = spark.range(1, 97).selectExpr("id as k").union(spark.sql("select null"))
    t3 = spark.range(1, 51).selectExpr("id as k").union(spark.range(1, 11).selectExpr("id as k"))
    return {"t1": (t1, "k"), "t2": (t2, "k"), "t3": (t3, "k")}


def test_keys(spark):
    counts = K.key_counts(keyed(spark))
    card = {r["table_name"]: r for r in K.key_cardinality(counts).collect()}
    assert (card["t1"]["rows_per_key"], card["t3"]["rows_per_key"], card["t2"]["null_keys"]) == (1.0, 1.2, 1)
    assert card["t1"]["max_key"] == 100  # numeric, not by text
    cover = {r["table_name"]: r for r in K.key_coverage(counts, ["t1", "t2", "t3"]).collect()}
    assert [cover[t]["coverage_pct"] for t in ("t1", "t2", "t3")] == [100.0, 96.0, 50.0]
    kinds = K.relationship_class(
        K.key_cardinality(counts), K.key_coverage(counts, ["t1", "t2", "t3"]),
        {"t1": "base", "t2": "base", "t3": "other"}, "base",
    )
    got = {r["table_name"]: (r["relationship"], r["is_master"], r["risk_level"]) for r in kinds.collect()}
    assert got == {"t1": ("1:1", True, "medium"), "t2": ("1:1", False, "medium"), "t3": ("1:N", False, "medium")}


def test_missing_samples_in_numeric_order(spark):
    a, b = spark.range(1, 20).withColumnRenamed("id", "k"), spark.range(1, 9).withColumnRenamed("id", "k")
    assert tuple(K.missing_ids(a, b, "k").first()) == (11, "9, 10, 11, 12, 13")
    assert tuple(K.missing_ids(b, a, "k").first()) == (0, "")


def test_outer_join_keeps_both_copies(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k long, v string")
    rows = {tuple(r) for r in K.outer_join_common_keys([a, b], ["k"]).collect()}
    assert rows == {(1, "x", None), (2, "y", "z"), (3, None, "w")}


def test_year_mode_takes_smallest(spark):
    df = spark.createDataFrame([("2001",), ("1999",), ("2001",), ("1999",), ("x",), (None,), ("2005",)], "y string")
    row = D.start_year_stats(df, "y").first()
    assert (row["mode_year"], row["n"], row["min_year"], row["median_year"]) == (1999, 5, 1999, 2001.0)


def test_year_record_fallbacks(spark):
    rows = [
        (1, 2024, 1, 10.0), (1, 2024, 2, 20.0), (1, 2023, 3, 5.0), (2, 2022, 1, 7.0), (2, 2023, 2, 8.0),
        (3, 2022, 1, 0.0), (3, 2023, 2, None), (4, 2024, 1, None), (4, 2022, 2, 9.0),
    ]
    df = spark.createDataFrame(rows, "k int, y int, pos int, amt double")
    first = {r["k"]: (r["y"], r["amt"]) for r in A.pick_year_first(df, "k", "y", 2024, ["pos"]).collect()}
    assert first == {1: (2024, 10.0), 2: (2022, 7.0), 3: (2022, 0.0), 4: (2024, None)}
    summed = {r["k"]: r["amt"] for r in A.pick_year_sum(df, "k", "y", 2024, ["pos"], "amt", []).collect()}
    assert summed == {1: 20.0, 2: 15.0, 3: 0.0, 4: 0.0}


def test_top_list_with_ties_and_zero(spark):
    df = spark.createDataFrame([(i, 0.0 if i < 5 else float(min(i, 98))) for i in range(105)], "id long, amt double")
    top = A.top_percent_list(df, "amt", "id", [], pct=5.0).collect()
    assert [r["id"] for r in sorted(top, key=lambda r: r["rank"])] == list(range(98, 105))
    assert all(r["amt"] == 98.0 for r in top)


def test_recipients(spark):
    rows = [(1, " a ", "x", 3.0), (1, "a", "y", 1.0), (1, "b", "x", 4.0), (1, "", "x", 9.0), (2, None, "x", 1.0), (3, "c", None, None)]
    df = spark.createDataFrame(rows, "k int, who string, how string, amt double")
    got = {r["k"]: r for r in D.recipient_diversity(df, "k", "who", "how", "amt").collect()}
    assert sorted(got) == [1, 3]
    assert (got[1]["recipients"], got[1]["contract_types"], got[1]["amount"]) == (2, 2, 17.0)
    assert got[1]["hhi_equal"] == 0.5 and got[1]["hhi_amount"] == 0.5
    assert (got[3]["contract_types"], got[3]["amount"], got[3]["hhi_amount"]) == (0, 0.0, None)


def test_tiers_add_up(spark):
    df = spark.range(1000).selectExpr("id % 97 as total", "id % 13 as a", "id % 7 as g")
    tiered = C.with_tier(C.complexity_score(df, ["total", "a"]))
    rows = C.complexity_tiers(tiered, "total").collect()
    assert sum(r["n"] for r in rows) == 1000 and abs(sum(r["pct"] for r in rows) - 100) < 1e-9
    assert {r["tier"] for r in rows} == set(C.TIERS)


def test_profiles_on_odd_columns(spark):
    df = spark.createDataFrame([("1", None, "a", 1), ("2", None, None, 2), ("x", None, "a", 3)], "m string, e string, t string, o int")
    for how in ({}, {"order": ["o"], "sample": 100}):
        kinds = {r["column"]: r["kind"] for r in R.infer_column_kind(df, **how).collect()}
        assert kinds == {"m": "text", "e": "empty", "t": "text", "o": "numeric"}
    late = spark.range(300).selectExpr("if(id = 299, 'x', '1') as v", "id as o")
    assert [R.infer_column_kind(late.select("v", "o"), *a).first()["kind"] for a in ((), (["o"], 100))] == ["text", "numeric"]
    assert kinds == {"m": "text", "e": "empty", "t": "text", "o": "numeric"}
    cats = {r["column"]: r for r in R.profile_categorical(df).collect()}
    assert (cats["e"]["distinct_values"], cats["e"]["null_count"], cats["e"]["top_values"]) == (0, 3, None)
    assert cats["t"]["top_values"] == "a:2"
    nulls = {r["column"]: r["null_pct"] for r in R.profile_nulls(df).collect()}
    assert nulls == {"e": 100.0, "t": 33.33}
    assert abs(R.approx_distinct(spark.range(5000), ["id"]).first()["distinct_values"] - 5000) < 400


def test_flags_take_the_last_name_on_ties(spark):
    df = spark.createDataFrame([(1, "1"), (0, "0")], "a int, b string")
    got = {r["flag"]: (r["n"], r["pct"], r["is_top"]) for r in D.flag_frequency(df, ["a", "b"]).collect()}
    assert got == {"a": (1, 50.0, False), "b": (1, 50.0, True)}


def test_categorical_profile_of_many_and_few_values(spark):
    """Columns of many values are counted by hash, with the same numbers as by value."""
    df = spark.range(3_000).selectExpr(
        "cast(id as string) as unique", "case when id % 3 = 0 then null else concat('long ', repeat('x', 50), id % 1500) end as some",
        "cast(id % 150 as string) as middle", "case when id < 10 then 'a' when id % 2 = 0 then 'b' end as few", "cast(null as string) as none",
    )
    assert R.many_valued(df, df.columns) == ["unique", "some"]
    got = {r["column"]: r for r in R.profile_categorical(df).collect()}
    for c in df.columns:
        values = [r[0] for r in df.select(c).collect()]
        known = {v for v in values if v is not None}
        assert (got[c]["distinct_values"], got[c]["null_count"]) == (len(known), values.count(None)), c
    assert got["few"]["top_values"] == "b:1495, a:10" and got["unique"]["top_values"] is None and got["middle"]["top_values"] is None
    only = R.profile_categorical(df, ["unique"]).collect()
    assert [(r["column"], r["distinct_values"], r["top_values"]) for r in only] == [("unique", 3_000, None)]
    plan = R.distinct_by_hash(df, ["some"])._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan
