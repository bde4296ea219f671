import random

from pyspark.sql import functions as F

from recordlens.functions import ranking as R
from recordlens.functions import scalars as P


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_money_and_numbers(spark):
    texts = ["1,234円", "-5", "abc", "", "12兆", None, "0"]
    assert column(spark, texts, P.parse_money) == [1234.0, None, None, None, None, None, None]
    assert column(spark, texts, P.coerce_number) == [None, -5.0, None, None, None, None, 0.0]
    assert column(spark, texts, lambda c: P.coerce_number(c, 0.0)) == [0.0, -5.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    found = column(spark, ["1,234円と56", "なし", "９"], P.extract_numbers)
    assert found == [[1234.0, 56.0], [], []]
    assert column(spark, ["1,234円と56"], lambda c: P.extract_numbers(c, P.AMOUNT_RANGE)) == [[1234.0]]


def test_tiers_at_their_limits(spark):
    amounts = [1.0, 1e8, 1e9, 1e10, None]
    assert column(spark, amounts, P.size_tier, "double") == ["small", "medium", "large", "mega", None]
    assert column(spark, [1e10, 1e11, 1e12], P.top_list_tier, "double") == ["medium", "large", "mega"]
    assert column(spark, [5.0, 5.1, 10.0, 10.1], P.share_band, "double") == ["low", "mid", "mid", "high"]


def test_rate_without_amount(spark):
    df = spark.createDataFrame([(5.0, 0.0), (5.0, 10.0), (None, 10.0)], "e double, c double")
    got = [r[0] for r in df.select(P.execution_rate(F.col("e"), F.col("c"))).collect()]
    assert got == [0.0, 50.0, 0.0]


def test_null_policy_and_map_filter(spark):
    df = spark.createDataFrame([(None, None, "nan"), (float("nan"), "x", " "), (2.0, "", "ok")], "a double, b string, c string")
    got = P.null_policy(df, {"a": "zero", "b": "empty", "c": "missing", "z": "zero"}).collect()
    assert [tuple(r) for r in got] == [(0.0, "", None), (0.0, "x", None), (2.0, "", "ok")]
    m = spark.sql("select map('予算年度', '2024', '予算額', '5', '名', 'x') as m")
    assert m.select(P.field_key_filter(F.col("m"), ["予算"], ["年度"])).first()[0] == {"予算額": "5"}
    assert P.matching_fields(["予算年度", "予算額", "名"], ["予算"], ["年度"]) == ["予算額"]


def test_global_rank_with_ties(spark):
    rng = random.Random(3)
    rows = [(i, float(rng.randint(0, 40))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, v double").repartition(7)
    got = {r["id"]: r["rank"] for r in R.global_rank(df, [F.desc("v"), F.col("id")]).collect()}
    want = {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert got == want


def test_first_row_and_top_k(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 5, "c")], "k int, pos int, v string")
    assert {tuple(r) for r in R.dedupe_first(df, "k", ["pos"]).collect()} == {(1, 1, "a"), (2, 5, "c")}
    plan = R.dedupe_first(df, "k", ["pos"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
