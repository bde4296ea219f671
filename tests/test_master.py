import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordlens.functions.ranking import places_in_groups
from recordlens.operators import master as M
from recordlens.operators import wide as N

KEY = "予算事業ID"


def children(spark):
    rows = [
        (1, "s", 2024, "n", 2, 5, "x"), (1, "s", 2024, "n", 1, None, "y"), (2, "s", 2024, "n", 1, None, None),
        (3, "s", 2024, "n", 1, 7, None), (9, "s", 2024, "n", 1, 1, "z"), (None, "s", 2024, "n", 1, 1, "q"),
    ]
    schema = f"`{KEY}` long, `シート種別` string, `事業年度` int, `事業名` string, pos int, a long, b string"
    return spark.createDataFrame(rows, schema)


def test_nested_records_leave_out_header_nulls_and_empty(spark):
    df = children(spark).drop("pos")
    child = M.Child(df, ("a", "b"))
    nested = M.nest_children(df, KEY, child)
    got = {r[KEY]: r["j"] for r in nested.select(KEY, F.to_json("records").alias("j")).collect()}
    assert {k: json.loads(v) for k, v in got.items()} == {
        1: [{"b": "y"}, {"a": 5, "b": "x"}], 3: [{"a": 7}], 9: [{"a": 1, "b": "z"}],
    }


def test_master_counts_flags_and_order(spark):
    base = spark.createDataFrame([(1, "p1", 0), (1, "later", 1), (2, "p2", 0), (3, "p3", 0), (4, "p4", 0)], f"`{KEY}` long, name string, row int")
    unit = spark.createDataFrame([(1, "u", "no"), (3, "w", "no")], f"`{KEY}` long, unit string, name string")
    df = children(spark).drop("pos")
    got = M.build_master(base, KEY, ["row"], [(unit, ["unit"])], {"c": M.Child(df, ("a", "b"))})
    rows = {r[KEY]: r for r in got.collect()}
    assert sorted(rows) == [1, 2, 3, 4]
    assert rows[1]["name"] == "p1" and rows[1]["unit"] == "u" and rows[2]["unit"] is None
    assert {k: r["c_count"] for k, r in rows.items()} == {1: 2, 2: 0, 3: 1, 4: 0}
    assert rows[2]["c"] is None and not rows[2]["has_c"] and rows[1]["total_related_records"] == 2


def test_large_entity_goes_on_in_further_rows(spark):
    base = spark.range(3).withColumnRenamed("id", "k")
    rows = spark.range(500).selectExpr("case when id < 450 then 0 else 1 end as k", "id as pos", "id * 2 as v")
    child = M.Child(rows, ("pos",), drop=())
    got = M.build_master(base, "k", ["k"], [], {"c": child}, limit=100).collect()
    entities = {r["k"]: r for r in got if r["chunk"] == 0}
    assert {k: r["c_count"] for k, r in entities.items()} == {0: 450, 1: 50, 2: 0}
    assert [x["pos"] for x in entities[1]["c"]] == list(range(450, 500)) and entities[2]["c"] is None
    more = sorted((r["chunk"], [x["pos"] for x in r["c"]], r["child"]) for r in got if r["chunk"])
    assert [c for c, _, _ in more] == [1, 2, 3, 4] and {n for _, _, n in more} == {"c"}
    assert [x["pos"] for x in entities[0]["c"]] + sum((p for _, p, _ in more), []) == list(range(450))
    nested = M.nest_children(rows, "k", child, 100).collect()
    assert {(r["k"], r["chunk"], r["chunks"], r["record_count"]) for r in nested} == {(1, 0, 1, 50), *((0, c, 5, 100 if c < 4 else 50) for c in range(5))}
    assert M.large_keys(rows, "k", 100).collect() == [(0, 450)]


def test_a_hot_key_is_spread_without_being_named(spark):
    """Half of all rows have one key: their places come from a range partitioning, and no task has much more than its share."""
    n = 40_000
    rows = spark.range(n).selectExpr("case when id % 2 = 0 then -1 else id % 4000 end as k", "(id * 7919) % 40000 as pos", "repeat('x', 30) as v")
    hot = M._hot_keys(rows, "k", 1_000)
    assert hot.collect() == [(-1, n // 2)]
    # Small partitions stay apart, to be seen.
    small = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "0"}
    before = {c: spark.conf.get(c) for c in small}
    for c, v in small.items():
        spark.conf.set(c, v)
    try:
        spread = places_in_groups(rows, ["k"], ["pos"], hot, "_place").filter("k = -1")
        assert [r["_place"] for r in spread.orderBy("pos").collect()] == list(range(n // 2))
        sizes = sorted(r["n"] for r in spread.groupBy(F.spark_partition_id().alias("f")).agg(F.count(F.lit(1)).alias("n")).collect())
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert len(sizes) > 4 and sizes[-1] < 2 * sizes[len(sizes) // 2]
    nested = M.nest_children(rows, "k", M.Child(rows, ("pos",), drop=()), 1_000)
    got = {(r["k"], r["chunk"]): r for r in nested.collect()}
    assert len(got) == 20 + 2_000 and {r["chunks"] for (k, _), r in got.items() if k != -1} == {1}
    whole = [x["pos"] for c in range(20) for x in got[-1, c]["records"]]
    assert whole == sorted(whole) and len(whole) == n // 2 and got[-1, 0]["chunks"] == 20
    ids = spark.createDataFrame([(-1,), (1,)], "k long")
    wide = N.wide_extract([N.WideTable("x", rows, "k", ("pos",))], "k", ids, limit=1_000).filter("k = -1").orderBy("part").collect()
    assert [r["part"] for r in wide] == list(range(20))
    assert " | ".join(r["x_pos"] for r in wide) == " | ".join(str(p) for p in whole) and wide[0]["x_v"] == "x" * 30


def test_one_scan_and_one_shuffle_per_child(spark, tmp_path):
    path = str(tmp_path / "c")
    spark.range(50).selectExpr("id % 7 as k", "id as pos").write.parquet(path)
    rows = spark.read.parquet(path)
    plan = M.nest_children(rows, "k", M.Child(rows, ("pos",), drop=()))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1 and "Broadcast" not in plan


def test_small_keys_of_several_chunks_take_one_shuffle(spark, tmp_path):
    """A low limit makes many chunks but no hot keys: no range partitioning and no second shuffle of the records."""
    path = str(tmp_path / "c")
    spark.range(50).selectExpr("id % 7 as k", "id as pos").write.parquet(path)
    rows = spark.read.parquet(path)
    nested = M.nest_children(rows, "k", M.Child(rows, ("pos",), drop=()), limit=3)
    plan = nested._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "hashpartitioning(k" in plan
    got = {(r["k"], r["chunk"]): r for r in nested.collect()}
    for k in range(7):
        whole = list(range(k, 50, 7))
        parts = [whole[i : i + 3] for i in range(0, len(whole), 3)]
        assert [[x["pos"] for x in got[k, c]["records"]] for c in range(len(parts))] == parts
        assert {(got[k, c]["chunks"], got[k, c]["record_count"]) for c in range(len(parts))} == {(3, 3), (3, len(parts[-1]))}
    assert len(got) == 21
    # The same with keys of more than 7 records spread by place.
    spread = M.nest_children(rows, "k", M.Child(rows, ("pos",), drop=()), limit=3, spread=7)
    assert sorted(spread.collect()) == sorted(nested.collect())


def test_unnest_skips_what_is_no_record(spark):
    texts = ["[]", "null", None, '{"k":1}', "[1]", "[{", '[{"k":1,"y":"a"},{"k":2.5}, 3, null]', "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, js string")
    maps = M.unnest_records(df, "id", "js").collect()
    assert [(r["id"], r["record"]) for r in maps] == [(6, {"k": "1", "y": "a"}), (6, {"k": "2.5"})]
    schema = T.StructType([T.StructField("k", T.DoubleType())])
    assert [r["record"]["k"] for r in M.unnest_records(df, "id", "js", schema).collect()] == [1.0, 2.5]


def test_small_entities_of_several_parts_take_one_shuffle(spark, tmp_path):
    """Places that tie, null places and values, and a low limit: as with spread entities, and values are not shuffled again."""
    path = str(tmp_path / "c")
    rows = [(i % 5, [i // 10, None][i % 13 == 0], [f"v{i * 7 % 6}", None, "nan"][i % 11 // 9], i * 3 % 4) for i in range(90)]
    spark.createDataFrame([*rows, (7, 1, None, None), (None, 1, "x", 1)], "k long, pos int, t string, n long").write.parquet(path)
    t = N.WideTable("x", spark.read.parquet(path), "k", ("pos",))
    ids = spark.createDataFrame([(0,), (1,), (2,), (3,), (7,), (9,)], "k long")
    small, large = N.wide_table(t, "k", ids, limit=2), N.wide_table(t, "k", ids, limit=2, held=0)
    plan = N.wide_table(t, "k", F.broadcast(ids), limit=2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in plan
    assert small.dtypes == large.dtypes
    got = sorted(map(tuple, small.collect()), key=str)
    assert got == sorted(map(tuple, large.collect()), key=str) and {r[1] for r in got} == set(range(5)) and {r[0] for r in got} == {0, 1, 2, 3, 7}


def test_wide_values_in_first_seen_order(spark):
    df = spark.createDataFrame(
        [(1, 1, "b", 2.0), (1, 2, "a", None), (1, 3, "b", 1.0), (1, 4, "nan", 2.0), (2, 1, "", None)],
        "k long, pos int, t string, n double",
    )
    ids = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    wide = N.wide_extract([N.WideTable("x", df, "k", ("pos",))], "k", ids)
    rows = {r["k"]: r for r in wide.collect()}
    assert rows[1]["x_t"] == "b | a" and rows[1]["x_n"] == "2.0 | 1.0" and rows[1]["x_pos"] == "1 | 2 | 3 | 4"
    assert rows[2]["x_t"] == "" and rows[3]["x_pos"] == ""
    split = N.wide_extract([N.WideTable("x", df, "k", ("pos",))], "k", ids, limit=3).collect()
    parts = {(r["k"], r["part"]): r for r in split}
    assert sorted(parts) == [(1, 0), (1, 1), (2, 0), (3, 0)]
    assert parts[1, 0]["x_pos"] == "1 | 2 | 3" and parts[1, 1]["x_pos"] == "4" and parts[1, 1]["x_t"] is None
