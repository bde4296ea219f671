import pytest
from pyspark.sql import functions as F

from recordlens.functions.runtime import scratch_path
from recordlens.operators import profile as R
from recordlens.sources import columnar, csv

TABLE = "事業ID,名称,金額\n1,人工知能の研究,1000\n2,機械学習,2500\n3,支援事業,\n"
# Decodes in its own encoding only, once the wider ones are tried later.
ORDER = ("iso-2022-jp", "euc-jp", "utf-8", "shift-jis", "cp932", "utf-8-sig")


def write(tmp_path, name, encoding, text=TABLE):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return str(path)


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "shift_jis", "cp932", "euc-jp", "iso-2022-jp"])
def test_every_encoding_reads_the_same(spark, tmp_path, encoding):
    path = write(tmp_path, "1-1_x_基本_y.csv", encoding)
    order = {"euc-jp": ("euc-jp",), "iso-2022-jp": ("iso-2022-jp",)}.get(encoding, csv.ENCODINGS)
    rows = csv.read_csv_any_encoding(spark, [path], order).collect()
    assert [tuple(r) for r in rows] == [(1, "人工知能の研究", 1000), (2, "機械学習", 2500), (3, "支援事業", None)]


def test_first_encoding_that_decodes_wins(spark, tmp_path):
    paths = {
        "utf-8": write(tmp_path, "a.csv", "utf-8"),
        "shift-jis": write(tmp_path, "b.csv", "shift_jis"),
        # Characters only the vendor extension has.
        "cp932": write(tmp_path, "c.csv", "cp932", "a,b\n1,①髙\n"),
    }
    found = {r["path"].rsplit("/", 1)[1]: r["encoding"] for r in csv.detect_encodings(spark, list(paths.values())).collect()}
    assert found == {"a.csv": "utf-8", "b.csv": "shift-jis", "c.csv": "cp932"}


def test_mixed_encodings_and_columns(spark, tmp_path):
    a = write(tmp_path, "1-1_x_組織_y.csv", "utf-8")
    b = write(tmp_path, "5-1_x_支出_y.csv", "shift_jis", "事業ID,支出先\n1,会社\n")
    df = csv.read_csv_any_encoding(spark, [a, b], keep_source=True)
    category, part = csv.tag_source_category(F.col("source_file"))
    rows = {(r[0], r[1], r[2]) for r in df.groupBy(category, part).count().collect()}
    assert rows == {("基本情報", "組織", 3), ("支出先", "支出", 1)}
    assert df.filter("`支出先` is not null").count() == 1


def test_unreadable_file_is_named(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_bytes(b"a,b\n\x81 ,1\n")
    with pytest.raises(ValueError, match="bad.csv"):
        csv.read_csv_any_encoding(spark, [str(path)])


def test_name_list(spark, tmp_path):
    path = tmp_path / "names.txt"
    path.write_text("  一つ目 \n\n　全角空白　\n二つ目\n二つ目\n", encoding="utf-8")
    names = sorted(r["name"] for r in csv.read_name_list(spark, str(path)).collect())
    assert names == sorted(["一つ目", "全角空白", "二つ目", "二つ目"])


def test_narrowing_keeps_every_value(spark):
    df = spark.createDataFrame(
        [(1, 300, 2**40, 1.0, 0.5, 0.1, "7", None), (-128, -300, -(2**40), 200.0, None, 0.2, "8", None)],
        "a long, b long, c long, d double, e double, f double, t string, n double",
    )
    kinds = {f.name: f.dataType.simpleString() for f in columnar.narrow_numeric(df).schema.fields}
    assert kinds == {
        "a": "tinyint", "b": "smallint", "c": "bigint", "d": "smallint", "e": "float", "f": "double",
        "t": "string", "n": "double",
    }
    assert [tuple(r) for r in columnar.narrow_numeric(df).collect()] == [tuple(r) for r in df.collect()]


def test_audit_sees_one_changed_value(spark):
    raw = spark.range(100).selectExpr("id as a", "cast(id as string) as b")
    same = R.audit_conversion(raw, columnar.narrow_numeric(raw))
    assert [r["same_values"] for r in same.collect()] == [True, True]
    changed = raw.withColumn("b", F.when(F.col("a") == 50, "x").otherwise(F.col("b")))
    got = {r["column"]: r["same_values"] for r in R.audit_conversion(raw, changed).collect()}
    assert got == {"a": True, "b": False}


def test_nested_result_round_trip(spark):
    path = scratch_path(spark, "test")
    df = spark.sql("select 5L as entity_id, named_struct('name', 'x') as master_info union all select 6L, null")
    columnar.write_json(df, path)
    assert [tuple(r) for r in columnar.read_nested_json(spark, path).collect()] == [(5, "x")]


def test_csv_sink_writes_nested_as_json(spark):
    path = scratch_path(spark, "test")
    csv.write_csv(spark.sql("select 1 as id, array(named_struct('k', 'a\"b', 'n', null)) as r"), path, bom=True)
    files = spark.read.format("binaryFile").load(path).collect()
    assert [bytes(f["content"][:3]) for f in files if f["length"]] == [b"\xef\xbb\xbf"]
    row = csv.read_csv_any_encoding(spark, [path]).first()
    assert tuple(row) == (1, '[{"k":"a\\"b"}]')


def test_absent_tables_are_skipped(spark):
    found = columnar.read_columnar(spark, "/root/testdata/sf0.001", ["nation", "nowhere"])
    assert list(found) == ["nation"]


def test_quoted_line_breaks(spark, tmp_path):
    path = write(tmp_path, "q.csv", "shift_jis", 'id,文\n1,"二行の\n""引用"""\n2,一行\n')
    rows = csv.read_csv_any_encoding(spark, [path]).collect()
    assert [tuple(r) for r in rows] == [(1, '二行の\n"引用"'), (2, "一行")]


def test_every_file_keeps_its_own_header_and_types_are_joint(spark, tmp_path):
    a = write(tmp_path, "a.csv", "utf-8", 'id,name,amt\n1,"x\ny",10\n2,"say ""hi""",20\n')
    b = write(tmp_path, "b.csv", "utf-8", "id,amt,extra\n3,A,7\n")
    c = write(tmp_path, "c.csv", "shift_jis", "id,名\nAB,名前\n")
    df = csv.read_csv_any_encoding(spark, [a, b, c])
    rows = {r["id"]: r.asDict() for r in df.collect()}
    assert rows["1"]["name"] == "x\ny" and rows["2"]["name"] == 'say "hi"' and rows["1"]["amt"] == "10"
    assert rows["3"] == {"id": "3", "name": None, "amt": "A", "extra": 7, "名": None} and rows["AB"]["名"] == "名前"
    texts = csv.read_all_string(spark, [a, b])
    assert {r["extra"] for r in texts.collect()} == {None, "7"} and len(texts.collect()) == 3


def test_inferred_types(spark):
    rows = [("1", "3000000000", "1.5", "1995-01-02", "1995-01-02 03:04:05", "true", "007x", None), (None, "1", "2", None, None, "FALSE", "1", None)]
    df = csv.infer_types(spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string, g string, h string"))
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["int", "bigint", "double", "date", "timestamp", "boolean", "string", "string"]


def test_audit_accepts_whole_doubles_narrowed(spark):
    raw = spark.createDataFrame([(1.0, -0.0, 2.5, "x"), (200.0, None, 0.1, None)], "a double, b double, c double, t string")
    assert all(r["same_values"] for r in R.audit_conversion(raw, columnar.narrow_numeric(raw)).collect())
    changed = raw.withColumn("a", F.col("a") + F.when(F.col("a") == 1, 1).otherwise(0))
    assert {r["column"] for r in R.audit_conversion(raw, changed).collect() if not r["same_values"]} == {"a"}
