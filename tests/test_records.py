"""Quoted CSV files cut into blocks against Spark's own read of the whole file in one task."""

import csv as pycsv
import io
import random

import pytest
from pyspark.sql import functions as F

from recordlens.sources import csv, records


@pytest.fixture(params=[23, 150, 1 << 20])
def block_bytes(spark, request):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], str(request.param))
    spark.conf.set(names[1], "0")
    yield request.param
    for n, v in before.items():
        spark.conf.set(n, v)


def both(spark, path, charset="UTF-8"):
    options = {"header": True, "inferSchema": False, "encoding": charset, "quote": '"', "escape": '"', "multiLine": True}
    whole = spark.read.csv(str(path), **options)
    cut = records.read_quoted(spark, [str(path)], charset).drop("_path")
    assert cut.columns == whole.columns
    return sorted(map(repr, cut.collect())), sorted(map(repr, whole.collect()))


def written(rng, rows, end):
    out = io.StringIO()
    w = pycsv.writer(out, lineterminator=end, quoting=rng.choice([pycsv.QUOTE_MINIMAL, pycsv.QUOTE_ALL]))
    w.writerow(["id", "text", "more"])
    for i in range(rows):
        value = lambda: "".join(rng.choice(['"', ",", "\n", "a", "bc", "日本", "\n\n", '""', "é"]) for _ in range(rng.randrange(6)))
        w.writerow([i, "x" + value(), value() + "y"])
    return out.getvalue()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equals_the_read_in_one_task(spark, tmp_path, block_bytes, end):
    rng = random.Random(block_bytes)
    for k in range(3):
        path = tmp_path / f"{k}.csv"
        path.write_bytes(written(rng, 60, end).encode())
        cut, whole = both(spark, path)
        assert cut == whole and len(cut) == 60
    assert spark.read.text(str(path)).rdd.getNumPartitions() > (5 if block_bytes < 100 else 0)


def test_quotes_inside_plain_values_and_after_the_end(spark, tmp_path, block_bytes):
    path = tmp_path / "odd.csv"
    path.write_text('id,text,more\n1,5" pipe,"a\nb"\n2,"x ""y""\n""z""",q"\n3,"in"side,c\n4,,"\n"\n\n5,"",""\n6,a b,"last\nline, open')
    cut, whole = both(spark, path)
    assert cut == whole and len(cut) == 6


def test_records_over_many_blocks(spark, tmp_path, block_bytes):
    long = "line\n" * 200
    path = tmp_path / "long.csv"
    path.write_text(f'id,text\n1,"{long}"\n2,b\n3,"{long}{long}"\n4,"c\nd"\n')
    cut, whole = both(spark, path)
    assert cut == whole and len(cut) == 4


def test_other_encodings_and_sources(spark, tmp_path, block_bytes):
    text = "番号,文\n" + "".join(f'{i},"{"表示" * (i % 7)}\n""二行""{i}"\n' for i in range(40))
    paths = []
    for name in ("shift_jis", "utf-8", "cp932"):
        paths.append(tmp_path / f"{name}.csv")
        paths[-1].write_bytes(text.encode(name))
    df = csv.read_csv_any_encoding(spark, [str(p) for p in paths], keep_source=True)
    assert dict(df.dtypes)["番号"] == "int"
    got = {(r["source_file"], r["encoding"], r["番号"], r["文"]) for r in df.collect()}
    want = {(p.name, e, i, "表示" * (i % 7) + f'\n"二行"{i}') for p, e in zip(paths, ("shift-jis", "utf-8", "shift-jis")) for i in range(40)}
    assert got == want


def test_line_functions(spark):
    lines = ['a,b', '"a', 'b"', '"a""', '"a"""', 'x"', '"a",b"c', 'a","b', '"",""', '","', 'b",c,"d', "", '"a" ,"', 'a"b,"c']
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select(
        F.col("line").rlike(records.OPENS).alias("out"), F.col("line").rlike(records.STAYS_OPEN).alias("into")
    ).collect()

    def simulate(line, inside):
        start = True
        i = 0
        while i <= len(line):
            c = line[i : i + 1]
            if inside:
                if c == '"':
                    if line[i + 1 : i + 2] == '"':
                        i += 1
                    else:
                        inside, start = False, False
                elif c == "":
                    return True
            elif c == "":
                return False
            elif c == ",":
                start = True
            elif c == '"' and start:
                inside = True
            else:
                start = False
            i += 1
        return inside

    for x, r in zip(lines, rows):
        assert (r["out"], r["into"]) == (simulate(x, False), simulate(x, True)), x
    # A very long line does not exhaust the stack.
    big = spark.range(1).select(F.repeat(F.lit('"a""b",c,'), F.lit(100_000)).alias("line"))
    assert not big.select(F.col("line").rlike(records.OPENS)).first()[0]


def test_inference_equals_casts_of_every_value(spark):
    texts = ["1", " 2 ", "-3", "+4", "1.5", ".5", "1e5", "NaN", "inf", "-Infinity", "1d", "0x1p3", "2147483648", "9" * 19, "9" * 20, "true", " False ", "t", "",
             "2020-01-02", " 2020-1-2 ", "2020-13-01", "2020-01-02 03:04", "2020-01-02T03:04:05Z", "abc", "１", "1,000", "1 2", "\t7\n", "..", "--1", "yes", "　1"]
    types = ("int", "bigint", "double", "date", "timestamp", "boolean")
    rng = random.Random(4)
    groups = [[t] for t in texts] + [rng.sample(texts, 2) for _ in range(60)]
    for group in groups:
        df = spark.createDataFrame([(t,) for t in group] + [(None,)], "v string")
        v = F.col("v")
        fits = {
            **{t: v.try_cast(t).isNotNull() for t in types[:3]}, "date": v.rlike(csv._DATE) & v.try_cast("date").isNotNull(),
            "timestamp": v.rlike(csv._TIME) & v.try_cast("timestamp").isNotNull(),
            "boolean": v.try_cast("boolean").isNotNull() & F.lower(F.trim(v)).isin("true", "false"),
        }
        row = df.agg(*[F.bool_and(F.when(v.isNotNull(), c)).alias(t) for t, c in fits.items()]).first()
        want = next((t for t in types if row[t]), "string")
        assert dict(csv.infer_types(df).dtypes)["v"] == want, group
