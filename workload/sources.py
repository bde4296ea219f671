"""Sources and sinks: data goes out in some form and comes back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.functions.runtime import scratch_path
from recordlens.operators import search as X
from recordlens.operators.profile import numeric_columns, per_column
from recordlens.plans.ingest import ingest
from recordlens.sources import columnar, csv
from workload.frames import FAMILIES, hits_sql, search_tables
from workload.registry import Tables, query


@query(
    "read_csv_any_encoding",
    """
    SELECT 'shift-jis' AS encoding, s_suppkey AS key, '仕入先' || s_name AS name FROM supplier
    UNION ALL SELECT 'utf-8', c_custkey, '顧客' || c_name FROM customer
    """,
)
def read_csv_any_encoding(t: Tables) -> DataFrame:
    utf8, sjis = scratch_path(t.spark, "utf8"), scratch_path(t.spark, "sjis")
    csv.write_csv(
        t.customer.select(F.col("c_custkey").alias("key"), F.concat(F.lit("顧客"), "c_name").alias("name")), utf8
    )
    csv.allow_java_charsets(t.spark)
    t.supplier.select(
        F.col("s_suppkey").alias("key"), F.concat(F.lit("仕入先"), "s_name").alias("name")
    ).write.csv(sjis, header=True, encoding="Shift_JIS")
    return csv.read_csv_any_encoding(t.spark, [utf8, sjis], keep_source=True).select(
        "encoding", F.col("key").cast("long").alias("key"), "name"
    )


@query(
    "read_csv_own_headers",
    """
    SELECT id, name, amount, extra FROM (
      SELECT p_partkey::VARCHAR AS id, 'part "' || p_name || '"' || chr(10) || 'second line' AS name,
             p_size::DOUBLE AS amount, NULL AS extra FROM part
      UNION ALL SELECT s_suppkey::VARCHAR, NULL, s_acctbal, s_name FROM supplier
      UNION ALL SELECT 'N' || n_nationkey, '国' || n_name, NULL, NULL FROM nation)
    """,
    "amount",
)
def read_csv_own_headers(t: Tables) -> DataFrame:
    """Three headers in two encodings, a key that is a number in some files only, quotes and line breaks in values."""
    name = F.concat(F.lit('part "'), "p_name", F.lit('"\nsecond line'))
    paths = [scratch_path(t.spark, f"own{i}") for i in range(3)]
    csv.write_csv(t.part.select(F.col("p_partkey").alias("id"), name.alias("name"), F.col("p_size").alias("amount")), paths[0])
    csv.write_csv(
        t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("amount"), F.col("s_name").alias("extra")),
        paths[1],
    )
    csv.allow_java_charsets(t.spark)
    t.nation.select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.concat(F.lit("国"), "n_name").alias("name")).write.csv(
        paths[2], header=True, encoding="Shift_JIS"
    )
    return csv.read_csv_any_encoding(t.spark, paths).select("id", "name", "amount", "extra")


@query(
    "tag_source_category",
    """
    SELECT CASE c_nationkey WHEN 1 THEN '基本情報' WHEN 2 THEN '予算・執行' WHEN 3 THEN '効果発現経路'
                WHEN 4 THEN '点検・評価' WHEN 5 THEN '支出先' WHEN 6 THEN 'その他' ELSE '不明' END AS category,
           c_mktsegment AS subcategory, count(*) AS n
    FROM customer GROUP BY 1, 2
    """,
)
def tag_source_category(t: Tables) -> DataFrame:
    name = F.concat(F.col("c_nationkey"), F.lit("-1_"), "c_name", F.lit("_"), "c_mktsegment", F.lit("_x.csv"))
    category, part = csv.tag_source_category(name)
    return t.customer.groupBy(category.alias("category"), part.alias("subcategory")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "read_all_string",
    """
    SELECT l_returnflag, count(*) AS n, max(CAST(l_orderkey AS VARCHAR)) AS max_orderkey,
           min(CAST(l_partkey AS VARCHAR)) AS min_partkey
    FROM lineitem GROUP BY 1
    """,
)
def read_all_string(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "strings")
    csv.write_csv(t.lineitem, path)
    return csv.read_all_string(t.spark, [path]).groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("l_orderkey").alias("max_orderkey"),
        F.min("l_partkey").alias("min_partkey"),
    )


@query(
    "ingest_collection",
    """
    WITH t AS (
      SELECT '基本情報' AS category, '1-1_part' AS table_name, count(*) AS rows, CAST(6 AS BIGINT) AS columns FROM part
      UNION ALL SELECT '支出先', '5-1_supplier', count(*), 4 FROM supplier
      UNION ALL SELECT '支出先', '5-2_nation', count(*), 3 FROM nation)
    SELECT category, table_name, count(*) AS tables, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(columns) AS BIGINT) AS columns
    FROM t GROUP BY GROUPING SETS ((category, table_name), (category), ())
    """,
)
def ingest_collection(t: Tables) -> DataFrame:
    """Three tables of different headers and encodings: found, read, narrowed, stored, counted."""
    folder, target = scratch_path(t.spark, "collection"), scratch_path(t.spark, "tables")
    csv.allow_java_charsets(t.spark)
    csv.write_csv(t.part, f"{folder}/1-1_part.csv")
    csv.write_csv(t.supplier, f"{folder}/5-1_supplier.csv")
    t.nation.withColumn("n_name", F.concat(F.lit("国"), "n_name")).write.csv(
        f"{folder}/5-2_nation.csv", header=True, encoding="Shift_JIS"
    )
    return ingest(t.spark, folder, target)


@query(
    "read_columnar",
    """
    SELECT 'customer' AS table_name, count(*) AS n FROM customer
    UNION ALL SELECT 'orders', count(*) FROM orders
    UNION ALL SELECT 'lineitem', count(*) FROM lineitem
    """,
)
def read_columnar(t: Tables) -> DataFrame:
    found = columnar.read_columnar(t.spark, t.folder, ["customer", "orders", "not_there", "lineitem"])
    counts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name, df in found.items()
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("read_name_list", "SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1")
def read_name_list(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "names")
    # A name with blanks around it, followed by a blank line.
    t.part.select(F.concat(F.lit("  "), "p_name", F.lit(" \n   ")).alias("value")).write.text(path)
    return csv.read_name_list(t.spark, path).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "read_nested_json",
    hits_sql(FAMILIES)
    + """
    SELECT DISTINCT h.entity_id AS id, d.lang AS name
    FROM hits h JOIN documents d ON d.doc_id = h.entity_id WHERE family = 'relaxed'
    """,
)
def read_nested_json(t: Tables) -> DataFrame:
    hits = X.search_terms(X.text_cells(search_tables(t)), {"relaxed": FAMILIES["relaxed"]})
    result = X.search_rollup_entity(X.search_rollup_table(hits))
    enriched = X.enrich_from_master(result, t.documents, "doc_id", ["lang"])
    path = scratch_path(t.spark, "nested")
    columnar.write_json(
        enriched.withColumn("master_info", F.struct(F.col("lang").alias("name"))).drop("lang"), path
    )
    return columnar.read_nested_json(
        t.spark, path, schema="entity_id long, master_info struct<name: string>"
    )


_SINK_SQL = """
SELECT o_orderpriority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total
FROM orders GROUP BY 1
"""


def _sink_check(df: DataFrame) -> DataFrame:
    return df.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"),
    )


@query("write_csv", _SINK_SQL, "total")
def write_csv(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "csv")
    csv.write_csv(t.orders.select("o_orderpriority", "o_totalprice"), path, bom=True)
    # A reader that knows the mark drops it from the first header cell.
    return _sink_check(csv.read_csv_any_encoding(t.spark, [path]))


@query("write_columnar", _SINK_SQL, "total")
def write_columnar(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "columnar")
    columnar.write_columnar(t.orders, path)
    return _sink_check(t.spark.read.parquet(path))


@query("write_json", _SINK_SQL, "total")
def write_json(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "json")
    columnar.write_json(t.orders.select("o_orderpriority", "o_totalprice"), path)
    return _sink_check(t.spark.read.schema("o_orderpriority string, o_totalprice double").json(path))


_NARROWED = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"]


@query(
    "narrow_numeric",
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS column, CASE
          WHEN bool_and({c} = floor({c})) AND max(abs({c})) < 128 THEN 'tinyint'
          WHEN bool_and({c} = floor({c})) AND max(abs({c})) < 32768 THEN 'smallint'
          WHEN bool_and({c} = floor({c})) AND max(abs({c})) < 2147483648 THEN 'int'
          WHEN bool_and({c} = floor({c})) THEN 'bigint'
          WHEN bool_and(CAST(CAST({c} AS FLOAT) AS DOUBLE) = {c}) THEN 'float'
          ELSE 'double' END AS type,
          CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM lineitem"""
        for c in _NARROWED
    ),
)
def narrow_numeric(t: Tables) -> DataFrame:
    narrow = columnar.narrow_numeric(t.lineitem.select(*_NARROWED))
    columns = numeric_columns(narrow)
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema.fields}
    return per_column(
        narrow, columns,
        {
            "type": tuple(F.max(F.lit(kinds[c])) for c in columns),
            "min": tuple(F.min(F.col(c).cast("double")) for c in columns),
            "max": tuple(F.max(F.col(c).cast("double")) for c in columns),
        },
    )
