"""Profiles, key analysis, set operations and audits over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.functions.runtime import scratch_path
from recordlens.operators import keys as K
from recordlens.operators import profile as R
from recordlens.sources import columnar, csv
from workload.frames import LABELLED, labelled
from workload.registry import Tables, query

_NUMERIC = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "profile_numeric",
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS column, avg({c})::DOUBLE AS mean, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, "
        f"count(*) - count({c}) AS null_count FROM lineitem"
        for c in _NUMERIC
    )
    + LABELLED.replace("WITH d AS", "\nUNION ALL SELECT 'quality', avg(quality)::DOUBLE, min(quality)::DOUBLE, "
      "max(quality)::DOUBLE, count(*) - count(quality) FROM"),
    "mean",
)
def profile_numeric(t: Tables) -> DataFrame:
    return R.profile_numeric(t.lineitem, _NUMERIC).unionByName(R.profile_numeric(labelled(t), ["quality"]))


def _categorical_sql(table: str, columns: list[str]) -> str:
    return "\nUNION ALL ".join(
        f"""SELECT '{c}' AS column, count(DISTINCT {c}) AS distinct_values, count(*) - count({c}) AS null_count,
        CASE WHEN count(DISTINCT {c}) < 100 THEN (
          SELECT string_agg(v || ':' || n, ', ' ORDER BY n DESC, v) FROM (
            SELECT {c} AS v, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5))
        END AS top_values FROM {table}"""
        for c in columns
    )


@query(
    "profile_categorical",
    _categorical_sql("part", ["p_name", "p_brand", "p_type"])
    + "\nUNION ALL " + _categorical_sql("customer", ["c_name", "c_mktsegment"]),
)
def profile_categorical(t: Tables) -> DataFrame:
    return R.profile_categorical(t.part).unionByName(R.profile_categorical(t.customer))


@query(
    "profile_nulls",
    LABELLED + """
    SELECT 'quality' AS column, count(*) - count(quality) AS null_count,
           round((count(*) - count(quality)) * 100.0 / count(*), 2)::DOUBLE AS null_pct FROM d
    UNION ALL
    SELECT 'toxic', count(*) - count(toxic), round((count(*) - count(toxic)) * 100.0 / count(*), 2) FROM d
    """,
)
def profile_nulls(t: Tables) -> DataFrame:
    return R.profile_nulls(labelled(t))


_KINDS = ["o_orderkey", "o_totalprice", "o_orderstatus", "sometimes", "never"]
_MIXED = """
WITH x AS (
  SELECT o_orderkey::VARCHAR AS o_orderkey, o_totalprice::VARCHAR AS o_totalprice, o_orderstatus,
         CASE WHEN o_orderstatus = 'F' THEN o_custkey::VARCHAR END AS sometimes, CAST(NULL AS VARCHAR) AS never
  FROM orders)
"""


def _mixed(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.col("o_totalprice").cast("string").alias("o_totalprice"),
        "o_orderstatus",
        F.when(F.col("o_orderstatus") == "F", F.col("o_custkey").cast("string")).alias("sometimes"),
        F.lit(None).cast("string").alias("never"),
    )


def _kind_sql(c: str) -> str:
    return f"""
    SELECT '{c}' AS column, count(*) AS sampled,
           CASE WHEN count(*) = 0 THEN 'empty' WHEN bool_and(TRY_CAST(v AS DOUBLE) IS NOT NULL) THEN 'numeric'
           ELSE 'text' END AS kind
    FROM (SELECT {c} AS v FROM x WHERE {c} IS NOT NULL ORDER BY o_orderkey LIMIT 100)"""


@query("infer_column_kind", _MIXED + " UNION ALL ".join(_kind_sql(c) for c in _KINDS))
def infer_column_kind(t: Tables) -> DataFrame:
    return R.infer_column_kind(_mixed(t), ["o_orderkey"], sample=R.KIND_SAMPLE)


def _whole_kind_sql(c: str) -> str:
    return _kind_sql(c).replace(" ORDER BY o_orderkey LIMIT 100", "")


@query("infer_column_kind_whole", _MIXED + " UNION ALL ".join(_whole_kind_sql(c) for c in _KINDS))
def infer_column_kind_whole(t: Tables) -> DataFrame:
    return R.infer_column_kind(_mixed(t))


@query(
    "kind_counts",
    _MIXED + "SELECT kind, count(*) AS columns FROM (" + " UNION ALL ".join(_kind_sql(c) for c in _KINDS)
    + ") GROUP BY 1",
)
def kind_counts(t: Tables) -> DataFrame:
    return R.kind_counts(R.infer_column_kind(_mixed(t), ["o_orderkey"], sample=R.KIND_SAMPLE))


_CATEGORY = {
    "region": ("base", 2), "nation": ("base", 3), "customer": ("base", 5), "orders": ("detail", 6),
    "lineitem": ("detail", 11), "part": ("base", 6), "supplier": ("base", 4), "events": ("detail", 6),
    "documents": ("text", 5), "conversations": ("text", 4), "benchmark": ("text", 2), "pages": ("text", 3),
}


@query(
    "table_inventory",
    "WITH i AS ("
    + " UNION ALL ".join(
        f"SELECT '{cat}' AS category, '{name}' AS table_name, count(*) AS rows, {n} AS columns FROM {name}"
        for name, (cat, n) in _CATEGORY.items()
    )
    + """)
    SELECT category, table_name, count(*) AS tables, CAST(sum(rows) AS BIGINT) AS rows,
           CAST(sum(columns) AS BIGINT) AS columns
    FROM i GROUP BY GROUPING SETS ((category, table_name), (category), ())
    """,
)
def table_inventory(t: Tables) -> DataFrame:
    return R.table_inventory({name: (cat, getattr(t, name)) for name, (cat, _) in _CATEGORY.items()})


@query(
    "completeness",
    LABELLED + """
    SELECT count(*) * 6 AS cells, (count(*) - count(quality)) + (count(*) - count(toxic)) AS missing_cells,
           round((count(*) * 4 + count(quality) + count(toxic)) * 100.0 / (count(*) * 6), 2)::DOUBLE AS complete_pct
    FROM d
    """,
)
def completeness(t: Tables) -> DataFrame:
    return R.completeness(labelled(t))


@query(
    "sample_rows",
    """
    SELECT * FROM (SELECT 'customer' AS table_name, '{"c_custkey":' || c_custkey || '}' AS row_key,
      '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}' AS row
      FROM customer ORDER BY c_custkey LIMIT 3)
    UNION ALL
    SELECT * FROM (SELECT 'labels', '{"doc_id":' || doc_id || '}',
      '{"doc_id":' || doc_id || ',"quality":' || coalesce(quality::VARCHAR, 'null') || ',"toxic":' || coalesce(toxic::VARCHAR, 'null') || '}'
      FROM labels ORDER BY doc_id LIMIT 3)
    """,
)
def sample_rows(t: Tables) -> DataFrame:
    return R.sample_rows(
        {
            "customer": (t.customer.select("c_custkey", "c_name", "c_mktsegment"), ["c_custkey"]),
            "labels": (t.labels, ["doc_id"]),
        }
    )


# --- keys -----------------------------------------------------------------

_KEYED = {
    "customer": ("customer", "c_custkey"), "orders": ("orders", "o_custkey"),
    "events": ("events", "user_id"), "supplier": ("supplier", "s_suppkey"),
}
_KEYED_NAMES = list(_KEYED)
_COUNTS_SQL = (
    "WITH k AS ("
    + " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, {key} AS key, count(*) AS n FROM {table} GROUP BY 1, 2"
        for name, (table, key) in _KEYED.items()
    )
    + ")\n"
)
_CARDINALITY = """
card AS (
  SELECT table_name, count(key) AS unique_keys,
         CAST(coalesce(sum(n) FILTER (key IS NOT NULL), 0) AS BIGINT) AS keyed_rows,
         round(sum(n) FILTER (key IS NOT NULL) / count(key), 2)::DOUBLE AS rows_per_key,
         min(key) AS min_key, max(key) AS max_key,
         CAST(coalesce(sum(n) FILTER (key IS NULL), 0) AS BIGINT) AS null_keys
  FROM k GROUP BY 1)
"""
_COVERAGE = """
a AS (SELECT count(DISTINCT key) AS all_keys FROM k),
cov AS (
  SELECT table_name, count(key) AS unique_keys, max(all_keys) AS all_keys,
         round(count(key) * 100.0 / max(all_keys), 2)::DOUBLE AS coverage_pct,
         max(all_keys) - count(key) AS missing_keys,
         round(count(key) * 100.0 / max(all_keys), 2) >= 99.0 AS master_candidate
  FROM k, a GROUP BY 1)
"""


def _counts(t: Tables) -> DataFrame:
    return K.key_counts({name: (getattr(t, table), key) for name, (table, key) in _KEYED.items()})


@query("key_cardinality", _COUNTS_SQL.rstrip() + "," + _CARDINALITY + "SELECT * FROM card")
def key_cardinality(t: Tables) -> DataFrame:
    return K.key_cardinality(_counts(t))


@query("key_coverage", _COUNTS_SQL.rstrip() + "," + _COVERAGE + "SELECT * FROM cov")
def key_coverage(t: Tables) -> DataFrame:
    return K.key_coverage_of({name: (getattr(t, table), key) for name, (table, key) in _KEYED.items()})


@query(
    "relationship_class",
    _COUNTS_SQL.rstrip() + "," + _CARDINALITY.rstrip() + "," + _COVERAGE + """
    SELECT table_name, rows_per_key, coverage_pct, category,
           CASE WHEN rows_per_key <= 1.1 THEN '1:1' ELSE '1:N' END AS relationship,
           round(CASE WHEN rows_per_key <= 1.1 THEN card.unique_keys ELSE card.unique_keys * rows_per_key END, 2)::DOUBLE AS estimated_rows,
           table_name = (SELECT min(table_name) FROM card WHERE rows_per_key <= 1.1 AND table_name = 'customer') AS is_master,
           CASE WHEN (SELECT bool_or(coverage_pct < 95) FROM cov) THEN 'medium' ELSE 'low' END AS risk_level
    FROM card JOIN cov USING (table_name)
    JOIN (VALUES ('customer', 'base'), ('orders', 'detail'), ('events', 'detail'), ('supplier', 'other'))
      v(table_name, category) USING (table_name)
    """,
)
def relationship_class(t: Tables) -> DataFrame:
    counts = _counts(t)
    categories = {"customer": "base", "orders": "detail", "events": "detail", "supplier": "other"}
    return K.relationship_class(
        K.key_cardinality(counts), K.key_coverage(counts, _KEYED_NAMES), categories, "base"
    )


@query(
    "missing_ids",
    """
    WITH x AS (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
    SELECT count(*) AS missing_count,
           (SELECT string_agg(doc_id, ', ' ORDER BY doc_id) FROM (SELECT doc_id FROM x ORDER BY 1 LIMIT 5)) AS sample_ids
    FROM x
    """,
)
def missing_ids(t: Tables) -> DataFrame:
    return K.missing_ids(t.documents, t.labels, "doc_id")


@query(
    "union_ids",
    "SELECT c_custkey AS id FROM customer UNION SELECT o_orderkey FROM orders UNION SELECT doc_id FROM documents",
)
def union_ids(t: Tables) -> DataFrame:
    return K.union_ids([(t.customer, "c_custkey"), (t.orders, "o_orderkey"), (t.documents, "doc_id")])


@query("diff_ids", "SELECT o_orderkey AS id FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def diff_ids(t: Tables) -> DataFrame:
    lines = t.lineitem.withColumnRenamed("l_orderkey", "id")
    return K.diff_ids(t.orders.withColumnRenamed("o_orderkey", "id"), lines, "id")


_OVERLAP = {"orders": ["o_orderkey AS orderkey", "o_custkey AS custkey"],
            "lineitem": ["l_orderkey AS orderkey", "l_partkey AS partkey"],
            "customer": ["c_custkey AS custkey", "c_nationkey AS nationkey"],
            "supplier": ["s_nationkey AS nationkey"], "part": ["p_partkey AS partkey"]}


def _overlap_sql() -> str:
    owners: dict[str, list[tuple[str, str]]] = {}
    for table, columns in _OVERLAP.items():
        for c in columns:
            source, name = c.split(" AS ")
            owners.setdefault(name, []).append((table, source))
    parts = []
    for name, tables in owners.items():
        for table, source in tables:
            for other, other_source in tables:
                if table != other:
                    parts.append(
                        f"""SELECT '{name}' AS column, '{table}' AS table_name, '{other}' AS other_table,
                        count(*) AS distinct_values, count(*) FILTER (v IN (SELECT {other_source} FROM {other})) AS in_other
                        FROM (SELECT DISTINCT {source} AS v FROM {table} WHERE {source} IS NOT NULL)"""
                    )
    return (
        "SELECT *, round(in_other * 100.0 / distinct_values, 2)::DOUBLE AS share FROM ("
        + " UNION ALL ".join(parts) + ")"
    )


@query("field_overlap", _overlap_sql())
def field_overlap(t: Tables) -> DataFrame:
    return K.field_overlap({name: getattr(t, name).selectExpr(*cols) for name, cols in _OVERLAP.items()})


# --- audits ---------------------------------------------------------------


def _conversion(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Orders as CSV text, and the same narrowed and stored columnar, with one column changed."""
    raw_path, new_path = scratch_path(t.spark, "raw"), scratch_path(t.spark, "converted")
    csv.write_csv(t.orders, raw_path)
    raw = csv.read_csv_any_encoding(t.spark, [raw_path])
    changed = F.when(F.col("o_orderstatus") == "P", None).otherwise(F.col("o_orderstatus"))
    converted = columnar.narrow_numeric(raw).withColumn("o_orderstatus", changed).withColumnRenamed(
        "o_orderpriority", "priority"
    )
    columnar.write_columnar(converted, new_path)
    return raw, t.spark.read.parquet(new_path)


@query(
    "audit_conversion",
    """
    SELECT *, coalesce(raw_rows = converted_rows AND raw_nulls = converted_nulls, false) AND state = 'both' AS same_values FROM (
    SELECT 'o_orderkey' AS column, 'both' AS state, count(*) AS raw_rows, count(*) AS converted_rows,
           CAST(0 AS BIGINT) AS raw_nulls, CAST(0 AS BIGINT) AS converted_nulls FROM orders
    UNION ALL SELECT 'o_custkey', 'both', count(*), count(*), 0, 0 FROM orders
    UNION ALL SELECT 'o_totalprice', 'both', count(*), count(*), 0, 0 FROM orders
    UNION ALL SELECT 'o_orderdate', 'both', count(*), count(*), 0, 0 FROM orders
    UNION ALL SELECT 'o_orderstatus', 'both', count(*), count(*), 0, count(*) FILTER (o_orderstatus = 'P') FROM orders
    UNION ALL SELECT 'o_orderpriority', 'missing', count(*), NULL, 0, NULL FROM orders
    UNION ALL SELECT 'priority', 'added', NULL, count(*), NULL, 0 FROM orders)
    """,
)
def audit_conversion(t: Tables) -> DataFrame:
    return R.audit_conversion(*_conversion(t)).withColumn("same_values", F.coalesce("same_values", F.lit(False)))


_LINE_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
)


@query(
    "audit_conversion_narrowed",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column, 'both' AS state, count(*) AS raw_rows, count(*) AS converted_rows,
               CAST(0 AS BIGINT) AS raw_nulls, CAST(0 AS BIGINT) AS converted_nulls, true AS same_values FROM lineitem"""
        for c in _LINE_COLUMNS
    ),
)
def audit_conversion_narrowed(t: Tables) -> DataFrame:
    """All columns of the lines, among them doubles that hold whole numbers, against their narrowed copy."""
    path = scratch_path(t.spark, "narrowed")
    columnar.write_columnar(columnar.narrow_numeric(t.lineitem), path)
    return R.audit_conversion(t.lineitem, t.spark.read.parquet(path))


@query(
    "key_cardinality_text",
    """
    WITH k AS (SELECT 'a' AS table_name, 'C' || c_custkey AS key FROM customer
      UNION ALL SELECT 'b', CASE WHEN o_custkey % 10 = 0 THEN 'bad key' WHEN o_custkey % 10 = 1 THEN NULL ELSE o_custkey::VARCHAR END FROM orders)
    SELECT table_name, count(DISTINCT key) AS unique_keys, count(key) AS keyed_rows,
           round(count(key) / count(DISTINCT key), 2) AS rows_per_key, min(key) AS min_key, max(key) AS max_key,
           count(*) - count(key) AS null_keys
    FROM k GROUP BY 1
    """,
)
def key_cardinality_text(t: Tables) -> DataFrame:
    key = F.col("o_custkey") % 10
    bad = F.when(key == 0, "bad key").when(key == 1, None).otherwise(F.col("o_custkey").cast("string"))
    tables = {
        "a": (t.customer.select(F.concat(F.lit("C"), F.col("c_custkey")).alias("key")), "key"),
        "b": (t.orders.select(bad.alias("key")), "key"),
    }
    return K.key_cardinality(K.key_counts(tables))


@query(
    "audit_summary",
    """
    SELECT 'orders' AS table_name, CAST(6 AS BIGINT) AS raw_columns, CAST(6 AS BIGINT) AS converted_columns,
           CAST(1 AS BIGINT) AS missing_columns, CAST(1 AS BIGINT) AS added_columns,
           count(*) FILTER (o_orderstatus = 'P') = 0 AND false AS all_equal FROM orders
    UNION ALL SELECT 'part', count(DISTINCT 1) * 6, 6, 0, 0, true FROM part
    """,
)
def audit_summary(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "part")
    columnar.write_columnar(t.part, path)
    return R.audit_summary(
        {
            "orders": audit_conversion(t),
            "part": R.audit_conversion(t.part, t.spark.read.parquet(path)),
        }
    )
