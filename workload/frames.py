"""Frames several queries start from, and the SQL views that match them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.functions.runtime import exact_sum, materialize
from recordlens.functions.scalars import has_child_flags, total_related
from recordlens.operators.master import attach_by_key
from recordlens.operators.search import ONE_RECORD, SearchTable
from workload.registry import Tables

COUNTS = ["orders_count", "lineitem_count", "events_count"]
LINE_ORDER = (
    "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)
LINE_SQL_ORDER = ", ".join(LINE_ORDER)


def entities(t: Tables) -> DataFrame:
    """Customers with their group, child counts, and first and last order year.

    Lines are counted per order before they meet the orders.
    """
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))
    year = F.year("o_orderdate")
    per_customer = (
        t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(
            F.count(F.lit(1)).alias("orders_count"),
            F.coalesce(F.sum("lines"), F.lit(0)).alias("lineitem_count"),
            F.min(year).alias("start_year"),
            F.max(year).alias("end_year"),
        )
    )
    per_user = t.events.groupBy(F.col("user_id").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("events_count")
    )
    base = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "c_name", "c_mktsegment", "n_name", "c_acctbal"
    )
    out = attach_by_key(base, per_customer, "c_custkey", {"orders_count": 0, "lineitem_count": 0})
    out = attach_by_key(out, per_user, "c_custkey", {"events_count": 0})
    out = has_child_flags(out, COUNTS)
    return out.withColumn("total_related_records", total_related(COUNTS))


def stored_entities(t: Tables) -> DataFrame:
    """The same, stored once for queries that go over it several times."""
    return materialize(entities(t))


ENTITIES = """
WITH oc AS (
  SELECT o_custkey AS k, count(*) AS n, min(year(o_orderdate)) AS y0, max(year(o_orderdate)) AS y1
  FROM orders GROUP BY 1),
lc AS (
  SELECT o_custkey AS k, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
ec AS (SELECT user_id AS k, count(*) AS n FROM events GROUP BY 1),
m AS (
  SELECT c_custkey, c_name, c_mktsegment, n_name, c_acctbal,
         coalesce(oc.n, 0) AS orders_count, coalesce(lc.n, 0) AS lineitem_count,
         coalesce(ec.n, 0) AS events_count,
         coalesce(oc.n, 0) + coalesce(lc.n, 0) + coalesce(ec.n, 0) AS total_related_records,
         oc.y0 AS start_year, oc.y1 AS end_year
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN oc ON oc.k = c_custkey LEFT JOIN lc ON lc.k = c_custkey LEFT JOIN ec ON ec.k = c_custkey)
"""


def order_amounts(t: Tables) -> DataFrame:
    """Orders with their group, amount, and the discounted amount of their lines."""
    executed = (
        t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            exact_sum(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)
            .cast("double").alias("executed")
        )
    )
    customers = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("o_custkey"), "n_name", "c_name"
    )
    return (
        t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
        .join(executed, "o_orderkey", "left")
        .join(customers, "o_custkey")
        .withColumn("executed", F.coalesce("executed", F.lit(0.0)))
    )


AMOUNTS = """
WITH ex AS (
  SELECT l_orderkey AS k,
         CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS executed
  FROM lineitem GROUP BY 1),
a AS (
  SELECT o_orderkey, o_custkey, n_name, c_name, o_totalprice, o_orderdate, o_orderpriority,
         coalesce(executed, 0.0) AS executed
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN ex ON ex.k = o_orderkey)
"""


def group_orders(t: Tables) -> DataFrame:
    """Orders with group, category and year, without the line amounts."""
    customers = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("o_custkey"), "n_name", "c_mktsegment"
    )
    return t.orders.select(
        "o_orderkey", "o_custkey", "o_totalprice", F.year("o_orderdate").alias("year")
    ).join(customers, "o_custkey")


GROUP_ORDERS = """
WITH g AS (
  SELECT o_orderkey, o_custkey, o_totalprice, year(o_orderdate) AS year, n_name, c_mktsegment
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""


def labelled(t: Tables) -> DataFrame:
    """Documents with their labels where there are any, so with real nulls."""
    return t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels, "doc_id", "left")


LABELLED = """
WITH d AS (
  SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
"""


def search_tables(t: Tables) -> list[SearchTable]:
    """Three text tables over one id space."""
    return [
        SearchTable("documents", t.documents, "doc_id", ("text", "source"), ONE_RECORD),
        SearchTable("conversations", t.conversations, "conv_id", ("text", "role"), "turn"),
        SearchTable("benchmark", t.benchmark, "item_id", ("text", "absent_field"), ONE_RECORD),
    ]


CELLS = r"""
WITH cells AS (
  SELECT doc_id AS entity_id, 'documents' AS table_name, 'text' AS field, 0 AS row_pos, text FROM documents
  UNION ALL SELECT doc_id, 'documents', 'source', 0, source FROM documents
  UNION ALL SELECT conv_id, 'conversations', 'text', turn, text FROM conversations
  UNION ALL SELECT conv_id, 'conversations', 'role', turn, role FROM conversations
  UNION ALL SELECT item_id, 'benchmark', 'text', 0, text FROM benchmark),
filled AS (SELECT * FROM cells WHERE text IS NOT NULL AND text <> '')
"""

# Search families for the test texts, which are Latin pseudo-words.
FAMILIES = {
    "strict": (r"\bAI\b",),
    "relaxed": ("AI", "ＡＩ", r"A\.I\."),
    "compound": ("data", "tion", r"AI[ア-ン\w]*"),
}


def term_sql(term: str) -> str:
    """The SQL test of a term on ``text``: RE2 has no Unicode word boundary."""
    word = r"[\p{L}\p{N}_]"
    if term == r"AI[ア-ン\w]*":
        term = "AI"
    if term == r"\bA\.I\.\b":
        return f"regexp_matches(text, '(^|[^{word[1:-1]}])A\\.I\\.{word}', 'i')"
    if term.startswith(r"\b"):
        inner = term[2:-2]
        return f"regexp_matches(text, '(^|[^{word[1:-1]}]){inner}($|[^{word[1:-1]}])', 'i')"
    if "\\" in term:
        return f"regexp_matches(text, '{term}', 'i')"
    return f"contains(lower(text), lower('{term}'))"


def hits_sql(families: dict[str, tuple[str, ...]]) -> str:
    """A view ``hits`` (cell columns, text, family, term) on top of ``CELLS``."""
    parts = [
        f"SELECT entity_id, table_name, field, row_pos, text, '{f}' AS family, '{term}' AS term "
        f"FROM filled WHERE {term_sql(term)}"
        for f, terms in families.items()
        for term in terms
    ]
    return CELLS + ",\nhits AS (\n" + "\nUNION ALL ".join(parts) + ")\n"
