"""Joins, nesting and the wide extract over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordlens.functions.ranking import dedupe_first
from recordlens.operators import keys as K
from recordlens.operators import master as M
from recordlens.operators import wide as N
from recordlens.plans.strict_extract import strict_extract as strict_plan
from workload.frames import CELLS, LINE_ORDER, LINE_SQL_ORDER, LABELLED, labelled, search_tables
from workload.registry import Tables, query


@query(
    "dedupe_first",
    f"SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_SQL_ORDER}) = 1",
)
def dedupe(t: Tables) -> DataFrame:
    return dedupe_first(t.lineitem, "l_orderkey", LINE_ORDER)


@query(
    "left_join_unique",
    f"""
    WITH l AS (
      SELECT l_orderkey AS o_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem
      QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_SQL_ORDER}) = 1),
    e AS (
      SELECT user_id AS o_custkey, event_type, value FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1)
    SELECT o_orderkey, o_custkey, o_totalprice, l_partkey, l_suppkey, l_linenumber
    FROM orders LEFT JOIN l USING (o_orderkey)
    """,
)
def left_join_unique(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey").withColumn("o_totalprice", F.lit(0.0))
    joined = M.left_join_unique(orders, "o_orderkey", [(lines, LINE_ORDER)])
    return joined.select("o_orderkey", "o_custkey", "o_totalprice", "l_partkey", "l_suppkey", "l_linenumber")


@query(
    "outer_join_common_keys",
    """
    SELECT doc_id, d.lang, d.source, l.quality, l.toxic, e.label
    FROM (SELECT doc_id, lang, source FROM documents) d
    FULL JOIN (SELECT doc_id, quality, toxic FROM labels) l USING (doc_id)
    FULL JOIN (SELECT vec_id * 3 AS doc_id, label FROM embeddings) e USING (doc_id)
    """,
)
def outer_join_common_keys(t: Tables) -> DataFrame:
    frames = [
        t.documents.select("doc_id", "lang", "source"),
        t.labels,
        t.region,
        t.embeddings.select((F.col("vec_id") * 3).alias("doc_id"), "label"),
    ]
    return K.outer_join_common_keys(frames, ["doc_id", "p_partkey"])


@query(
    "attach_by_key",
    """
    SELECT o_orderkey, coalesce(n, 0) AS line_count, coalesce(q, 0) AS quantity
    FROM orders LEFT JOIN (
      SELECT l_orderkey, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS q
      FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
    """,
)
def attach_by_key(t: Tables) -> DataFrame:
    per_order = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("line_count"),
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"),
    )
    return M.attach_by_key(
        t.orders.select("o_orderkey"), per_order, "o_orderkey", {"line_count": 0, "quantity": 0.0}
    )


@query(
    "restrict_to_ids",
    """
    SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')
    """,
)
def restrict_to_ids(t: Tables) -> DataFrame:
    urgent = t.orders.filter(F.col("o_orderpriority") == "1-URGENT")
    return M.restrict_to_ids(t.lineitem, "l_orderkey", urgent.withColumnRenamed("o_orderkey", "l_orderkey"))


def _lines(t: Tables) -> DataFrame:
    return t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")


def _line_child(t: Tables) -> M.Child:
    return M.Child(_lines(t), LINE_ORDER, drop=("l_tax", "l_shipdate"))


_DIGEST = "l_linenumber || ':' || l_partkey || ':' || l_suppkey || ':' || l_returnflag"


def _digest(records: str = "records"):
    return F.array_join(
        F.transform(
            records,
            lambda r: F.concat_ws(":", r["l_linenumber"], r["l_partkey"], r["l_suppkey"], r["l_returnflag"]),
        ),
        " ",
    )


@query(
    "nest_children",
    f"""
    SELECT l_orderkey AS o_orderkey, 0 AS chunk, 1 AS chunks, count(*) AS record_count,
           string_agg({_DIGEST}, ' ' ORDER BY {LINE_SQL_ORDER}) AS digest
    FROM lineitem GROUP BY 1
    """,
)
def nest_children(t: Tables) -> DataFrame:
    nested = M.nest_children(_lines(t), "o_orderkey", _line_child(t))
    return nested.select("o_orderkey", "chunk", "chunks", "record_count", _digest().alias("digest"))


_CHUNKED_SQL = f"""
    SELECT l_orderkey AS o_orderkey, CAST((p - 1) // 4 AS INTEGER) AS chunk, CAST((any_value(n) + 3) // 4 AS INTEGER) AS chunks,
           count(*) AS record_count, string_agg({_DIGEST}, ' ' ORDER BY {LINE_SQL_ORDER}) AS digest
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_SQL_ORDER}) AS p,
                 count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
    GROUP BY l_orderkey, (p - 1) // 4
    """


@query("nest_chunks", _CHUNKED_SQL)
def nest_chunks(t: Tables) -> DataFrame:
    """Four records per row: the same records in the same order, in more rows."""
    nested = M.nest_children(_lines(t), "o_orderkey", _line_child(t), limit=4)
    return nested.select("o_orderkey", "chunk", "chunks", "record_count", _digest().alias("digest"))


@query("nest_hot_keys", _CHUNKED_SQL.replace("// 4", "// 6").replace("+ 3)", "+ 5)"))
def nest_hot_keys(t: Tables) -> DataFrame:
    """Orders of 7 lines are found to be too large for a row and spread by place."""
    nested = M.nest_children(_lines(t), "o_orderkey", _line_child(t), limit=6, spread=6)
    return nested.select("o_orderkey", "chunk", "chunks", "record_count", _digest().alias("digest"))


def customer_children(t: Tables) -> dict[str, M.Child]:
    orders = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    events = t.events.select(F.col("user_id").alias("c_custkey"), "event_id", "event_type", "value", "props")
    return {
        "orders": M.Child(orders, ("o_orderkey",)),
        "events": M.Child(events, ("event_id",)),
    }


def customer_master(t: Tables, with_records: bool = True, limit: int = M.RECORD_LIMIT) -> DataFrame:
    nation = t.nation.select("n_nationkey", "n_name")
    base = t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).drop("n_nationkey")
    first_order = t.orders.select(
        F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority", F.lit("x").alias("c_name")
    )
    return M.build_master(
        base, "c_custkey", ["c_name"], [(first_order, ["o_orderkey"])], customer_children(t), with_records, limit
    )


_MASTER_SQL = """
WITH f AS (
  SELECT o_custkey AS k, o_orderkey, o_orderpriority FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1),
o AS (SELECT o_custkey AS k, count(*) AS n, string_agg(o_orderkey, ' ' ORDER BY o_orderkey) AS ids FROM orders GROUP BY 1),
e AS (SELECT user_id AS k, count(*) AS n, string_agg(event_type, ' ' ORDER BY event_id) AS kinds FROM events GROUP BY 1),
m AS (
  SELECT c_custkey, c_name, n_name, f.o_orderkey, o_orderpriority, o.ids AS order_ids, e.kinds AS event_kinds,
         coalesce(o.n, 0) AS orders_count, coalesce(e.n, 0) AS events_count,
         coalesce(o.n, 0) > 0 AS has_orders, coalesce(e.n, 0) > 0 AS has_events,
         coalesce(o.n, 0) + coalesce(e.n, 0) AS total_related_records
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN f ON f.k = c_custkey LEFT JOIN o ON o.k = c_custkey LEFT JOIN e ON e.k = c_custkey)
"""


def _all_records(master: DataFrame) -> DataFrame:
    """A row per entity with the records of all its rows as texts, in order."""

    def joined(column: str, field: str):
        pieces = F.collect_list(F.struct("chunk", F.transform(column, lambda r: r[field].cast("string")).alias("v")))
        flat = F.flatten(F.transform(F.filter(F.sort_array(pieces), lambda p: p["v"].isNotNull()), lambda p: p["v"]))
        return F.when(F.size(flat) > 0, F.array_join(flat, " "))

    # Columns of the entity are null in its further rows.
    plain = [c for c in master.columns if c not in ("c_custkey", "orders", "events", "chunk", "child")]
    return master.groupBy("c_custkey").agg(
        joined("orders", "o_orderkey").alias("order_ids"), joined("events", "event_type").alias("event_kinds"),
        *[F.max(c).alias(c) for c in plain],
    )


@query("build_master", _MASTER_SQL + "SELECT * FROM m")
def build_master(t: Tables) -> DataFrame:
    return _all_records(customer_master(t)).select(
        "c_custkey", "c_name", "n_name", "o_orderkey", "o_orderpriority", "order_ids", "event_kinds",
        "orders_count", "events_count", "has_orders", "has_events", "total_related_records",
    )


@query("build_master_chunks", _MASTER_SQL + "SELECT c_custkey, c_name, order_ids, event_kinds, orders_count, events_count FROM m")
def build_master_chunks(t: Tables) -> DataFrame:
    """The same records from two per row: what the further rows hold goes on where chunk 0 ends."""
    return _all_records(customer_master(t, limit=2)).select(
        "c_custkey", "c_name", "order_ids", "event_kinds", "orders_count", "events_count"
    )


@query(
    "nest_stats",
    _MASTER_SQL + """
    SELECT 'orders' AS child, (SELECT count(*) FROM orders) AS total_records,
           count(*) FILTER (has_orders) AS entities_with_data,
           (SELECT count(*) FROM orders) / count(*) AS records_per_entity FROM m
    UNION ALL
    SELECT 'events', (SELECT count(*) FROM events), count(*) FILTER (has_events),
           (SELECT count(*) FROM events) / count(*) FROM m
    """,
    "records_per_entity",
)
def nest_stats(t: Tables) -> DataFrame:
    return M.nest_stats(customer_master(t, with_records=False), customer_children(t))


@query(
    "column_roles",
    """
    SELECT (SELECT count(*) FROM customer) AS rows, role, columns
    FROM (VALUES ('base', CAST(11 AS BIGINT)), ('records', 2), ('count', 2), ('flag', 2)) v(role, columns)
    """,
)
def column_roles(t: Tables) -> DataFrame:
    return M.column_roles(customer_master(t), customer_children(t))


@query(
    "unnest_records",
    """
    SELECT user_id AS c_custkey, event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events
    """,
)
def unnest_records(t: Tables) -> DataFrame:
    """Events packed as JSON text per user, read back together with text that is no list."""
    packed = M.nest_children(
        customer_children(t)["events"].df, "c_custkey", customer_children(t)["events"]
    ).select("c_custkey", F.to_json("records").alias("js"))
    broken = t.customer.select(
        "c_custkey", F.when(F.col("c_nationkey") > 12, "null").otherwise("{\"k\": 1}").alias("js")
    )
    record = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("props", T.StringType())])
    rows = M.unnest_records(packed.unionByName(broken), "c_custkey", "js", record)
    return rows.select(
        "c_custkey", "record.event_id", F.get_json_object("record.props", "$.k").cast("long").alias("k")
    )


@query(
    "unnest_untyped",
    "SELECT regexp_extract(props, '\"([a-z]+)\"', 1) AS field, count(*) AS n FROM events GROUP BY 1",
)
def unnest_untyped(t: Tables) -> DataFrame:
    """Records of unknown fields as maps."""
    lists = t.events.select("event_id", F.concat(F.lit("["), "props", F.lit(", 1, null]")).alias("js"))
    rows = M.unnest_records(lists, "event_id", "js")
    return rows.select(F.explode("record").alias("field", "v")).groupBy("field").agg(
        F.count(F.lit(1)).alias("n")
    )


# --- wide extract ---------------------------------------------------------


def _urgent(t: Tables) -> DataFrame:
    return t.orders.filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").alias("entity_id"))


def _wide_tables(t: Tables) -> list[N.WideTable]:
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    lines = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus",
        F.col("l_quantity").cast("int").alias("l_quantity"),
    )
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    return [
        N.WideTable("orders", orders, "o_orderkey", ("o_custkey",)),
        N.WideTable("lines", lines, "l_orderkey", order),
    ]


_LINE_COLUMNS = ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity"]
_WIDE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus"


def _wide_sql(order: str = "pos") -> str:
    parts = []
    for c in _LINE_COLUMNS:
        parts.append(
            f"""w_{c} AS (
      SELECT l_orderkey, string_agg(v, ' | ' ORDER BY {order}) AS v FROM (
        SELECT l_orderkey, CAST({c} AS INTEGER)::VARCHAR AS v, min(pos) AS pos FROM p GROUP BY 1, 2) GROUP BY 1)"""
            if c not in ("l_returnflag", "l_linestatus")
            else f"""w_{c} AS (
      SELECT l_orderkey, string_agg(v, ' | ' ORDER BY {order}) AS v FROM (
        SELECT l_orderkey, {c} AS v, min(pos) AS pos FROM p GROUP BY 1, 2) GROUP BY 1)"""
        )
    joins = " ".join(f"LEFT JOIN w_{c} ON w_{c}.l_orderkey = o_orderkey" for c in _LINE_COLUMNS)
    columns = ", ".join(f"coalesce(w_{c}.v, '') AS lines_{c}" for c in _LINE_COLUMNS)
    return f"""
    WITH u AS (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT'),
    p AS (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_WIDE_ORDER}) AS pos
      FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM u)),
    {", ".join(parts)},
    wide AS (
      SELECT o_orderkey AS entity_id, o_custkey::VARCHAR AS orders_o_custkey,
             o_orderpriority AS orders_o_orderpriority, o_orderstatus AS orders_o_orderstatus, {columns}
      FROM u {joins})
    """


def _all_parts(wide: DataFrame) -> DataFrame:
    """A row per entity: the cells of its parts go on where the one before ends."""

    def cell(c: str):
        pieces = F.filter(F.sort_array(F.collect_list(F.struct("part", F.col(c).alias("v")))), lambda p: p["v"].isNotNull())
        return F.array_join(F.transform(pieces, lambda p: p["v"]), " | ").alias(c)

    return wide.groupBy("entity_id").agg(*[cell(c) for c in wide.columns if c not in ("entity_id", "part")])


@query("wide_extract", _wide_sql() + "SELECT * FROM wide")
def wide_extract(t: Tables) -> DataFrame:
    return _all_parts(N.wide_extract(_wide_tables(t), "entity_id", _urgent(t)))


@query("wide_extract_split", _wide_sql() + "SELECT * FROM wide")
def wide_extract_split(t: Tables) -> DataFrame:
    """The same cells from two values per part."""
    return _all_parts(N.wide_extract(_wide_tables(t), "entity_id", _urgent(t), limit=2))


@query(
    "audit_wide_extract",
    _wide_sql() + """
    SELECT 'orders' AS table_name, CAST(3 AS BIGINT) AS columns, count(*) AS entities_with_data,
           count(*) * 3 AS filled_cells, CAST(10 AS BIGINT) AS total_columns, CAST(13 AS BIGINT) AS expected_columns,
           true AS as_expected FROM wide
    UNION ALL
    SELECT 'lines', 6, count(*) FILTER (lines_l_partkey <> ''), count(*) FILTER (lines_l_partkey <> '') * 6,
           10, 13, true FROM wide
    """,
)
def audit_wide_extract(t: Tables) -> DataFrame:
    tables = _wide_tables(t)
    return N.audit_wide_extract(N.wide_extract(tables, "entity_id", _urgent(t)), tables)


@query(
    "table_coverage",
    _wide_sql() + """
    SELECT 'orders' AS table_name, CAST(3 AS BIGINT) AS columns, CAST(3 AS BIGINT) AS columns_with_data,
           100.0::DOUBLE AS mean_coverage
    UNION ALL
    SELECT 'lines', 6, 6, round(count(*) FILTER (lines_l_partkey <> '') * 100.0 / count(*), 1)::DOUBLE FROM wide
    """,
)
def table_coverage(t: Tables) -> DataFrame:
    tables = _wide_tables(t)
    return N.table_coverage(N.wide_extract(tables, "entity_id", _urgent(t)), tables)


# Matches of the strict form; doubled separators keep neighbouring matches apart.
_WORD = r"\p{L}\p{N}_"
STRICT_SQL = CELLS + rf""",
s AS (
  SELECT entity_id, table_name, field, row_pos,
    len(regexp_extract_all(regexp_replace(text, '([^{_WORD}])', '\1\1', 'g'), '(^|[^{_WORD}])AI($|[^{_WORD}])', 0, 'i')) AS n0,
    len(regexp_extract_all(regexp_replace(text, '([^A-Za-z])', '\1\1', 'g'), '(^|[^A-Za-z])AI($|[^A-Za-z])', 0, 'i')) AS n2
  FROM filled),
strict AS (SELECT * FROM s WHERE n0 + n2 > 0)
"""


@query(
    "wide_extract_summary",
    STRICT_SQL + """,
    e AS (SELECT entity_id, sum(n0 + n2) AS n FROM strict GROUP BY 1)
    SELECT count(*) AS entities, CAST(sum(n) AS BIGINT) AS total_matches, round(avg(n), 2) AS mean_matches,
           CAST(max(n) AS BIGINT) AS max_matches, CAST(6 AS BIGINT) AS columns FROM e
    """,
)
def wide_extract_summary(t: Tables) -> DataFrame:
    """The whole chain: strict entities, their match detail, and the extract over two tables."""
    return N.wide_extract_summary(strict_extract(t))


def strict_extract(t: Tables) -> DataFrame:
    wide = [
        N.WideTable("documents", t.documents.select("doc_id", "lang", "source"), "doc_id", ("source",)),
        N.WideTable("conversations", t.conversations.select("conv_id", "role"), "conv_id", ("role",)),
    ]
    return strict_plan(search_tables(t), wide)[0]


@query(
    "wide_group_distribution",
    STRICT_SQL + """,
    e AS (SELECT DISTINCT entity_id FROM strict)
    SELECT coalesce(lang, '') AS documents_lang, count(*) AS entities
    FROM e LEFT JOIN documents ON doc_id = entity_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20
    """,
)
def wide_group_distribution(t: Tables) -> DataFrame:
    return N.wide_group_distribution(strict_extract(t), "documents_lang")


@query(
    "column_coverage",
    LABELLED + """
    SELECT 'doc_id' AS column, count(doc_id) AS filled, round(count(doc_id) * 100.0 / count(*), 1)::DOUBLE AS coverage_pct FROM d
    UNION ALL SELECT 'lang', count(lang), round(count(lang) * 100.0 / count(*), 1) FROM d
    UNION ALL SELECT 'source', count(source), round(count(source) * 100.0 / count(*), 1) FROM d
    UNION ALL SELECT 'n_chars', count(n_chars), round(count(n_chars) * 100.0 / count(*), 1) FROM d
    UNION ALL SELECT 'quality', count(quality), round(count(quality) * 100.0 / count(*), 1) FROM d
    UNION ALL SELECT 'toxic', count(toxic), round(count(toxic) * 100.0 / count(*), 1) FROM d
    """,
)
def column_coverage(t: Tables) -> DataFrame:
    return N.column_coverage(labelled(t), k=50)


@query(
    "row_completeness",
    LABELLED + """
    SELECT count(*) FILTER (n = 6) AS perfect, count(*) FILTER (n > 6 * 0.8) AS mostly,
           count(*) FILTER (n > 6 * 0.5) AS basic, CAST(sum(n) AS BIGINT) AS filled_cells,
           count(*) * 6 AS total_cells, round(sum(n) * 100.0 / (count(*) * 6), 2)::DOUBLE AS completeness_pct
    FROM (SELECT (doc_id IS NOT NULL)::INT + (lang IS NOT NULL)::INT + (source IS NOT NULL)::INT
               + (n_chars IS NOT NULL)::INT + (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT AS n FROM d)
    """,
)
def row_completeness(t: Tables) -> DataFrame:
    return N.row_completeness(labelled(t))


@query("concat_tables", """
    SELECT 'C' || c_custkey AS id, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer
    UNION ALL SELECT 'S' || s_suppkey, s_name, s_acctbal, NULL FROM supplier
    """)
def concat_tables(t: Tables) -> DataFrame:
    customers = t.customer.select(
        F.concat(F.lit("C"), "c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"),
    )
    suppliers = t.supplier.select(
        F.concat(F.lit("S"), "s_suppkey").alias("id"), F.col("s_name").alias("name"),
        F.col("s_acctbal").alias("acctbal"),
    )
    return K.concat_tables([customers, suppliers])
