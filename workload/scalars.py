"""Row-level expressions over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.functions import scalars as P
from recordlens.operators import describe as D
from workload.frames import AMOUNTS, ENTITIES, LABELLED, entities, labelled, order_amounts
from workload.registry import Tables, query


@query(
    "coerce_number",
    r"""
    WITH v AS (
      SELECT regexp_extract(props, '[0-9]+') AS good, event_type AS bad FROM events)
    SELECT count(TRY_CAST(good AS DOUBLE)) AS numbers, count(TRY_CAST(bad AS DOUBLE)) AS bad_numbers,
           CAST(sum(TRY_CAST(good AS DOUBLE)) AS DOUBLE) AS total,
           CAST(sum(coalesce(TRY_CAST(bad AS DOUBLE), 0)) AS DOUBLE) AS bad_total
    FROM v
    """,
)
def coerce_number(t: Tables) -> DataFrame:
    good, bad = F.regexp_extract("props", "[0-9]+", 0), F.col("event_type")
    return t.events.agg(
        F.count(P.coerce_number(good)).alias("numbers"),
        F.count(P.coerce_number(bad)).alias("bad_numbers"),
        F.sum(P.coerce_number(good)).alias("total"),
        F.sum(P.coerce_number(bad, 0.0)).alias("bad_total"),
    )


@query(
    "parse_money",
    """
    SELECT o_orderkey,
           CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS amount
    FROM orders
    """,
)
def parse_money(t: Tables) -> DataFrame:
    # '1,234.50円', and '-1,234.50円' where the status is F.
    shown = F.concat(
        F.when(F.col("o_orderstatus") == "F", "-").otherwise(""),
        F.format_number("o_totalprice", 2), F.lit("円"),
    )
    return t.orders.select("o_orderkey", P.parse_money(shown).alias("amount"))


@query(
    "extract_numbers",
    """
    WITH n AS (
      SELECT doc_id, unnest(regexp_extract_all(replace(text, ',', ''), '\\d+')) AS s FROM documents),
    x AS (SELECT doc_id, TRY_CAST(s AS DOUBLE) AS v FROM n)
    SELECT doc_id, count(*) AS numbers, count(*) FILTER (v BETWEEN 1e3 AND 1e12) AS plausible,
           max(v) FILTER (v BETWEEN 1e3 AND 1e12) AS largest
    FROM x GROUP BY 1
    """.replace("\\\\", "\\"),
)
def extract_numbers(t: Tables) -> DataFrame:
    found = t.documents.select(
        "doc_id",
        P.extract_numbers(F.col("text")).alias("n"),
        P.extract_numbers(F.col("text"), P.AMOUNT_RANGE).alias("p"),
    )
    return found.filter(F.size("n") > 0).select(
        "doc_id",
        F.size("n").cast("long").alias("numbers"),
        F.size("p").cast("long").alias("plausible"),
        F.array_max("p").alias("largest"),
    )


@query(
    "field_key_filter",
    """
    WITH x AS (
      SELECT unnest([{'k': 'l_extendedprice', 'v': l_extendedprice}, {'k': 'l_discount', 'v': l_discount}]) AS e
      FROM lineitem)
    SELECT e.k AS field, count(*) AS n, CAST(sum(CAST(e.v AS DECIMAL(18, 2))) AS DOUBLE) AS total
    FROM x GROUP BY 1
    """,
)
def field_key_filter(t: Tables) -> DataFrame:
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    fields = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))])
    kept = t.lineitem.select(F.explode(P.field_key_filter(fields, ["price", "disc", "tax"], ["_tax"])).alias("field", "v"))
    return kept.groupBy("field").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("decimal(18,2)")).cast("double").alias("total")
    )


@query(
    "clip_text",
    "SELECT doc_id, substring(text, 1, 300) AS clip_300, substring(text, 1, 200) AS clip_200 FROM documents",
)
def clip_text(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", P.clip_text(F.col("text")).alias("clip_300"), P.clip_text(F.col("text"), 200).alias("clip_200")
    )


@query(
    "has_child_flags",
    ENTITIES + """
    SELECT c_custkey, orders_count > 0 AS has_orders, lineitem_count > 0 AS has_lineitem,
           events_count > 0 AS has_events FROM m
    """,
)
def has_child_flags(t: Tables) -> DataFrame:
    return entities(t).select("c_custkey", "has_orders", "has_lineitem", "has_events")


@query("total_related", ENTITIES + "SELECT c_custkey, total_related_records FROM m")
def total_related(t: Tables) -> DataFrame:
    return entities(t).select("c_custkey", "total_related_records")


@query(
    "decade_bucket",
    "SELECT o_orderkey, CAST(floor(year(o_orderdate) / 10.0) * 10 AS INTEGER) AS decade FROM orders",
)
def decade_bucket(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", P.decade_bucket(F.year("o_orderdate")).alias("decade"))


@query(
    "execution_rate",
    AMOUNTS + """
    SELECT o_orderkey, CASE WHEN o_totalprice > 0 THEN executed / o_totalprice * 100 ELSE 0 END AS rate FROM a
    """,
    "rate",
)
def execution_rate(t: Tables) -> DataFrame:
    return order_amounts(t).select(
        "o_orderkey", P.execution_rate(F.col("executed"), F.col("o_totalprice")).alias("rate")
    )


@query(
    "share_band",
    """
    WITH g AS (
      SELECT n_name, count(*) AS n, count(*) * 100.0 / (SELECT count(*) FROM customer) AS s
      FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
    SELECT CASE WHEN s > 10 THEN 'high' WHEN s > 5 THEN 'mid' ELSE 'low' END AS band,
           count(*) AS groups, CAST(sum(n) AS BIGINT) AS entities
    FROM g GROUP BY 1
    """,
)
def share_band(t: Tables) -> DataFrame:
    named = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return D.share_bands(named, "n_name")


@query(
    "duration_long",
    ENTITIES + """
    SELECT count(*) FILTER (end_year - start_year >= 6) AS n,
           count(*) FILTER (end_year - start_year >= 6) * 100.0 / count(*) AS pct,
           avg(end_year - start_year) FILTER (end_year - start_year >= 6) AS mean_duration,
           CAST(max(end_year - start_year) AS DOUBLE) AS max_duration
    FROM m
    """,
    "pct mean_duration",
)
def duration_long(t: Tables) -> DataFrame:
    return D.duration_long(entities(t), "start_year", "end_year", 6)


@query(
    "duration_long_groups",
    ENTITIES + "SELECT n_name, count(*) AS n FROM m WHERE end_year - start_year >= 6 GROUP BY 1",
)
def duration_long_groups(t: Tables) -> DataFrame:
    return D.duration_long_groups(entities(t), "start_year", "end_year", "n_name", 6)


@query(
    "duration_longest",
    ENTITIES + """
    SELECT c_custkey, c_name, n_name, CAST(end_year - start_year AS DOUBLE) AS duration
    FROM m WHERE end_year - start_year >= 6 ORDER BY duration DESC, c_custkey LIMIT 3
    """,
)
def duration_longest(t: Tables) -> DataFrame:
    return D.duration_longest(entities(t), "start_year", "end_year", "c_custkey", ["c_name", "n_name"], 6)


@query(
    "null_policy",
    LABELLED + """
    SELECT doc_id, CAST(coalesce(quality, 0) AS DOUBLE) AS quality,
           coalesce(CASE WHEN toxic = 1 THEN 'yes' END, '') AS toxic,
           CASE WHEN lang = 'fr' THEN NULL ELSE lang END AS lang
    FROM d
    """,
)
def null_policy(t: Tables) -> DataFrame:
    rows = labelled(t).select(
        "doc_id", "quality",
        F.when(F.col("toxic") == 1, "yes").alias("toxic"),
        F.when(F.col("lang") == "fr", "nan").otherwise(F.col("lang")).alias("lang"),
    )
    policy = {"quality": "zero", "toxic": "empty", "lang": "missing", "not_there": "zero"}
    return P.null_policy(rows, policy)


@query(
    "diagnose_unmatched",
    """
    WITH n AS (
      SELECT DISTINCT p_name || CASE WHEN p_type = 'PROMO' THEN '（AI ' || p_brand || '）' ELSE '' END
             || CASE WHEN p_type = 'ECONOMY' THEN repeat(' ' || p_brand, 6) ELSE '' END AS name FROM part)
    SELECT name, CASE WHEN contains(name, 'AI') THEN 'AI' ELSE '' END AS keywords_found,
           NOT contains(name, 'AI') AS no_keyword, CAST(length(name) AS INTEGER) AS name_length,
           length(name) > 50 AS is_long, contains(name, '（') OR contains(name, '）') AS has_brackets
    FROM n
    """,
)
def diagnose_unmatched(t: Tables) -> DataFrame:
    name = F.concat(
        "p_name",
        F.when(F.col("p_type") == "PROMO", F.concat(F.lit("（AI "), "p_brand", F.lit("）"))).otherwise(""),
        F.when(F.col("p_type") == "ECONOMY", F.repeat(F.concat(F.lit(" "), "p_brand"), F.lit(6))).otherwise(""),
    )
    return P.diagnose_unmatched(t.part.select(name.alias("name")).distinct(), "name")


@query(
    "prefix_columns",
    """
    SELECT o_orderkey, o_custkey AS orders_o_custkey, o_orderdate AS orders_o_orderdate,
           o_orderpriority AS orders_o_orderpriority, o_orderstatus AS orders_o_orderstatus,
           o_totalprice AS orders_o_totalprice FROM orders
    """,
)
def prefix_columns(t: Tables) -> DataFrame:
    return P.prefix_columns(t.orders, "orders", ["o_orderkey"])
