"""Amount lists and statistics over orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.functions.quantiles import NEAREST
from recordlens.functions.runtime import materialize
from recordlens.functions.scalars import top_list_tier
from recordlens.operators import amounts as A
from recordlens.operators import master as M
from recordlens.plans.top_list import top_list_report as top_list_plan
from workload.frames import AMOUNTS, GROUP_ORDERS, LINE_ORDER, group_orders, order_amounts
from workload.registry import Tables, query

# Scaled to the test amounts.
LIMITS = (1e5, 2e5, 4e5)
TOP_LIMITS = (4.96e5, 4.99e5)

_TOP = AMOUNTS.rstrip() + """,
th AS (SELECT quantile_cont(o_totalprice, 0.99) AS th FROM a WHERE o_totalprice > 0),
top AS (SELECT a.*, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank
        FROM a, th WHERE o_totalprice >= th)
"""
_NEAREST = """,
n AS (SELECT *, row_number() OVER (ORDER BY o_totalprice) AS r, count(*) OVER () AS c FROM orders WHERE o_totalprice > 0),
th AS (SELECT max(o_totalprice) AS th FROM n WHERE r = floor(c * 0.99::DOUBLE) + 1)
"""


def _yearly(t: Tables) -> DataFrame:
    return t.orders.select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("year"), "o_totalprice")


@query(
    "pick_year_record",
    """
    SELECT o_custkey, o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice FROM orders
    QUALIFY row_number() OVER (
      PARTITION BY o_custkey ORDER BY CASE WHEN year(o_orderdate) = 1998 THEN 0 ELSE 1 END, o_orderkey) = 1
    """,
)
def pick_year_record(t: Tables) -> DataFrame:
    return A.pick_year_first(_yearly(t), "o_custkey", "year", 1998, ["o_orderkey"])


@query(
    "pick_year_sum",
    """
    SELECT o_custkey, CASE WHEN count(*) FILTER (year(o_orderdate) = 1998) > 0
        THEN max_by(o_totalprice, o_orderkey) FILTER (year(o_orderdate) = 1998)
        ELSE sum(CAST(o_totalprice AS DECIMAL(18, 2)))::DOUBLE END AS o_totalprice
    FROM orders GROUP BY 1
    """,
    "o_totalprice",
)
def pick_year_sum(t: Tables) -> DataFrame:
    return A.pick_year_sum(_yearly(t), "o_custkey", "year", 1998, ["o_orderkey"], "o_totalprice", [])


@query(
    "amount_rank",
    """
    SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders
    """,
)
def amount_rank(t: Tables) -> DataFrame:
    return A.amount_rank(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query(
    "top_percent_list",
    _TOP + """
    SELECT o_orderkey, c_name, n_name, o_totalprice, executed, rank,
           round(executed / o_totalprice * 100, 1) AS execution_rate FROM top
    """,
    "executed",
)
def top_percent_list(t: Tables) -> DataFrame:
    return A.top_percent_list(
        order_amounts(t), "o_totalprice", "o_orderkey", ["c_name", "n_name"], executed="executed"
    )


@query(
    "top_percent_nearest",
    "WITH one AS (SELECT 1)" + _NEAREST + """
    SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank
    FROM orders, th WHERE o_totalprice >= th
    """,
)
def top_percent_nearest(t: Tables) -> DataFrame:
    return A.top_percent_list(t.orders, "o_totalprice", "o_orderkey", [], rule=NEAREST)


@query(
    "top_five_percent",
    """
    WITH th AS (SELECT quantile_cont(o_totalprice, 0.95) AS th FROM orders)
    SELECT count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18, 2)))::DOUBLE AS total
    FROM orders, th WHERE o_totalprice >= th
    """,
    "total",
)
def top_five_percent(t: Tables) -> DataFrame:
    return A.top_percent(t.orders, "o_totalprice", 5.0).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total")
    )


@query(
    "top_list_tier",
    _TOP + """
    SELECT o_orderkey, CASE WHEN o_totalprice >= 4.99e5 THEN 'mega' WHEN o_totalprice >= 4.96e5 THEN 'large'
           ELSE 'medium' END AS tier FROM top
    """,
)
def tier_of_top_list(t: Tables) -> DataFrame:
    top = A.top_percent(t.orders, "o_totalprice")
    return top.select("o_orderkey", top_list_tier(F.col("o_totalprice"), TOP_LIMITS).alias("tier"))


@query(
    "top_share_by_group",
    _TOP + """
    SELECT n_name, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18, 2)))::DOUBLE AS total,
           sum(CAST(o_totalprice AS DECIMAL(18, 2)))::DOUBLE / count(*) AS mean,
           count(*) * 100.0 / (SELECT count(*) FROM top) AS pct FROM top GROUP BY 1
    """,
    "total mean pct",
)
def top_share_by_group(t: Tables) -> DataFrame:
    top = materialize(A.top_percent(group_orders(t), "o_totalprice"))
    return A.top_share_by_group(top, "n_name", "o_totalprice")


@query(
    "top_concentration",
    "WITH one AS (SELECT 1)" + _NEAREST + """,
    x AS (SELECT CAST(o_totalprice AS DECIMAL(18, 2)) AS p, o_totalprice >= th AS in_top, th FROM orders, th)
    SELECT count(*) AS entities, count(*) FILTER (in_top) AS top_entities, sum(p) FILTER (in_top)::DOUBLE AS top_amount,
           sum(p)::DOUBLE AS total_amount, max(th) AS threshold,
           sum(p) FILTER (in_top)::DOUBLE / sum(p)::DOUBLE * 100 AS share_pct FROM x
    """.replace("sum(p) FILTER (in_top)::DOUBLE", "CAST(sum(p) FILTER (in_top) AS DOUBLE)"),
    "top_amount total_amount threshold share_pct",
)
def top_concentration(t: Tables) -> DataFrame:
    return A.top_concentration(t.orders, "o_totalprice")


_STATS = AMOUNTS.rstrip() + """,
st AS (
  SELECT count(*) AS with_amount, sum(CAST(o_totalprice AS DECIMAL(18, 2)))::DOUBLE / count(*) AS mean,
         stddev_pop(o_totalprice) AS std, min(o_totalprice) AS min, max(o_totalprice) AS max,
         sum(CAST(o_totalprice AS DECIMAL(18, 2)))::DOUBLE AS total,
         avg(executed / o_totalprice * 100) FILTER (executed > 0) AS mean_rate,
         count(*) FILTER (executed > 0) AS with_execution,
         quantile_cont(o_totalprice, 0.5) AS p50, quantile_cont(o_totalprice, 0.75) AS p75,
         quantile_cont(o_totalprice, 0.9) AS p90, quantile_cont(o_totalprice, 0.95) AS p95,
         quantile_cont(o_totalprice, 0.99) AS p99,
         quantile_cont(CASE WHEN executed > 0 THEN executed / o_totalprice * 100 END, 0.5) AS median_rate
  FROM a WHERE o_totalprice > 0)
"""


@query(
    "amount_stats",
    _STATS + """
    SELECT (SELECT count(*) FROM a) AS entities, with_amount * 100.0 / (SELECT count(*) FROM a) AS coverage_pct, * FROM st
    """,
    "coverage_pct mean std total mean_rate p50 p75 p90 p95 p99 median_rate",
)
def amount_stats(t: Tables) -> DataFrame:
    # Stored, as every quantile goes over it.
    amounts = materialize(order_amounts(t).select("o_totalprice", "executed"))
    return A.amount_stats(amounts, "o_totalprice", "executed")


@query(
    "skew_flag",
    _STATS + "SELECT mean, p50 AS median, mean > p50 * 2 AS is_skewed FROM st",
    "mean median",
)
def skew_flag(t: Tables) -> DataFrame:
    return A.skew_flag(A.amount_stats(t.orders, "o_totalprice"))


@query(
    "group_amount_ranking",
    GROUP_ORDERS + """
    SELECT CAST(row_number() OVER (ORDER BY s DESC, n_name) AS INTEGER) AS rank, n_name, s::DOUBLE AS total, n, s::DOUBLE / n AS mean
    FROM (SELECT n_name, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS s, count(*) AS n FROM g GROUP BY 1)
    QUALIFY rank <= 10
    """,
    "total mean",
)
def group_amount_ranking(t: Tables) -> DataFrame:
    return A.group_amount_ranking(group_orders(t), "n_name", "o_totalprice")


@query(
    "group_amount_stats",
    GROUP_ORDERS + """
    SELECT n_name, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18, 2)))::DOUBLE AS total,
           sum(CAST(o_totalprice AS DECIMAL(18, 2)))::DOUBLE / count(*) AS mean,
           quantile_cont(o_totalprice, 0.5) AS median, max(o_totalprice) AS max
    FROM g GROUP BY 1 HAVING count(*) >= 3 ORDER BY 3 DESC, 1 LIMIT 10
    """,
    "total mean median",
)
def group_amount_stats(t: Tables) -> DataFrame:
    return A.group_amount_stats(group_orders(t), "n_name", "o_totalprice")


def _trimmed_sql(where: str) -> str:
    return f"""
    WITH q AS (SELECT quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM orders),
    k AS (SELECT o_totalprice FROM orders, q WHERE {where})
    SELECT count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18, 2)))::DOUBLE / count(*) AS mean,
           stddev_pop(o_totalprice) AS std, min(o_totalprice) AS min, max(o_totalprice) AS max,
           quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.25) AS q25,
           quantile_cont(o_totalprice, 0.75) AS q75, quantile_cont(o_totalprice, 0.9) AS q90,
           quantile_cont(o_totalprice, 0.95) AS q95 FROM k
    """


@query(
    "trimmed_amount_stats", _trimmed_sql("o_totalprice BETWEEN lo AND hi"), "mean std median q25 q75 q90 q95"
)
def trimmed_amount_stats(t: Tables) -> DataFrame:
    return A.trimmed_amount_stats(t.orders, "o_totalprice")


@query("trimmed_top_stats", _trimmed_sql("o_totalprice <= hi"), "mean std median q25 q75 q90 q95")
def trimmed_top_stats(t: Tables) -> DataFrame:
    return A.trimmed_amount_stats(t.orders, "o_totalprice", low=None)


@query(
    "size_tier",
    """
    SELECT CASE WHEN o_totalprice < 1e5 THEN 'small' WHEN o_totalprice < 2e5 THEN 'medium'
                WHEN o_totalprice < 4e5 THEN 'large' ELSE 'mega' END AS tier, count(*) AS n
    FROM orders GROUP BY 1
    """,
)
def size_tier(t: Tables) -> DataFrame:
    return A.size_tiers(t.orders, "o_totalprice", LIMITS)


@query(
    "amount_coverage",
    """
    WITH s AS (SELECT l_extendedprice AS p, row_number() OVER (ORDER BY l_extendedprice) AS r, count(*) OVER () AS c
               FROM lineitem WHERE l_extendedprice > 0)
    SELECT (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS entities_with_records,
           round((SELECT count(DISTINCT l_orderkey) FROM lineitem) * 100.0 / (SELECT count(*) FROM orders), 1)::DOUBLE AS coverage_pct,
           count(*) AS amounts, sum(CAST(p AS DECIMAL(18, 2)))::DOUBLE / count(*) AS mean, max(p) AS max, min(p) AS min,
           max(p) FILTER (r = c // 2 + 1) AS median FROM s
    """,
    "mean median",
)
def amount_coverage(t: Tables) -> DataFrame:
    return A.amount_coverage(t.lineitem, t.orders, "l_orderkey", "l_extendedprice")


@query(
    "top_list_report",
    AMOUNTS.rstrip() + """,
    lc AS (SELECT l_orderkey AS k, count(*) AS lines FROM lineitem GROUP BY 1),
    th AS (SELECT quantile_cont(o_totalprice, 0.99) AS th FROM a WHERE o_totalprice > 0),
    top AS (SELECT a.*, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank
            FROM a, th WHERE o_totalprice >= th),
    sh AS (SELECT n_name, count(*) AS group_entities, count(*) * 100.0 / (SELECT count(*) FROM top) AS group_pct
           FROM top GROUP BY 1)
    SELECT rank, o_orderkey, o_custkey, n_name, o_totalprice, coalesce(lines, 0) AS lineitem_count,
           coalesce(lines, 0) > 0 AS has_lineitem, group_entities, group_pct,
           o_totalprice * 100 / (SELECT sum(CAST(o_totalprice AS DECIMAL(18, 2)))::DOUBLE FROM top) AS amount_pct
    FROM top LEFT JOIN lc ON lc.k = o_orderkey JOIN sh USING (n_name)
    """,
    "group_pct amount_pct",
)
def top_list_report(t: Tables) -> DataFrame:
    """Orders with their nested lines, the ranked top-1% list, and each group's share of it."""
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    groups = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("o_custkey"), "n_name"
    )
    report = top_list_plan(
        t.orders.join(groups, "o_custkey"), "o_orderkey", "o_totalprice", "n_name",
        {"lineitem": M.Child(lines, LINE_ORDER)}, ["o_custkey"],
    )
    return report.select(
        "rank", "o_orderkey", "o_custkey", "n_name", "o_totalprice", "lineitem_count", "has_lineitem",
        "group_entities", "group_pct", "amount_pct",
    )
