"""Distributions, time, density, correlation, diversity, cohorts over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.functions.runtime import materialize
from recordlens.operators import cohorts as C
from recordlens.operators import describe as D
from recordlens.operators import master as M
from recordlens.operators.profile import completeness
from workload.frames import (
    COUNTS, ENTITIES, GROUP_ORDERS, LABELLED, LINE_ORDER, entities, group_orders, labelled, stored_entities,
)
from workload.registry import Tables, query

CHILDREN = ["orders", "lineitem", "events"]
MEASURES = COUNTS + ["total_related_records"]


def named_customers(t: Tables) -> DataFrame:
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "c_mktsegment", "n_name"
    )


_GROUPS = """
WITH g AS (
  SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
total AS (SELECT count(*) AS total FROM customer),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, n_name) AS rank FROM g)
"""


@query(
    "group_distribution",
    _GROUPS + """
    SELECT n_name, n, round(n * 100.0 / total, 1)::DOUBLE AS pct,
           CASE WHEN n * 100.0 / total > 10 THEN 'high' WHEN n * 100.0 / total > 5 THEN 'mid' ELSE 'low' END AS band
    FROM r, total WHERE rank <= 10
    """,
)
def group_distribution(t: Tables) -> DataFrame:
    return D.group_distribution(named_customers(t), "n_name", 10)


@query(
    "category_distribution",
    """
    SELECT c_mktsegment, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM customer), 1)::DOUBLE AS pct,
           'high' AS band FROM customer GROUP BY 1
    """,
)
def category_distribution(t: Tables) -> DataFrame:
    return D.group_distribution(t.customer, "c_mktsegment")


@query(
    "category_count_stats",
    """
    SELECT count(*) AS groups, avg(n) AS mean, stddev_samp(n) AS std, max(n) AS max, min(n) AS min,
           quantile_cont(n, 0.5)::DOUBLE AS median, stddev_samp(n) > avg(n) AS uneven
    FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)
    """,
    "mean std median",
)
def category_count_stats(t: Tables) -> DataFrame:
    return D.group_count_stats(t.customer, "c_mktsegment")


@query(
    "group_count_stats",
    _GROUPS + """
    SELECT count(*) AS groups, avg(n) AS mean, stddev_samp(n) AS std, max(n) AS max, min(n) AS min,
           quantile_cont(n, 0.5)::DOUBLE AS median, stddev_samp(n) > avg(n) AS uneven FROM g
    """,
    "mean std median",
)
def group_count_stats(t: Tables) -> DataFrame:
    return D.group_count_stats(named_customers(t), "n_name")


@query(
    "concentration_ratio",
    _GROUPS + """
    SELECT sum(n) FILTER (rank <= 3) * 100.0 / max(total) AS top3_pct,
           sum(n) FILTER (rank <= 5) * 100.0 / max(total) AS top5_pct FROM r, total
    """,
    "top3_pct top5_pct",
)
def concentration_ratio(t: Tables) -> DataFrame:
    return D.concentration_ratio(named_customers(t), "n_name")


# --- time -----------------------------------------------------------------


def _years(t: Tables) -> DataFrame:
    return t.orders.select(F.year("o_orderdate").cast("string").alias("year"))


@query(
    "start_year_stats",
    """
    WITH y AS (SELECT year(o_orderdate) AS y FROM orders)
    SELECT CAST(min(y) AS INTEGER) AS min_year, CAST(max(y) AS INTEGER) AS max_year, avg(y) AS mean_year,
           (SELECT CAST(y AS INTEGER) FROM y GROUP BY y ORDER BY count(*) DESC, y LIMIT 1) AS mode_year,
           count(*) AS n, quantile_cont(y, 0.5)::DOUBLE AS median_year FROM y
    """,
    "mean_year median_year",
)
def start_year_stats(t: Tables) -> DataFrame:
    return D.start_year_stats(_years(t), "year")


@query(
    "decade_histogram",
    """
    SELECT CAST(floor(year(o_orderdate) / 10.0) * 10 AS INTEGER) AS decade, count(*) AS n,
           count(*) * 100.0 / (SELECT count(*) FROM orders) AS pct FROM orders GROUP BY 1
    """,
    "pct",
)
def decade_histogram(t: Tables) -> DataFrame:
    return D.decade_histogram(_years(t), "year")


@query(
    "recent_year_trend",
    """
    SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders
    WHERE year(o_orderdate) >= 1997 GROUP BY 1 ORDER BY 1 DESC LIMIT 3
    """,
)
def recent_year_trend(t: Tables) -> DataFrame:
    return D.recent_year_trend(_years(t), "year", 1997, 3)


@query(
    "period_shares",
    """
    SELECT count(*) AS n, count(*) FILTER (year(o_orderdate) >= 2000) * 100.0 / count(*) AS recent_pct,
           count(*) FILTER (year(o_orderdate) BETWEEN 1998 AND 1999) * 100.0 / count(*) AS middle_pct,
           count(*) FILTER (year(o_orderdate) BETWEEN 1995 AND 1997) * 100.0 / count(*) AS early_pct FROM orders
    """,
    "recent_pct middle_pct early_pct",
)
def period_shares(t: Tables) -> DataFrame:
    periods = {"recent_pct": (2000, None), "middle_pct": (1998, 2000), "early_pct": (1995, 1998)}
    return D.period_shares(_years(t), "year", periods)


@query(
    "group_recency",
    GROUP_ORDERS + """
    SELECT n_name, count(*) AS n, count(*) FILTER (year >= 2000) * 100.0 / count(*) AS recent_pct,
           avg(year) AS mean_year, CAST(min(year) AS INTEGER) AS oldest, CAST(max(year) AS INTEGER) AS newest
    FROM g GROUP BY 1 ORDER BY count(*) DESC, n_name LIMIT 10
    """,
    "recent_pct mean_year",
)
def group_recency(t: Tables) -> DataFrame:
    return D.group_recency(group_orders(t), "n_name", "year", 2000)


@query(
    "density_by_decade",
    ENTITIES + """
    SELECT CAST(floor(start_year / 10.0) * 10 AS INTEGER) AS decade, count(*) AS n,
           avg(total_related_records) AS mean_records, max(total_related_records) AS max_records
    FROM m WHERE floor(start_year / 10.0) * 10 BETWEEN 1990 AND 2020 GROUP BY 1
    """,
    "mean_records",
)
def density_by_decade(t: Tables) -> DataFrame:
    return D.density_by_decade(entities(t), "start_year", "total_related_records")


@query(
    "category_recency",
    GROUP_ORDERS + """
    SELECT c_mktsegment, count(*) AS n, avg(year) AS mean_year,
           count(*) FILTER (year >= 2000) * 100.0 / count(*) AS recent_pct FROM g GROUP BY 1
    """,
    "mean_year recent_pct",
)
def category_recency(t: Tables) -> DataFrame:
    return D.category_recency(group_orders(t), "c_mktsegment", "year", 2000)


# --- density --------------------------------------------------------------


def _density_sql(c: str) -> str:
    return f"""
    SELECT '{c}' AS child, count(*) FILTER ({c}_count > 0) AS entities_with_data,
           count(*) FILTER ({c}_count > 0) * 100.0 / count(*) AS coverage_pct, avg({c}_count) AS mean,
           max({c}_count) AS max, stddev_samp({c}_count) AS std, CAST(sum({c}_count) AS BIGINT) AS total,
           quantile_cont({c}_count, 0.5)::DOUBLE AS median FROM m"""


_DENSITY = "\nUNION ALL".join(_density_sql(c) for c in CHILDREN)


@query("child_density", ENTITIES + _DENSITY, "coverage_pct mean std median")
def child_density(t: Tables) -> DataFrame:
    return D.child_density(stored_entities(t), COUNTS)


@query(
    "child_density_from_nested",
    """
    WITH n AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1),
    s AS (SELECT *, row_number() OVER (ORDER BY n) AS r, count(*) OVER () AS c FROM n)
    SELECT 'lineitem' AS child, round(count(*) * 100.0 / (SELECT count(*) FROM orders), 1)::DOUBLE AS coverage_pct,
           round(avg(n), 1) AS mean, CAST(sum(n) AS BIGINT) AS total, max(n) AS max,
           max(n) FILTER (r = c // 2 + 1) AS median FROM s
    """,
)
def child_density_from_nested(t: Tables) -> DataFrame:
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), *LINE_ORDER)
    # A low limit, so that many orders come in several chunks.
    nested = M.nest_children(lines, "o_orderkey", M.Child(lines, LINE_ORDER), limit=2)
    joined = t.orders.select("o_orderkey").join(nested, "o_orderkey", "left")
    return D.child_density_from_nested(joined.withColumnRenamed("records", "lineitem"), ["lineitem"], "o_orderkey")


@query(
    "related_distribution",
    ENTITIES + """
    SELECT avg(total_related_records) AS mean, stddev_samp(total_related_records) AS std,
           min(total_related_records) AS min, max(total_related_records) AS max,
           quantile_cont(total_related_records, 0.25)::DOUBLE AS p25,
           quantile_cont(total_related_records, 0.5)::DOUBLE AS median,
           quantile_cont(total_related_records, 0.75)::DOUBLE AS p75,
           quantile_cont(total_related_records, 0.9)::DOUBLE AS p90,
           quantile_cont(total_related_records, 0.95)::DOUBLE AS p95 FROM m
    """,
    "mean std p25 median p75 p90 p95",
)
def related_distribution(t: Tables) -> DataFrame:
    return D.related_distribution(stored_entities(t), "total_related_records")


@query(
    "highest_lowest",
    ENTITIES.rstrip() + ",\nd AS (" + _DENSITY + ")\n"
    + " UNION ALL ".join(
        f"""SELECT '{m}' AS measure,
        (SELECT child FROM d ORDER BY {m} DESC, child DESC LIMIT 1) AS highest, max({m})::DOUBLE AS highest_value,
        (SELECT child FROM d ORDER BY {m}, child LIMIT 1) AS lowest, min({m})::DOUBLE AS lowest_value FROM d"""
        for m in ("coverage_pct", "mean", "total")
    ),
    "highest_value lowest_value",
)
def highest_lowest(t: Tables) -> DataFrame:
    return D.highest_lowest(D.child_density(stored_entities(t), COUNTS), ["coverage_pct", "mean", "total"])


@query(
    "flag_frequency",
    LABELLED + """,
    f AS (
      SELECT 'quality' AS flag, count(*) FILTER (quality > 0) AS n, count(*) FILTER (quality > 0) * 100.0 / count(*) AS pct FROM d
      UNION ALL SELECT 'toxic', count(*) FILTER (toxic > 0), count(*) FILTER (toxic > 0) * 100.0 / count(*) FROM d
      UNION ALL SELECT 'long', count(*) FILTER (n_chars > 2000), count(*) FILTER (n_chars > 2000) * 100.0 / count(*) FROM d)
    SELECT *, flag = (SELECT flag FROM f ORDER BY n DESC, flag DESC LIMIT 1) AS is_top FROM f
    """,
    "pct",
)
def flag_frequency(t: Tables) -> DataFrame:
    rows = labelled(t).withColumn("long", F.when(F.col("n_chars") > 2000, "1").otherwise("no"))
    return D.flag_frequency(rows, ["quality", "toxic", "long"])


_PAIRS = [(a, b) for i, a in enumerate(MEASURES) for b in MEASURES[i + 1:]]
_CORR = " UNION ALL ".join(f"SELECT '{a}' AS var1, '{b}' AS var2, corr({a}, {b}) AS r FROM m" for a, b in _PAIRS)


@query("correlation_matrix", ENTITIES + _CORR, "r")
def correlation_matrix(t: Tables) -> DataFrame:
    return D.correlation_matrix(entities(t), MEASURES)


@query(
    "correlation_pairs",
    ENTITIES + f"""
    SELECT var1, var2, r, CASE WHEN abs(r) > 0.7 THEN 'strong' ELSE 'moderate' END AS band, abs(r) > 0.5 AS is_high
    FROM ({_CORR}) WHERE abs(r) > 0.3
    """,
    "r",
)
def correlation_pairs(t: Tables) -> DataFrame:
    return D.correlation_pairs(D.correlation_matrix(entities(t), MEASURES))


@query(
    "group_density",
    ENTITIES + """
    SELECT n_name, round(avg(total_related_records), 2) AS mean, round(stddev_samp(total_related_records), 2) AS std,
           count(*) AS n FROM m GROUP BY 1 HAVING count(*) >= 10 ORDER BY 2 DESC, 1 LIMIT 10
    """,
)
def group_density(t: Tables) -> DataFrame:
    return D.group_density(entities(t), "n_name", "total_related_records")


_SPECIAL = """,
o AS (SELECT avg(orders_count) AS a0, avg(lineitem_count) AS a1, avg(events_count) AS a2 FROM m),
b AS (
  SELECT n_name, count(*) AS n, avg(total_related_records) AS mean_total, stddev_samp(total_related_records) AS std_total,
         avg(orders_count) AS m0, avg(lineitem_count) AS m1, avg(events_count) AS m2
  FROM m GROUP BY 1 ORDER BY count(*) DESC, n_name LIMIT 15),
s AS (
  SELECT n_name, n, mean_total, std_total, 'orders' AS child, m0 / a0 AS specialization FROM b, o WHERE n >= 5
  UNION ALL SELECT n_name, n, mean_total, std_total, 'lineitem', m1 / a1 FROM b, o WHERE n >= 5
  UNION ALL SELECT n_name, n, mean_total, std_total, 'events', m2 / a2 FROM b, o WHERE n >= 5)
"""


@query(
    "specialization_index",
    ENTITIES.rstrip() + _SPECIAL + "SELECT *, specialization >= 1.5 AS is_special FROM s",
    "mean_total std_total specialization",
)
def specialization_index(t: Tables) -> DataFrame:
    return D.specialization_index(stored_entities(t), "n_name", COUNTS, "total_related_records")


# --- recipients and goals -------------------------------------------------

_DIVERSITY = """
WITH r AS (
  SELECT l_partkey, l_suppkey, sum(CAST(l_extendedprice AS DECIMAL(18, 2)))::DOUBLE AS s FROM lineitem GROUP BY 1, 2),
c AS (SELECT l_partkey, count(DISTINCT l_returnflag || l_linestatus) AS contract_types FROM lineitem GROUP BY 1),
dv AS (
  SELECT r.l_partkey, count(*) AS recipients, max(contract_types) AS contract_types, sum(s) AS amount,
         1.0::DOUBLE / count(*) AS hhi_equal, sum(s * s) / (sum(s) * sum(s)) AS hhi_amount
  FROM r JOIN c ON c.l_partkey = r.l_partkey GROUP BY 1)
"""


def diversity(t: Tables) -> DataFrame:
    lines = t.lineitem.select(
        "l_partkey", "l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("contract"), "l_extendedprice"
    )
    return D.recipient_diversity(lines, "l_partkey", "l_suppkey", "contract", "l_extendedprice")


@query("recipient_diversity", _DIVERSITY + "SELECT * FROM dv", "amount hhi_equal hhi_amount")
def recipient_diversity(t: Tables) -> DataFrame:
    return diversity(t)


_LIMITS = (20, 27, 34)


@query(
    "diversity_stats",
    _DIVERSITY + """
    SELECT count(*) AS entities, avg(recipients) AS mean_recipients, max(recipients) AS max_recipients,
           min(recipients) AS min_recipients, stddev_pop(recipients) AS std_recipients,
           avg(contract_types) AS mean_contract_types, max(contract_types) AS max_contract_types,
           stddev_pop(contract_types) AS std_contract_types, avg(hhi_equal) AS mean_hhi,
           count(*) FILTER (recipients <= 20) AS simple, count(*) FILTER (recipients > 20 AND recipients <= 27) AS moderate,
           count(*) FILTER (recipients > 27 AND recipients <= 34) AS complex, count(*) FILTER (recipients > 34) AS very_complex,
           quantile_cont(recipients, 0.5)::DOUBLE AS median_recipients,
           quantile_cont(contract_types, 0.5)::DOUBLE AS median_contract_types,
           quantile_cont(hhi_equal, 0.5)::DOUBLE AS median_hhi FROM dv
    """,
    "mean_recipients std_recipients mean_contract_types std_contract_types mean_hhi median_recipients "
    "median_contract_types median_hhi",
)
def diversity_stats(t: Tables) -> DataFrame:
    return D.diversity_stats(materialize(diversity(t)), _LIMITS)


@query(
    "diversity_top",
    _DIVERSITY + """
    SELECT * FROM (SELECT 'recipients' AS measure, l_partkey, recipients AS value FROM dv ORDER BY 3 DESC, 2 LIMIT 5)
    UNION ALL
    SELECT * FROM (SELECT 'contract_types', l_partkey, contract_types FROM dv ORDER BY 3 DESC, 2 LIMIT 5)
    """,
)
def diversity_top(t: Tables) -> DataFrame:
    return D.diversity_top(diversity(t), "l_partkey")


@query(
    "goal_stats",
    """
    WITH g AS (SELECT conv_id, count(*) AS n, count(text) AS f FROM conversations GROUP BY 1)
    SELECT count(*) AS entities, avg(n) AS mean, max(n) AS max, min(n) AS min, stddev_pop(n) AS std,
           CAST(sum(f) AS BIGINT) AS named_fields, quantile_cont(n, 0.5)::DOUBLE AS median FROM g
    """,
    "mean std median",
)
def goal_stats(t: Tables) -> DataFrame:
    from recordlens.functions.scalars import matching_fields

    return D.goal_stats(t.conversations, "conv_id", matching_fields(t.conversations.columns, ["tex"]))


# --- top and bottom -------------------------------------------------------


@query(
    "top_k_entities",
    "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
)
def top_k_entities(t: Tables) -> DataFrame:
    return D.top_k_entities(t.orders, "o_totalprice", "o_orderkey", ["o_orderpriority"], 10)


_Q = "(SELECT quantile_cont({c}, {p}) FROM m)"


@query(
    "quantile_outliers",
    ENTITIES + """,
    q AS (SELECT quantile_cont(total_related_records, 0.95)::DOUBLE AS p95, quantile_cont(total_related_records, 0.99)::DOUBLE AS p99 FROM m)
    SELECT count(*) FILTER (total_related_records >= p95) AS high_count,
           count(*) FILTER (total_related_records >= p99) AS ultra_count, max(p95) AS p95, max(p99) AS p99 FROM m, q
    """,
    "p95 p99",
)
def quantile_outliers(t: Tables) -> DataFrame:
    return D.quantile_outliers(stored_entities(t), "total_related_records")


@query(
    "outlier_entities",
    ENTITIES + f"""
    SELECT c_custkey, c_name, n_name, total_related_records FROM m
    WHERE total_related_records >= {_Q.format(c='total_related_records', p=0.95)}
    ORDER BY total_related_records DESC, c_custkey LIMIT 5
    """,
)
def outlier_entities(t: Tables) -> DataFrame:
    return D.outlier_entities(stored_entities(t), "total_related_records", "c_custkey", ["c_name", "n_name"])


@query(
    "per_table_outliers",
    ENTITIES.rstrip() + ",\nlong AS ("
    + " UNION ALL ".join(f"SELECT c_custkey, '{c}' AS child, {c}_count AS n FROM m" for c in CHILDREN)
    + """),
    th AS (SELECT child, quantile_cont(n, 0.95)::DOUBLE AS threshold FROM long GROUP BY 1),
    x AS (SELECT long.*, threshold, count(*) OVER (PARTITION BY long.child) AS entities,
                 row_number() OVER (PARTITION BY long.child ORDER BY n DESC, c_custkey) AS rank
          FROM long JOIN th ON th.child = long.child WHERE threshold > 0 AND n >= threshold)
    SELECT child, threshold, entities, CAST(rank AS INTEGER) AS rank, c_custkey, n FROM x WHERE rank <= 3
    """,
    "threshold",
)
def per_table_outliers(t: Tables) -> DataFrame:
    return D.per_table_outliers(stored_entities(t), COUNTS, "c_custkey")


# --- cohorts --------------------------------------------------------------


@query(
    "cohort_summary",
    ENTITIES + """,
    q AS (SELECT quantile_cont(total_related_records, 0.95)::DOUBLE AS th FROM m)
    SELECT max(th) AS threshold, count(*) AS n, count(*) * 100.0 / (SELECT count(*) FROM m) AS pct,
           avg(total_related_records) AS mean, max(total_related_records) AS max,
           count(*) FILTER (events_count > 0) * 100.0 / count(*) AS events_count_pct
    FROM m, q WHERE total_related_records >= th
    """,
    "threshold pct mean events_count_pct",
)
def cohort_summary(t: Tables) -> DataFrame:
    return C.cohort_summary(stored_entities(t), "total_related_records", flags=["events_count"])


@query(
    "cohort_profile",
    ENTITIES + f""",
    x AS (SELECT * FROM m WHERE total_related_records >= {_Q.format(c='total_related_records', p=0.95)})
    SELECT 'n_name' AS dimension, n_name AS value, count(*) AS n FROM x GROUP BY 2
    UNION ALL SELECT 'c_mktsegment', c_mktsegment, count(*) FROM x GROUP BY 2
    """,
)
def cohort_profile(t: Tables) -> DataFrame:
    return C.cohort_profile(stored_entities(t), "total_related_records", ["n_name", "c_mktsegment"])


@query(
    "cohort_top",
    ENTITIES + f"""
    SELECT c_custkey, c_name, n_name, c_mktsegment, total_related_records FROM m
    WHERE total_related_records >= {_Q.format(c='total_related_records', p=0.95)}
    ORDER BY total_related_records DESC, c_custkey LIMIT 5
    """,
)
def cohort_top(t: Tables) -> DataFrame:
    return C.cohort_top(
        stored_entities(t), "total_related_records", "c_custkey", ["c_name", "n_name", "c_mktsegment"], C.DENSE, 5
    )


@query(
    "high_child_cohort",
    ENTITIES + """,
    q AS (SELECT quantile_cont(lineitem_count, 0.9)::DOUBLE AS th FROM m)
    SELECT max(th) AS threshold, count(*) AS n, count(*) * 100.0 / (SELECT count(*) FROM m) AS pct,
           avg(lineitem_count) AS mean, max(lineitem_count) AS max FROM m, q WHERE lineitem_count >= th
    """,
    "threshold pct mean",
)
def high_child_cohort(t: Tables) -> DataFrame:
    return C.cohort_summary(stored_entities(t), "lineitem_count", C.MANY)


@query(
    "high_child_groups",
    ENTITIES + f"""
    SELECT 'n_name' AS dimension, n_name AS value, count(*) AS n FROM m
    WHERE lineitem_count >= {_Q.format(c='lineitem_count', p=0.9)} GROUP BY 2
    """,
)
def high_child_groups(t: Tables) -> DataFrame:
    return C.cohort_profile(stored_entities(t), "lineitem_count", ["n_name"], C.MANY)


def _scored(t: Tables) -> DataFrame:
    return C.complexity_score(stored_entities(t), MEASURES)


_TIERED = ENTITIES.rstrip() + """,
sc AS (SELECT *, total_related_records + orders_count + lineitem_count + events_count AS score FROM m),
q AS (SELECT quantile_cont(score, 0.25) AS q25, quantile_cont(score, 0.75) AS q75, quantile_cont(score, 0.9) AS q90 FROM sc),
ti AS (SELECT sc.*, CASE WHEN score <= q25 THEN 'simple' WHEN score <= q75 THEN 'moderate'
                         WHEN score <= q90 THEN 'complex' ELSE 'very_complex' END AS tier FROM sc, q)
"""


@query(
    "complexity_tiers",
    _TIERED + """
    SELECT tier, count(*) AS n, avg(score) AS mean_score, avg(total_related_records) AS mean_total,
           count(*) * 100.0 / (SELECT count(*) FROM ti) AS pct FROM ti GROUP BY 1
    """,
    "mean_score mean_total pct",
)
def complexity_tiers(t: Tables) -> DataFrame:
    return C.complexity_tiers(C.with_tier(_scored(t)), "total_related_records")


def _tier_top_sql(dimension: str) -> str:
    return _TIERED + f"""
    SELECT tier, {dimension}, count(*) AS n,
           CAST(row_number() OVER (PARTITION BY tier ORDER BY count(*) DESC, {dimension}) AS INTEGER) AS rank
    FROM ti GROUP BY 1, 2 QUALIFY rank <= 3
    """


@query("tier_top_groups", _tier_top_sql("n_name"))
def tier_top_groups(t: Tables) -> DataFrame:
    return C.tier_top_values(C.with_tier(_scored(t)), "n_name")


@query("tier_top_categories", _tier_top_sql("c_mktsegment"))
def tier_top_categories(t: Tables) -> DataFrame:
    return C.tier_top_values(C.with_tier(_scored(t)), "c_mktsegment")


_GROUP_RANK = _TIERED.rstrip() + """,
gr AS (
  SELECT *, row_number() OVER (ORDER BY mean_score DESC, n_name) AS rank FROM (
    SELECT n_name, count(*) AS n, avg(score) AS mean_score FROM ti GROUP BY 1
    ORDER BY count(*) DESC, n_name LIMIT 10))
"""


@query(
    "group_rank",
    _GROUP_RANK + "SELECT n_name, n, mean_score, CAST(rank AS INTEGER) AS rank FROM gr",
    "mean_score",
)
def group_rank(t: Tables) -> DataFrame:
    return C.group_rank(_scored(t), "n_name")


@query(
    "derived_flags",
    _GROUP_RANK.rstrip() + _SPECIAL.replace("o AS (", "ov AS (").replace("b, o ", "b, ov ") + """,
    g AS (SELECT n_name, count(*) AS n FROM m GROUP BY 1),
    lab AS (SELECT count(*) * 6 AS cells, count(*) * 4 + count(quality) + count(toxic) AS filled
            FROM documents LEFT JOIN labels USING (doc_id)),
    pr AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS r FROM lineitem GROUP BY 1),
    dec AS (SELECT floor(start_year / 10.0) AS d, avg(total_related_records) AS a FROM m GROUP BY 1)
    SELECT (SELECT max(total_related_records) > 3 * avg(total_related_records) FROM m) AS wide_density,
           (SELECT filled * 100.0 / cells > 90 FROM lab) AS complete,
           (SELECT filled * 100.0 / cells < 70 FROM lab) AS incomplete,
           (SELECT count(*) > 20 FROM g) AS many_groups,
           (SELECT count(*) > 30 FROM g) AS very_many_groups,
           (SELECT count(*) FILTER (r > 34) * 100.0 / count(*) > 10 FROM pr) AS complex_recipients,
           (SELECT count(*) FILTER (r <= 20) * 100.0 / count(*) > 60 FROM pr) AS simple_recipients,
           coalesce((SELECT max_by(a, d) FROM dec)
             > 1.2 * (SELECT max_by(a, d) FROM dec WHERE d < (SELECT max(d) FROM dec)), false) AS denser_latest_decade,
           (SELECT avg(mean_score) FILTER (rank <= 3) > 2 * avg(mean_score) FILTER (rank > 7) FROM gr) AS group_gap,
           (SELECT count(DISTINCT n_name) FILTER (specialization > 2) >= 3 FROM s) AS specialised
    """,
)
def derived_flags(t: Tables) -> DataFrame:
    """All yes/no findings, each from the operator that measures it."""
    master = stored_entities(t)
    scored = C.complexity_score(master, MEASURES)
    total = "total_related_records"

    def one(df: DataFrame, *measures) -> DataFrame:
        return df.agg(*measures)

    ranks = C.group_rank(scored, "n_name")
    decades = D.density_by_decade(master, "start_year", total).orderBy(F.desc("decade")).limit(2)
    mean, score = F.col("mean_records"), F.col("mean_score")
    frames = [
        one(master, F.max(total).alias("max_total"), F.avg(total).alias("mean_total")),
        completeness(labelled(t)),
        D.group_count_stats(master, "n_name").select("groups"),
        D.diversity_stats(materialize(diversity(t)), _LIMITS).select("entities", "simple", "very_complex"),
        one(decades, F.max_by(mean, "decade").alias("latest"),
            F.when(F.count(F.lit(1)) > 1, F.min_by(mean, "decade")).alias("previous")),
        one(ranks, F.avg(F.when(F.col("rank") <= 3, score)).alias("top3"),
            F.avg(F.when(F.col("rank") > 7, score)).alias("bottom3")),
        one(D.specialization_index(master, "n_name", COUNTS, total),
            F.count_distinct(F.when(F.col("specialization") > 2, F.col("n_name"))).alias("special_groups")),
    ]
    # Every frame is one row, so the summary is one row of scalar subqueries.
    summary = t.spark.range(1).select(
        *[df.select(F.struct(*df.columns).alias("s")).scalar().alias(f"_{i}") for i, df in enumerate(frames)]
    ).select(*[f"_{i}.*" for i in range(len(frames))])
    c = F.col
    share = lambda part: c(part) * 100.0 / c("entities")
    return D.derived_flags(
        summary,
        {
            "wide_density": c("max_total") > c("mean_total") * 3,
            "complete": c("complete_pct") > 90,
            "incomplete": c("complete_pct") < 70,
            "many_groups": c("groups") > 20,
            "very_many_groups": c("groups") > 30,
            "complex_recipients": share("very_complex") > 10,
            "simple_recipients": share("simple") > 60,
            "denser_latest_decade": c("latest") > c("previous") * 1.2,
            "group_gap": c("top3") > c("bottom3") * 2,
            "specialised": c("special_groups") >= 3,
        },
    )
