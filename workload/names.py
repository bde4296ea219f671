"""Name reconciliation: official names made from part names, types and brands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.operators import reconcile as M
from recordlens.operators.profile import union_all
from workload.registry import Tables, query


def officials(t: Tables) -> DataFrame:
    """Names as they are, with a type added, with a letter lost, and types alone."""
    name = F.col("p_name")
    lists = [
        t.part.select(name.alias("n")),
        t.part.select(F.concat(name, F.lit(" ("), "p_type", F.lit(")")).alias("n")),
        t.part.select(F.concat(F.substring(name, 1, 3), F.expr("substring(p_name, 5)"), F.lit(" ")).alias("n")),
        t.part.select(F.col("p_type").alias("n")),
    ]
    return M.distinct_names(union_all(lists), "n")


_OFFICIALS = """
WITH of AS (
  SELECT trim(n) AS name, count(*) AS copies FROM (
    SELECT p_name AS n FROM part UNION ALL SELECT p_name || ' (' || p_type || ')' FROM part
    UNION ALL SELECT substring(p_name, 1, 3) || substring(p_name, 5) || ' ' FROM part
    UNION ALL SELECT p_type FROM part) GROUP BY 1),
ca AS (SELECT trim(p_name) AS name, min(p_partkey) AS id FROM part GROUP BY 1)
"""


def candidates(t: Tables) -> DataFrame:
    return M.distinct_names(t.part, "p_name", "p_partkey")


def sources(t: Tables) -> dict[str, DataFrame]:
    return {
        "in_lines": t.lineitem.select("l_partkey"),
        "in_large": t.part.filter(F.col("p_size") > 25).select("p_partkey"),
    }


@query(
    "exact_name_match",
    _OFFICIALS + "SELECT name AS official_name, id AS candidate_id FROM of JOIN ca USING (name)",
)
def exact_name_match(t: Tables) -> DataFrame:
    return M.exact_name_match(officials(t), candidates(t))


@query(
    "membership_flags",
    _OFFICIALS + """
    SELECT name, id, id IN (SELECT l_partkey FROM lineitem) AS in_lines,
           id IN (SELECT p_partkey FROM part WHERE p_size > 25) AS in_large FROM ca
    """,
)
def membership_flags(t: Tables) -> DataFrame:
    return M.membership_flags(candidates(t), "id", sources(t))


@query(
    "merge_name_sources",
    """
    SELECT coalesce(p.id, s.id) AS id, coalesce(s.name, p.name) AS name
    FROM (SELECT p_partkey AS id, p_name AS name FROM part) p
    FULL JOIN (SELECT s_suppkey * 30 AS id, s_name AS name FROM supplier) s ON p.id = s.id
    """,
)
def merge_name_sources(t: Tables) -> DataFrame:
    first = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    second = t.supplier.select((F.col("s_suppkey") * 30).alias("id"), F.col("s_name").alias("name"))
    return M.merge_name_sources(first, second)


def unmatched(t: Tables) -> DataFrame:
    return officials(t).join(candidates(t).select("name"), "name", "left_anti")


# Ratcliff/Obershelp: the longest common block, earliest in the official name and then in the other, and the same
# on both sides of it. A name within the other counts as 0.9 at least.
_SIMILAR = _OFFICIALS.replace("WITH of AS", "WITH RECURSIVE of AS") + """,
un AS (SELECT name, copies FROM of WHERE name NOT IN (SELECT name FROM ca)),
pr AS (SELECT u.name AS a, c.name AS b, c.id FROM un u, ca c),
seg(a0, b0, a, b, lens) AS (
  SELECT a, b, a, b, list_transform(generate_series(1, length(a)), lambda i:
    coalesce(list_max(list_filter(generate_series(1, length(a) - i + 1), lambda l: contains(b, substr(a, i, l)))), 0)) FROM pr
  UNION ALL
  SELECT a0, b0, p.a, p.b, list_transform(generate_series(1, length(p.a)), lambda i:
    coalesce(list_max(list_filter(generate_series(1, length(p.a) - i + 1), lambda l: contains(p.b, substr(p.a, i, l)))), 0))
  FROM (
    SELECT a0, b0, unnest([
      {'a': substr(a, 1, i - 1), 'b': substr(b, 1, j - 1)}, {'a': substr(a, i + l), 'b': substr(b, j + l)}]) AS p
    FROM (SELECT a0, b0, a, b, l, i, strpos(b, substr(a, i, l)) AS j
          FROM (SELECT *, list_max(lens) AS l, list_position(lens, list_max(lens)) AS i FROM seg) WHERE l > 0))
  WHERE length(p.a) > 0 AND length(p.b) > 0),
sim AS (
  SELECT a AS official_name, id AS candidate_id, b AS candidate_name,
         CASE WHEN contains(a, b) OR contains(b, a) THEN greatest(0.9, m) ELSE m END AS similarity
  FROM (SELECT a0 AS a, b0 AS b, 2.0::DOUBLE * sum(list_max(lens)) / (length(a0) + length(b0)) AS m FROM seg GROUP BY a0, b0)
  JOIN pr USING (a, b)),
bst AS (
  SELECT * FROM sim WHERE similarity > 0
  QUALIFY row_number() OVER (PARTITION BY official_name ORDER BY similarity DESC, candidate_id) = 1)
"""
_RECONCILED = _SIMILAR + """,
rec AS (
  SELECT name AS official_name, id AS candidate_id, name AS candidate_name, 1.0::DOUBLE AS similarity, 'exact' AS match_type, copies
  FROM of JOIN ca USING (name)
  UNION ALL
  SELECT u.name, CASE WHEN similarity >= 0.7 THEN candidate_id END, candidate_name, coalesce(similarity, 0),
         CASE WHEN similarity >= 0.7 THEN 'fuzzy' ELSE 'none' END, copies
  FROM un u LEFT JOIN bst ON bst.official_name = u.name),
fl AS (
  SELECT *, coalesce(candidate_id IN (SELECT l_partkey FROM lineitem), false) AS in_lines,
         coalesce(candidate_id IN (SELECT p_partkey FROM part WHERE p_size > 25), false) AS in_large FROM rec)
"""


@query(
    "best_match_per_name",
    """
    SELECT o_orderpriority AS official_name, o_custkey AS candidate_id, o_orderstatus AS candidate_name,
           (o_orderkey % 100) / 100.0::DOUBLE AS similarity
    FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey % 100 DESC, o_custkey, o_orderstatus DESC) = 1
    """,
)
def best_match_per_name(t: Tables) -> DataFrame:
    pairs = t.orders.select(
        F.col("o_orderpriority").alias("official_name"), F.col("o_custkey").alias("candidate_id"),
        F.col("o_orderstatus").alias("candidate_name"), ((F.col("o_orderkey") % 100) / F.lit(100.0)).alias("similarity"),
    )
    # One pair per name and candidate, so that the best one is decided.
    unique = pairs.groupBy("official_name", "candidate_id", "similarity").agg(F.max("candidate_name").alias("candidate_name"))
    return M.best_match_per_name(unique)


@query(
    "fuzzy_best_match",
    _SIMILAR + "SELECT u.name AS official_name, candidate_id, candidate_name, similarity FROM un u LEFT JOIN bst ON official_name = u.name",
    "similarity",
)
def fuzzy_best_match(t: Tables) -> DataFrame:
    """Best partner of every name without an equal one."""
    return M.fuzzy_best_match(unmatched(t), candidates(t))


@query("fuzzy_blocked", _SIMILAR + "SELECT * FROM bst WHERE similarity >= 0.7", "similarity")
def fuzzy_blocked(t: Tables) -> DataFrame:
    """The pairs from the threshold on alone."""
    found = M.fuzzy_best_match(unmatched(t), candidates(t), best_below=False)
    return found.filter(F.col("candidate_id").isNotNull())


@query("reconcile_names", _RECONCILED + "SELECT * FROM fl", "similarity")
def reconcile_names(t: Tables) -> DataFrame:
    """Exact, fuzzy or none per official name, with membership flags."""
    return M.reconcile_names(officials(t), candidates(t), sources(t))


@query(
    "reconcile_stats",
    _RECONCILED + """
    SELECT count(*) AS official_names, count(*) FILTER (match_type = 'exact') AS exact, count(*) FILTER (match_type = 'fuzzy') AS fuzzy,
           count(*) FILTER (match_type = 'none') AS unmatched,
           count(*) FILTER (match_type = 'exact') * 100.0::DOUBLE / count(*) AS exact_rate,
           count(*) FILTER (match_type <> 'none') * 100.0::DOUBLE / count(*) AS total_rate,
           count(*) FILTER (match_type <> 'none' AND in_lines) AS in_lines,
           count(*) FILTER (match_type <> 'none' AND in_large) AS in_large FROM fl
    """,
    "exact_rate total_rate",
)
def reconcile_stats(t: Tables) -> DataFrame:
    return M.reconcile_stats(M.reconcile_names(officials(t), candidates(t), sources(t)), ["in_lines", "in_large"])
