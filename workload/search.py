"""Term search over documents, conversations and benchmark texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.functions.terms import BROAD_TERMS, STRICT_TERMS
from recordlens.operators import search as X
from recordlens.plans.search_report import search_report as search_report_plan
from workload.frames import CELLS, FAMILIES, hits_sql, search_tables
from workload.master import STRICT_SQL
from workload.registry import Tables, query

# The full term list, with two fragments that the test texts hold.
BROAD = {"broad": (*BROAD_TERMS, "tion", "data"), "strict": STRICT_TERMS}
# Patterns whose matches plain SQL can place: no two of them overlap with themselves.
PLACED = ("AI", r"A\.I\.", "tion")


def cells(t: Tables) -> DataFrame:
    return X.text_cells(search_tables(t))


def hits(t: Tables) -> DataFrame:
    return X.search_terms(cells(t), FAMILIES)


@query(
    "search_terms",
    hits_sql(BROAD) + "SELECT entity_id, table_name, field, row_pos, family, term FROM hits",
)
def search_terms(t: Tables) -> DataFrame:
    found = X.search_terms(cells(t), BROAD)
    return found.select("entity_id", "table_name", "field", "row_pos", "family", "term")


_RECORDS = """,
rec AS (SELECT doc_id AS entity_id, 'documents' AS table_name, count(*) AS record_count FROM documents GROUP BY 1
  UNION ALL SELECT conv_id, 'conversations', count(*) FROM conversations GROUP BY 1
  UNION ALL SELECT item_id, 'benchmark', count(*) FROM benchmark GROUP BY 1),
pt AS (
  SELECT family, entity_id, table_name, count(*) AS total_matches,
         string_agg(DISTINCT field, ', ' ORDER BY field) AS matched_fields,
         string_agg(DISTINCT term, ', ' ORDER BY term) AS terms,
         count(DISTINCT term) AS distinct_terms,
         min_by(substring(text, 1, 300), row_pos * 10 + CASE field WHEN 'text' THEN 1 ELSE 0 END) AS example
  FROM hits GROUP BY 1, 2, 3)
"""


@query(
    "search_rollup_table",
    hits_sql(FAMILIES).rstrip() + _RECORDS + "SELECT pt.*, record_count FROM pt JOIN rec USING (entity_id, table_name)",
)
def search_rollup_table(t: Tables) -> DataFrame:
    per_table = X.search_rollup_table(hits(t), X.record_counts(search_tables(t)))
    return per_table.select(
        "family", "entity_id", "table_name", "total_matches",
        F.array_join("matched_fields", ", ").alias("matched_fields"),
        F.array_join("terms", ", ").alias("terms"),
        F.size("terms").cast("long").alias("distinct_terms"),
        "example", "record_count",
    )


@query(
    "hit_records",
    hits_sql(FAMILIES).rstrip() + """,
    r AS (SELECT family, entity_id, table_name, field, row_pos, substring(any_value(text), 1, 300) AS snippet,
                 string_agg(DISTINCT term, ',' ORDER BY term) AS terms FROM hits GROUP BY ALL),
    p AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY family, entity_id, table_name, field) AS n FROM r
          WINDOW w AS (PARTITION BY family, entity_id, table_name, field ORDER BY row_pos))
    SELECT family, entity_id, table_name, field, CAST((i - 1) // 2 AS INTEGER) AS chunk, CAST((any_value(n) + 1) // 2 AS INTEGER) AS chunks,
           string_agg(row_pos || '|' || terms || '|' || snippet, ' # ' ORDER BY row_pos) AS records
    FROM p GROUP BY family, entity_id, table_name, field, (i - 1) // 2
    """,
)
def hit_records(t: Tables) -> DataFrame:
    """Two records per row, so that many fields come in several chunks."""
    line = lambda r: F.concat_ws("|", r["row_pos"].cast("string"), F.array_join(r["terms"], ","), r["snippet"])
    return X.hit_records(hits(t), limit=2).withColumn("records", F.array_join(F.transform("records", line), " # "))


_ENTITY = """,
pe AS (
  SELECT family, entity_id, string_agg(DISTINCT table_name, ', ' ORDER BY table_name) AS tables_found,
         count(*) AS total_matches, string_agg(DISTINCT term, ', ' ORDER BY term) AS terms,
         count(DISTINCT table_name) AS details
  FROM hits GROUP BY 1, 2)
"""


def per_entity(t: Tables) -> DataFrame:
    return X.search_rollup_entity(X.search_rollup_table(hits(t)))


@query("search_rollup_entity", hits_sql(FAMILIES).rstrip() + _ENTITY + "SELECT * FROM pe")
def search_rollup_entity(t: Tables) -> DataFrame:
    return per_entity(t).select(
        "family", "entity_id", F.array_join("tables_found", ", ").alias("tables_found"), "total_matches",
        F.array_join("terms", ", ").alias("terms"), F.size("details").cast("long").alias("details"),
    )


@query(
    "enrich_from_master",
    hits_sql(FAMILIES).rstrip() + _ENTITY + """
    SELECT family, entity_id, total_matches, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           coalesce(n_chars::VARCHAR, '') AS n_chars
    FROM pe LEFT JOIN documents ON doc_id = entity_id
    """,
)
def enrich_from_master(t: Tables) -> DataFrame:
    enriched = X.enrich_from_master(per_entity(t), t.documents, "doc_id", ["lang", "source", "n_chars", "absent"])
    return enriched.select("family", "entity_id", "total_matches", "lang", "source", "n_chars")


def _placed_sql() -> str:
    parts = []
    for p in PLACED:
        rx = p if p.startswith("A\\") else p
        parts.append(
            f"""SELECT entity_id, table_name, field, row_pos, '{p}' AS pattern, text, i,
            regexp_extract_all(text, '{rx}', 0, 'i') AS ms, string_split_regex(text, '(?i){rx}') AS ps
            FROM filled, unnest(range(1, len(regexp_extract_all(text, '{rx}', 0, 'i')) + 1)) u(i)"""
        )
    return CELLS.rstrip() + ",\nx AS (" + "\nUNION ALL ".join(parts) + """),
    occ AS (
      SELECT entity_id, table_name, field, row_pos, pattern, ms[i] AS matched_text,
             CAST(list_sum(list_transform(ps[1:i], lambda s: length(s)))
               + coalesce(list_sum(list_transform(ms[1:i - 1], lambda s: length(s))), 0) AS INTEGER) AS start,
             length(ms[i]) AS len FROM x)
    """


@query(
    "search_occurrences",
    _placed_sql() + """
    SELECT entity_id, table_name, field, row_pos, pattern, matched_text, start,
           CAST(start + len AS INTEGER) AS "end" FROM occ
    """,
)
def search_occurrences(t: Tables) -> DataFrame:
    return X.search_occurrences(cells(t), PLACED).drop("snippet")


@query(
    "occurrence_rollup",
    _placed_sql() + """
    SELECT entity_id, count(*) AS total_matches, count(DISTINCT pattern) AS patterns,
           count(DISTINCT matched_text) AS matched_texts FROM occ GROUP BY 1
    """,
)
def occurrence_rollup(t: Tables) -> DataFrame:
    return X.occurrence_rollup(X.search_occurrences(cells(t), PLACED))


_COMPARE = """,
e AS (
  SELECT entity_id, coalesce(bool_or(family = 'strict'), false) AS s, coalesce(bool_or(family = 'relaxed'), false) AS r,
         coalesce(bool_or(family = 'compound'), false) AS c
  FROM hits GROUP BY 1),
cf AS (
  SELECT (SELECT count(*) FROM filled) AS cells_checked,
         count(*) FILTER (s) AS strict_entities, count(*) FILTER (r) AS relaxed_entities,
         count(*) FILTER (c) AS compound_entities, count(*) FILTER (r AND NOT s) AS missed_by_relaxed,
         count(*) FILTER (c AND NOT s) AS missed_by_compound,
         count(*) FILTER ((r OR c) AND NOT s) AS missed_total, count(*) AS potential_total,
         count(*) FILTER ((r OR c) AND NOT s) * 100.0 / count(*) FILTER (s) AS gain_pct FROM e)
"""


@query("compare_families", hits_sql(FAMILIES).rstrip() + _COMPARE + "SELECT * FROM cf", "gain_pct")
def compare_families(t: Tables) -> DataFrame:
    return X.compare_families(cells(t), FAMILIES, "strict")


@query(
    "compare_counts",
    hits_sql(FAMILIES).rstrip() + _COMPARE + """
    SELECT strict_entities, relaxed_entities, relaxed_entities - strict_entities AS gain_absolute,
           (relaxed_entities - strict_entities) * 100.0 / strict_entities AS gain_percent,
           relaxed_entities / strict_entities AS gain_ratio FROM cf
    """,
    "gain_percent gain_ratio",
)
def compare_counts(t: Tables) -> DataFrame:
    counts = X.compare_families(cells(t), FAMILIES, "strict").select("strict_entities", "relaxed_entities")
    return X.compare_counts(counts, "strict_entities", "relaxed_entities")


@query(
    "family_frequencies",
    hits_sql(FAMILIES) + """
    SELECT family, table_name, term, count(*) AS hits FROM hits
    GROUP BY GROUPING SETS ((family, table_name), (family, term), (family))
    """,
)
def family_frequencies(t: Tables) -> DataFrame:
    return X.family_frequencies(hits(t))


@query(
    "missed_examples",
    hits_sql(FAMILIES).rstrip() + """,
    ms AS (SELECT * FROM hits WHERE family <> 'strict'
           AND entity_id NOT IN (SELECT entity_id FROM hits WHERE family = 'strict')),
    ch AS (SELECT family, entity_id FROM (SELECT DISTINCT family, entity_id FROM ms)
           QUALIFY row_number() OVER (PARTITION BY family ORDER BY entity_id) <= 10)
    SELECT family, entity_id,
           CAST(row_number() OVER (PARTITION BY family, entity_id ORDER BY table_name, row_pos, field, term) AS INTEGER) AS n,
           table_name, field, term, substring(text, 1, 200) AS text
    FROM ms JOIN ch USING (family, entity_id) QUALIFY n <= 3
    """,
)
def missed_examples(t: Tables) -> DataFrame:
    return X.missed_examples(hits(t), "strict")


@query(
    "strict_matches",
    STRICT_SQL + """
    SELECT table_name, pattern_no, CAST(sum(n) AS BIGINT) AS matches FROM (
      SELECT table_name, 0 AS pattern_no, n0 AS n FROM strict UNION ALL SELECT table_name, 2, n2 FROM strict)
    WHERE n > 0 GROUP BY 1, 2
    """,
)
def strict_matches(t: Tables) -> DataFrame:
    return X.strict_matches(cells(t)).groupBy("table_name", "pattern_no").agg(
        F.count(F.lit(1)).alias("matches")
    )


@query(
    "strict_match_counts",
    STRICT_SQL + """
    SELECT table_name, CAST(sum(n0) AS BIGINT) AS pattern_0, CAST(0 AS BIGINT) AS pattern_1,
           CAST(sum(n2) AS BIGINT) AS pattern_2, CAST(0 AS BIGINT) AS pattern_3,
           CAST(sum(greatest(n0, n2)) AS BIGINT) AS distinct_places FROM strict GROUP BY 1
    """,
)
def strict_match_counts(t: Tables) -> DataFrame:
    return X.strict_match_counts(cells(t))


@query(
    "strict_entities",
    STRICT_SQL + "SELECT entity_id, table_name, count(DISTINCT row_pos) AS records FROM strict GROUP BY 1, 2",
)
def strict_entities(t: Tables) -> DataFrame:
    return X.strict_entities(cells(t))


@query(
    "strict_table_summary",
    STRICT_SQL + """
    SELECT table_name, count(*) AS entities, CAST(sum(records) AS BIGINT) AS records FROM (
      SELECT entity_id, table_name, count(DISTINCT row_pos) AS records FROM strict GROUP BY 1, 2) GROUP BY 1
    """,
)
def strict_table_summary(t: Tables) -> DataFrame:
    return X.strict_table_summary(X.strict_entities(cells(t)))


@query(
    "match_detail",
    STRICT_SQL + """,
    lines AS (
      SELECT entity_id, row_pos, table_name, field, n0 + n2 AS n,
             CASE table_name WHEN 'documents' THEN 1 WHEN 'conversations' THEN 2 ELSE 3 END AS o FROM strict)
    SELECT entity_id, CAST(sum(n) AS BIGINT) AS match_count, 0 AS chunk, 1 AS chunks,
           upper(string_agg(rtrim(repeat(table_name || '.' || field || ': AI | ', n), ' |'), ' | ' ORDER BY o, row_pos, field)) AS match_detail
    FROM lines GROUP BY 1
    """,
)
def match_detail(t: Tables) -> DataFrame:
    names = [s.name for s in search_tables(t)]
    detail = X.match_detail(X.strict_matches(cells(t)), names)
    return detail.withColumn("match_detail", F.upper("match_detail"))


# --- statistics -----------------------------------------------------------


@query(
    "search_statistics",
    hits_sql(FAMILIES) + """
    SELECT family, count(DISTINCT entity_id) AS entities,
           count(DISTINCT entity_id) * 100.0 / (SELECT count(*) FROM documents) AS pct FROM hits GROUP BY 1
    """,
    "pct",
)
def search_statistics(t: Tables) -> DataFrame:
    total = t.documents.agg(F.count(F.lit(1)).alias("n")).scalar()
    return X.family_summary(per_entity(t), total)


@query(
    "search_by_group",
    hits_sql(FAMILIES) + """
    SELECT family, source, count(DISTINCT entity_id) AS entities,
           CAST(row_number() OVER (PARTITION BY family ORDER BY count(DISTINCT entity_id) DESC, source) AS INTEGER) AS rank
    FROM (SELECT family, entity_id, coalesce(source, '') AS source FROM hits LEFT JOIN documents ON doc_id = entity_id)
    GROUP BY 1, 2 QUALIFY rank <= 20
    """,
)
def search_by_group(t: Tables) -> DataFrame:
    enriched = X.enrich_from_master(per_entity(t), t.documents, "doc_id", ["source"])
    return X.family_by_group(enriched, "source")


@query(
    "search_report",
    hits_sql(FAMILIES).rstrip() + """
    SELECT family, coalesce(lang, '') AS lang, count(DISTINCT entity_id) AS entities,
           CAST(row_number() OVER (PARTITION BY family ORDER BY count(DISTINCT entity_id) DESC, coalesce(lang, '')) AS INTEGER) AS rank
    FROM hits LEFT JOIN documents ON doc_id = entity_id GROUP BY 1, 2 QUALIFY rank <= 20
    """,
)
def search_report(t: Tables) -> DataFrame:
    """The whole plan, shown by its statistics per language."""
    return search_report_plan(search_tables(t), FAMILIES, t.documents, "doc_id", ["lang", "source"], "lang").by_group


@query(
    "term_frequency",
    hits_sql(BROAD) + """
    SELECT family, term, count(DISTINCT entity_id) AS entities,
           CAST(row_number() OVER (PARTITION BY family ORDER BY count(DISTINCT entity_id) DESC, term) AS INTEGER) AS rank
    FROM hits GROUP BY 1, 2 QUALIFY rank <= 30
    """,
)
def term_frequency(t: Tables) -> DataFrame:
    return X.term_frequency(X.search_terms(cells(t), BROAD))


@query(
    "table_distribution",
    hits_sql(FAMILIES) + "SELECT family, table_name, count(DISTINCT entity_id) AS entities FROM hits GROUP BY 1, 2",
)
def table_distribution(t: Tables) -> DataFrame:
    return X.table_distribution(hits(t))


@query(
    "matched_text_frequency",
    _placed_sql() + """
    SELECT matched_text, count(DISTINCT entity_id) AS entities FROM occ GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50
    """,
)
def matched_text_frequency(t: Tables) -> DataFrame:
    return X.matched_text_frequency(X.search_occurrences(cells(t), PLACED))
