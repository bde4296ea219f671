"""From text tables to hits, roll-ups, enriched entities and their statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from recordlens.operators import search as X


@dataclass(frozen=True)
class SearchReport:
    hits: DataFrame
    records: DataFrame  # every record with a hit, nested per field
    per_table: DataFrame
    per_entity: DataFrame  # enriched from the master
    by_group: DataFrame
    terms: DataFrame


def search_report(
    tables: Sequence[X.SearchTable], families: X.Families, master: DataFrame, key: str, columns: Sequence[str],
    group: str, k: int = 20,
) -> SearchReport:
    """All steps of a term search; every frame is lazy, so only what is used is computed."""
    hits = X.search_terms(X.text_cells(tables), families)
    per_table = X.search_rollup_table(hits, X.record_counts(tables))
    per_entity = X.enrich_from_master(X.search_rollup_entity(per_table), master, key, columns)
    return SearchReport(
        hits, X.hit_records(hits), per_table, per_entity, X.family_by_group(per_entity, group, k), X.term_frequency(hits),
    )
