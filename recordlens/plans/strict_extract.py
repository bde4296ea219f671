"""From text tables to the wide extract of all strictly matched entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from recordlens.operators import search as X
from recordlens.operators import wide as N


def strict_extract(
    texts: Sequence[X.SearchTable], tables: Sequence[N.WideTable]
) -> tuple[DataFrame, DataFrame]:
    """(extract, match detail). Both hold all values and matches; large entities have further rows."""
    cells = X.text_cells(texts)
    ids = X.strict_entities(cells).select("entity_id").distinct()
    detail = X.match_detail(X.strict_matches(cells), [t.name for t in texts])
    return N.wide_extract(tables, "entity_id", ids, detail), detail
