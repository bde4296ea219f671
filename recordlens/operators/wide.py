"""Wide extract: one row per matched entity, every column of every table as text."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlens.functions.ranking import large_groups, places_in_groups
from recordlens.functions.runtime import materialize, percent
from recordlens.functions.scalars import missing_text
from recordlens.operators.master import restrict_to_ids

SEPARATOR = " | "
# Values of a cell; a column with more has further parts.
ROW_LIMIT = 100_000
# Rows of an entity that a row holds while its values are put in order; the values of larger entities are spread.
HELD_ROWS = 1_000


@dataclass(frozen=True)
class WideTable:
    """``order`` puts the rows of an entity in the order values are first seen."""

    name: str
    df: DataFrame
    key: str
    order: tuple[str, ...]

    @property
    def columns(self) -> list[str]:
        return sorted(c for c in self.df.columns if c != self.key)


def _place(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])


def _as_text(t: WideTable, key: str, ids: DataFrame) -> DataFrame:
    """Rows of wanted entities: key, place in the source, filled values as text."""
    rows = restrict_to_ids(t.df.withColumnRenamed(t.key, key), key, ids)
    return rows.select(
        key, _place(t.order).alias("_o"),
        *[missing_text(F.col(c).cast("string")).alias(c) for c in t.columns],
    )


def wide_table(t: WideTable, key: str, ids: DataFrame, limit: int = ROW_LIMIT, held: int = HELD_ROWS) -> DataFrame:
    """(key, part, one column per column): the distinct values of each, joined in first-seen order.

    ``limit`` values per part; most entities have part 0 alone. A column without values in a part is null there. Entities of at
    most ``held`` rows take one shuffle by key. The values of others are reduced to distinct ones with their first place before
    the shuffle, whatever their number of rows, and spread by place.
    """
    rows = _as_text(t, key, ids)
    # Counted from the keys alone.
    keys = restrict_to_ids(t.df.select(F.col(t.key).alias(key)), key, ids)
    hot = materialize(large_groups(keys.filter(F.col(key).isNotNull()), [key], held))
    if hot.isEmpty():
        return _small_entities(t, key, rows, limit)
    hot = hot.select(key)
    small = _small_entities(t, key, rows.join(hot, key, "left_anti"), limit)
    return small.unionByName(_large_entities(t, key, rows.join(hot, key, "left_semi"), hot, limit))


def _small_entities(t: WideTable, key: str, rows: DataFrame, limit: int) -> DataFrame:
    """:func:`wide_table` of entities whose rows fit into a row."""
    names = [f"_v{i}" for i in range(len(t.columns))]
    ordered = F.sort_array(F.collect_list(F.struct("_o", *[F.col(c).alias(v) for c, v in zip(t.columns, names, strict=True)])))
    held = rows.groupBy(key).agg(ordered.alias("_rows"))

    def values(v: str) -> Column:
        """Distinct and filled, in first-seen order; of one place the lesser value comes first."""
        ties = F.size(F.array_distinct("_rows._o")) < F.size("_rows")
        pairs = F.sort_array(F.transform("_rows", lambda r: F.struct(r["_o"].alias("o"), r[v].alias("v"))))
        seen = F.when(ties, F.transform(pairs, lambda x: x["v"])).otherwise(F.col(f"_rows.{v}"))
        return F.array_except(seen, F.array(F.lit(None).cast("string"))).alias(v)

    wide = held.select(key, *[values(v) for v in names])
    most = F.greatest(F.lit(0), *[F.size(v) for v in names])

    def cells(cut) -> list[Column]:
        return [F.when(F.size(c) > 0, F.array_join(c, SEPARATOR)).alias(f"{t.name}_{n}") for n, c in zip(t.columns, map(cut, names), strict=True)]

    one = F.array(F.struct(F.lit(0).alias("part"), *cells(F.col)))
    several = F.transform(
        F.sequence(F.lit(0), F.floor((most - 1) / limit).cast("int")),
        lambda p: F.struct(p.alias("part"), *cells(lambda v: F.slice(v, p * limit + 1, limit))),
    )
    return wide.filter(most > 0).select(key, F.inline_outer(F.when(most <= limit, one).otherwise(several)))


def _large_entities(t: WideTable, key: str, rows: DataFrame, hot: DataFrame, limit: int) -> DataFrame:
    """:func:`wide_table` of the entities in ``hot``."""
    distinct = (
        rows.unpivot([key, "_o"], t.columns, "column", "value")
        .filter(F.col("value").isNotNull())
        .groupBy(key, "column", "value")
        .agg(F.min("_o").alias("_first"))
    )
    placed = places_in_groups(distinct, [key, "column"], ["_first", "value"], hot, "_place")
    ordered = F.sort_array(F.collect_list(F.struct("_place", "value")))
    cells = (
        placed.withColumn("part", F.floor(F.col("_place") / limit).cast("int"))
        .groupBy(key, "column", "part")
        .agg(F.array_join(F.transform(ordered, lambda x: x["value"]), SEPARATOR).alias("_cell"))
    )
    return cells.groupBy(key, "part").agg(
        *[F.max(F.when(F.col("column") == c, F.col("_cell"))).alias(f"{t.name}_{c}") for c in t.columns]
    )


def wide_extract(
    tables: Sequence[WideTable], key: str, ids: DataFrame, detail: DataFrame | None = None,
    limit: int = ROW_LIMIT,
) -> DataFrame:
    """Entities in ``ids`` with their match detail and count and all columns of all tables.

    The rows with ``part`` 0 are the entities, each with the first ``limit`` values of every column;
    '' stands for no value. What is beyond them follows in rows with ``part`` 1, 2, ..., one per table
    (or detail), whose other columns are null. ``detail``: (key, chunk, match_detail, match_count), as
    of :func:`match_detail`; ``match_count`` at part 0 is that of all chunks.
    """
    wanted = ids.select(key).distinct()
    out = wanted.withColumn("part", F.lit(0))
    further = []
    if detail is not None:
        lines = detail.join(wanted, key, "left_semi").select(key, F.col("chunk").alias("part"), "match_detail")
        matches = detail.groupBy(key).agg(F.sum("match_count").alias("match_count"))
        out = out.join(lines.filter("part = 0").drop("part"), key, "left").join(matches, key, "left").withColumns(
            {
                "match_detail": F.coalesce("match_detail", F.lit("")),
                "match_count": F.coalesce("match_count", F.lit(0)),
            }
        )
        further.append(lines.filter("part > 0"))
    for t in tables:
        wide = wide_table(t, key, ids, limit)
        out = out.join(wide.filter("part = 0").drop("part"), key, "left")
        names = [c for c in wide.columns if c not in (key, "part")]
        out = out.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in names})
        further.append(wide.filter("part > 0"))
    for rows in further:
        out = out.unionByName(rows, allowMissingColumns=True)
    return out


def _entities(wide: DataFrame) -> DataFrame:
    """The rows that stand for entities."""
    return wide.filter("part = 0").drop("part") if "part" in wide.columns else wide


def wide_extract_summary(wide: DataFrame, count_col: str = "match_count") -> DataFrame:
    """One row: entities, columns, and sum, mean and maximum of the matches."""
    wide = _entities(wide)
    return wide.agg(
        F.count(F.lit(1)).alias("entities"),
        F.sum(count_col).alias("total_matches"),
        F.round(F.avg(count_col), 2).alias("mean_matches"),
        F.max(count_col).alias("max_matches"),
    ).withColumn("columns", F.lit(len(wide.columns)).cast("long"))


def wide_group_distribution(wide: DataFrame, group: str, k: int = 20) -> DataFrame:
    return (
        _entities(wide).groupBy(group).agg(F.count(F.lit(1)).alias("entities"))
        .orderBy(F.desc("entities"), group).limit(k)
    )


def audit_wide_extract(
    wide: DataFrame, tables: Sequence[WideTable], meta_columns: int = 3, tolerance: int = 15
) -> DataFrame:
    """Per table: its columns in the extract, entities with data, filled cells.

    Expected columns of the whole extract: all table columns, the shared key once, and
    the meta columns.
    """
    wide = _entities(wide)
    expected = sum(len(t.df.columns) for t in tables) - (len(tables) - 1) + meta_columns
    actual = len(wide.columns)
    aggs, rows = [], []
    for t in tables:
        cells = [f"{t.name}_{c}" for c in t.columns if f"{t.name}_{c}" in wide.columns]
        n = F.lit(0)
        for c in cells:
            n = n + (F.col(c).isNotNull() & (F.col(c) != "")).cast("int")
        aggs += [
            F.sum(n).alias(f"cells_{t.name}"),
            F.count_if(n > 0).alias(f"entities_{t.name}"),
        ]
        rows.append(f"'{t.name}', {len(cells)}L, entities_{t.name}, cells_{t.name}")
    return wide.agg(*aggs).select(
        F.expr(
            f"stack({len(rows)}, {', '.join(rows)}) "
            "as (table_name, columns, entities_with_data, filled_cells)"
        ),
        F.lit(actual).cast("long").alias("total_columns"),
        F.lit(expected).cast("long").alias("expected_columns"),
        F.lit(abs(actual - expected) <= tolerance).alias("as_expected"),
    )


def column_coverage(
    df: DataFrame, columns: Sequence[str] | None = None, blank_is_missing: bool = True,
    k: int | None = None,
) -> DataFrame:
    """Per column the share of rows with a value; the ``k`` fullest with any value if given."""
    columns = list(columns or df.columns)

    def filled(c: str) -> Column:
        has = F.col(c).isNotNull()
        if blank_is_missing:
            has = has & (F.col(c).cast("string") != "")
        return F.count_if(has)

    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[filled(c).alias(f"_f{i}") for i, c in enumerate(columns)])
    pairs = ", ".join(f"'{c}', _f{i}" for i, c in enumerate(columns))
    out = counts.select(
        "_n", F.expr(f"stack({len(columns)}, {pairs}) as (column, filled)")
    ).select("column", "filled", F.round(percent(F.col("filled"), F.col("_n")), 1).alias("coverage_pct"))
    if k is None:
        return out
    return out.filter(F.col("filled") > 0).orderBy(F.desc("filled"), "column").limit(k)


def table_coverage(wide: DataFrame, tables: Sequence[WideTable]) -> DataFrame:
    """Per table of the extract: columns, columns with data, mean of the rounded coverages."""
    wide = _entities(wide)
    names = [(t.name, c) for t in tables for c in wide.columns if c.startswith(f"{t.name}_")]
    cover = column_coverage(wide, [c for _, c in names])
    owner = F.create_map(*[F.lit(x) for t, c in names for x in (c, t)])
    return cover.groupBy(owner[F.col("column")].alias("table_name")).agg(
        F.count(F.lit(1)).alias("columns"),
        F.count_if(F.col("filled") > 0).alias("columns_with_data"),
        F.round(F.avg("coverage_pct"), 1).alias("mean_coverage"),
    )


def row_completeness(
    df: DataFrame, columns: Sequence[str] | None = None, blank_is_missing: bool = True
) -> DataFrame:
    """Rows with all, above 80% and above 50% of the columns filled; filled and total cells."""
    columns = list(columns or df.columns)
    n = F.lit(0)
    for c in columns:
        has = F.col(c).isNotNull()
        if blank_is_missing:
            has = has & (F.col(c).cast("string") != "")
        n = n + has.cast("int")
    width = len(columns)
    return (
        df.select(n.alias("_n"))
        .agg(
            F.count_if(F.col("_n") == width).alias("perfect"),
            F.count_if(F.col("_n") > width * 0.8).alias("mostly"),
            F.count_if(F.col("_n") > width * 0.5).alias("basic"),
            F.coalesce(F.sum("_n"), F.lit(0)).alias("filled_cells"),
            (F.count(F.lit(1)) * width).alias("total_cells"),
        )
        .withColumn("completeness_pct", F.round(percent(F.col("filled_cells"), F.col("total_cells")), 2))
    )
