"""One row per entity: unique tables joined, child tables nested as arrays."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordlens.functions.ranking import TASK_ROWS, dedupe_first, large_groups, places_in_groups
from recordlens.functions.runtime import materialize
from recordlens.functions.scalars import has_child_flags, total_related

# Header columns that nested records leave out.
HEADER = ("予算事業ID", "シート種別", "事業年度", "事業名")

# Records of a single row; an entity with more has further rows.
RECORD_LIMIT = 100_000


@dataclass(frozen=True)
class Child:
    """A 1:N table: ``order`` must put the records of an entity in a total order."""

    df: DataFrame
    order: tuple[str, ...]
    drop: tuple[str, ...] = HEADER


def left_join_unique(
    base: DataFrame, key: str, tables: Sequence[tuple[DataFrame, Sequence[str | Column]]]
) -> DataFrame:
    """Left join the first row per key of every table; columns already present are left out.

    The row count of ``base`` cannot change, because every joined side is unique by key.
    """
    out = base
    for df, order in tables:
        seen = set(out.columns) - {key}
        unique = dedupe_first(df, key, order)
        out = out.join(unique.select(*[c for c in df.columns if c not in seen]), key, "left")
    return out


def attach_by_key(
    base: DataFrame, values: DataFrame, key: str, defaults: Mapping[str, object]
) -> DataFrame:
    """Left join per-key values; the named columns get their default when absent."""
    out = base.join(values, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def restrict_to_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose key occurs in ``ids``."""
    return df.join(ids.select(key), key, "left_semi")


def large_keys(df: DataFrame, key: str, limit: int) -> DataFrame:
    """Keys with more than ``limit`` rows, hence at most rows / limit of them."""
    return large_groups(df, [key], limit)


def _hot_keys(rows: DataFrame, key: str, limit: int) -> DataFrame | None:
    """The stored keys of more than ``limit`` rows and their number of rows, none if there are none; reads the key alone."""
    hot = materialize(large_keys(rows, key, limit))
    return None if hot.isEmpty() else hot


def _records(df: DataFrame, key: str, drop: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Rows with a key and at least one value besides it, and the value columns."""
    fields = [c for c in df.columns if c != key and c not in drop]
    filled = F.lit(False)
    for c in fields:
        filled = filled | F.col(c).isNotNull()
    return df.filter(F.col(key).isNotNull() & filled), fields


def nest_children(
    df: DataFrame, key: str, child: Child, limit: int = RECORD_LIMIT, spread: int | None = None
) -> DataFrame:
    """(key, chunk, chunks, records, record_count) for every key, ``limit`` records per row.

    Chunks follow each other in the order of the child, so most keys have chunk 0 of 1 and a
    large one just has more rows; ``record_count`` counts those of the row. One scan and one shuffle by key, which later
    joins by key need no more. Keys of more records than ``spread`` are found first, from the keys alone, and their
    records are spread by place, so no task gathers a hot key; without it, those that neither a row nor a task holds.
    """
    return _nested(df, key, child, limit, spread).drop("total")


def _nested(df: DataFrame, key: str, child: Child, limit: int, spread: int | None = None) -> DataFrame:
    """:func:`nest_children` with ``total``, the records of the key in all its rows."""
    rows, fields = _records(df, key, child.drop)
    spread = spread or max(limit, TASK_ROWS)
    hot = _hot_keys(rows, key, spread)
    whole = hot is None and limit >= spread
    placed = places_in_groups(rows, [key], child.order, hot, "_place", None if whole else "_total")
    record = F.struct(F.col("_place").alias("p"), F.struct(*fields).alias("r"))
    nested = (
        placed.withColumn("chunk", F.floor(F.col("_place") / limit).cast("int"))
        .groupBy(key, "chunk")
        .agg(
            F.transform(F.sort_array(F.collect_list(record)), lambda x: x["r"]).alias("records"),
            *([] if whole else [F.max("_total").alias("total")]),
        )
        .withColumn("record_count", F.size("records").cast("long"))
    )
    if whole:
        return nested.select(key, "chunk", F.lit(1).alias("chunks"), "records", "record_count", F.col("record_count").alias("total"))
    chunks = F.ceil(F.col("total") / limit).cast("int").alias("chunks")
    return nested.select(key, "chunk", chunks, "records", "record_count", "total")


def build_master(
    base: DataFrame,
    key: str,
    base_order: Sequence[str],
    unique: Sequence[tuple[DataFrame, Sequence[str]]],
    children: Mapping[str, Child],
    with_records: bool = True,
    limit: int = RECORD_LIMIT,
) -> DataFrame:
    """Base rows, unique tables, and per child ``x`` (records), ``x_count``, ``has_x``; plus the total.

    With records, the rows with ``chunk`` 0 are the entities, and ``x`` has the first ``limit``
    records of each. What is beyond them follows in rows with ``chunk`` 1, 2, ... and ``child``, the
    name of the only child they carry; their other columns are null. Very large keys are spread as in :func:`nest_children`.
    """
    out = left_join_unique(dedupe_first(base, key, base_order), key, unique)
    counts, further = [], []
    for name, child in children.items():
        rows, _ = _records(child.df, key, child.drop)
        if with_records:
            nested = _nested(child.df, key, child, limit)
            nested = nested.select(key, "chunk", F.col("records").alias(name), F.col("total").alias(f"{name}_count"))
            first = nested.filter("chunk = 0").drop("chunk")
            out = attach_by_key(out, first, key, {f"{name}_count": 0})
            further.append(nested.filter("chunk > 0").select(key, "chunk", F.lit(name).alias("child"), name))
        else:
            per_key = rows.groupBy(key).agg(F.count(F.lit(1)).alias(f"{name}_count"))
            out = attach_by_key(out, per_key, key, {f"{name}_count": 0})
        counts.append(f"{name}_count")
    out = has_child_flags(out, counts)
    out = out.withColumn("total_related_records", total_related(counts))
    if not with_records:
        return out
    # Records of keys the base lacks stay out here as they do in chunk 0.
    entities = out.select(key)
    out = out.withColumns({"chunk": F.lit(0), "child": F.lit(None).cast("string")})
    for rows in further:
        out = out.unionByName(rows.join(entities, key, "left_semi"), allowMissingColumns=True)
    return out


def nest_stats(master: DataFrame, children: Mapping[str, Child]) -> DataFrame:
    """Per child: records in the source, entities with data, records per entity.

    Records of entities the master lacks are counted in the source, as they are part of it.
    """
    aggs = [F.count(F.lit(1)).alias("entities")]
    aggs += [F.count_if(F.col(f"{n}_count") > 0).alias(f"n_{n}") for n in children]
    seen = master.agg(*aggs)
    pairs = ", ".join(f"'{n}', n_{n}" for n in children)
    per_child = seen.select(
        "entities", F.expr(f"stack({len(children)}, {pairs}) as (child, entities_with_data)")
    )
    totals = None
    for name, child in children.items():
        one = child.df.agg(F.count(F.lit(1)).alias("total_records")).withColumn(
            "child", F.lit(name)
        )
        totals = one if totals is None else totals.unionByName(one)
    # One row per child table on both sides.
    return per_child.join(F.broadcast(totals), "child").select(
        "child",
        "total_records",
        "entities_with_data",
        (F.col("total_records") / F.col("entities")).alias("records_per_entity"),
    )


def column_roles(master: DataFrame, children: Mapping[str, Child]) -> DataFrame:
    """Rows and columns of the master per role: base, records, count, flag."""
    names = set(children)
    roles = {"base": 0, "records": 0, "count": 0, "flag": 0}
    for c in master.columns:
        if c in names:
            roles["records"] += 1
        elif c.removesuffix("_count") in names:
            roles["count"] += 1
        elif c.removeprefix("has_") in names:
            roles["flag"] += 1
        else:
            roles["base"] += 1
    pairs = ", ".join(f"'{r}', {n}L" for r, n in roles.items())
    return master.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.expr(f"stack(4, {pairs}) as (role, columns)")
    )


def unnest_records(
    df: DataFrame, key: str, json_col: str, schema: T.StructType | None = None
) -> DataFrame:
    """One row per record of a JSON array column, bad or empty text skipped.

    With a schema the record is a struct, otherwise a map of texts.
    """
    text = F.trim(F.col(json_col))
    is_list = text.startswith("[")
    record = schema if schema is not None else T.MapType(T.StringType(), T.StringType())
    # Elements are parsed one by one, so an element that is no object spoils only itself.
    parts = F.from_json(F.when(is_list, text), T.ArrayType(T.StringType()))
    return (
        df.select(key, F.posexplode(parts).alias("pos", "_part"))
        .filter(F.trim(F.col("_part")).startswith("{"))
        .select(key, "pos", F.from_json("_part", record).alias("record"))
        .filter(F.col("record").isNotNull())
    )
