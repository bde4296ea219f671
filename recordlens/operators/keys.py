"""Entity keys over tables: cardinality, coverage, relationship, set operations."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordlens.functions.runtime import bind, percent
from recordlens.operators.profile import union_all

# Limits of the classification.
ONE_TO_ONE = 1.1
MASTER_COVERAGE = 99.0
RISK_COVERAGE = 95.0

Tables = Mapping[str, tuple[DataFrame, str]]


def key_type(tables: Iterable[tuple[DataFrame, str]]) -> str:
    """The type keys of several tables are compared in: whole numbers if all are, else text."""
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    return "long" if all(isinstance(df.schema[key].dataType, whole) for df, key in tables) else "string"


def key_counts(tables: Tables) -> DataFrame:
    """(table_name, key, n): rows per key and table, null keys included.

    Keys are whole numbers if they are so in all tables, else text.

    Rows are counted before the shuffle, so a hot key is one row per task.
    """
    kind = key_type(tables.values())
    frames = [
        df.groupBy(F.col(key).cast(kind).alias("key"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("table_name", F.lit(name))
        for name, (df, key) in tables.items()
    ]
    return union_all(frames)


def key_cardinality(counts: DataFrame) -> DataFrame:
    """Unique keys, rows with key, rows per key, key range and null keys per table."""
    known = F.col("key").isNotNull()
    unique = F.count_if(known)
    rows = F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0))
    return counts.groupBy("table_name").agg(
        unique.alias("unique_keys"),
        rows.alias("keyed_rows"),
        F.round(rows.cast("double") / F.when(unique > 0, unique), 2).alias("rows_per_key"),
        F.min("key").alias("min_key"),
        F.max("key").alias("max_key"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("null_keys"),
    )


def key_coverage(counts: DataFrame, tables: Sequence[str]) -> DataFrame:
    """Per table the share of all keys it holds, and whether it could be the master.

    One row per key with a flag per table comes first, so the union is counted only once.
    """
    flags = [F.bool_or(F.col("table_name") == t).alias(f"_t{i}") for i, t in enumerate(tables)]
    per_key = counts.filter(F.col("key").isNotNull()).groupBy("key").agg(*flags)
    totals = per_key.agg(
        F.count(F.lit(1)).alias("all_keys"),
        *[F.count_if(f"_t{i}").alias(f"_n{i}") for i in range(len(tables))],
    )
    pairs = ", ".join(f"'{t}', _n{i}" for i, t in enumerate(tables))
    return _coverage(totals.select(
        "all_keys", F.expr(f"stack({len(tables)}, {pairs}) as (table_name, unique_keys)")
    ))


def _coverage(totals: DataFrame) -> DataFrame:
    """Shares of (all_keys, table_name, unique_keys)."""
    share = percent(F.col("unique_keys"), F.col("all_keys"))
    return totals.select(
        "table_name", "unique_keys", "all_keys",
        F.round(share, 2).alias("coverage_pct"),
        (F.col("all_keys") - F.col("unique_keys")).alias("missing_keys"),
        (F.round(share, 2) >= MASTER_COVERAGE).alias("master_candidate"),
    )


# Values of one bitmap, and its bytes; bytes of a row of the plain way, which bitmaps must not exceed.
BITMAP_VALUES, BITMAP_BYTES, ROW_BYTES = 32_768, 4_096, 16


def dense_sets(values: DataFrame) -> list[str]:
    """The names whose whole numbers lie close enough for bitmaps: one pass over (name, table_name, value).

    All buckets between the smallest and the largest value then take no more than ``ROW_BYTES`` per row, so bitmaps
    never send more than the values would.
    """
    span = (F.floor(F.col("hi") / BITMAP_VALUES) - F.floor(F.col("lo") / BITMAP_VALUES) + 2) * F.col("tables")
    ranges = values.groupBy("name").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("rows"), F.count_distinct("table_name").alias("tables")
    )
    # One row per name.
    return [r["name"] for r in ranges.filter(span * BITMAP_BYTES <= F.col("rows") * ROW_BYTES + BITMAP_BYTES * 64).select("name").collect()]


def set_bitmaps(values: DataFrame) -> DataFrame:
    """(name, table_name, bucket, bits): the distinct values of every set, a row per 32,768 neighbours, built before the shuffle."""
    v = F.col("value")
    return values.filter(v.isNotNull()).groupBy("name", "table_name", F.bitmap_bucket_number(v).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(v)).alias("bits")
    )


def _set_sizes(bitmaps: DataFrame, tables: Sequence[Sequence[str]]) -> DataFrame:
    """(name, n0, n1, ...): the sizes of the unions of the given tables' sets, bucket by bucket."""
    # A union counts where one of its tables has the bucket.
    unions = [F.bitmap_or_agg(F.when(F.col("table_name").isin(list(ts)), F.col("bits"))).alias(f"b{i}") for i, ts in enumerate(tables)]
    per_bucket = bitmaps.groupBy("name", "bucket").agg(*unions)
    return per_bucket.groupBy("name").agg(*[F.coalesce(F.sum(F.bitmap_count(f"b{i}")), F.lit(0)).alias(f"n{i}") for i in range(len(tables))])


def key_coverage_of(tables: Tables) -> DataFrame:
    """:func:`key_coverage` of the tables themselves: by bitmaps where the keys are dense whole numbers, else by key.

    A bitmap stands for up to 32,768 keys of a table, so that a row per bucket is shuffled instead of one per key and table.
    """
    names = list(tables)
    if key_type(tables.values()) == "long":
        values = union_all([
            df.select(F.lit("key").alias("name"), F.lit(name).alias("table_name"), F.col(key).cast("long").alias("value"))
            for name, (df, key) in tables.items()
        ])
        if dense_sets(values):
            sizes = _set_sizes(set_bitmaps(values), [*[[t] for t in names], names])
            pairs = ", ".join(f"'{t}', n{i}" for i, t in enumerate(names))
            return _coverage(sizes.select(
                F.col(f"n{len(names)}").alias("all_keys"), F.expr(f"stack({len(names)}, {pairs}) as (table_name, unique_keys)")
            ))
    return key_coverage(key_counts(tables), names)


def relationship_class(
    cardinality: DataFrame, coverage: DataFrame, categories: Mapping[str, str], base_category: str
) -> DataFrame:
    """1:1 or 1:N per table, the chosen master, estimated rows and the loss risk.

    One row per table on both sides.
    """
    category = F.create_map(*[F.lit(x) for pair in categories.items() for x in pair])
    one = F.col("rows_per_key") <= ONE_TO_ONE
    joined = cardinality.join(
        F.broadcast(coverage.select("table_name", "coverage_pct")), "table_name"
    ).select(
        "table_name", "rows_per_key", "coverage_pct",
        category[F.col("table_name")].alias("category"),
        F.when(one, "1:1").otherwise("1:N").alias("relationship"),
        F.round(F.when(one, F.col("unique_keys")).otherwise(
            F.col("unique_keys") * F.col("rows_per_key")
        ), 2).alias("estimated_rows"),
    )
    candidate = (F.col("category") == base_category) & (F.col("relationship") == "1:1")
    overall = joined.agg(
        F.min(F.when(candidate, F.col("table_name"))).alias("master"),
        F.when(F.bool_or(F.col("coverage_pct") < RISK_COVERAGE), "medium").otherwise("low").alias("risk"),
    )
    return bind(joined, overall, "_o").select(
        *joined.columns,
        F.coalesce(F.col("table_name") == F.col("_o.master"), F.lit(False)).alias("is_master"),
        F.col("_o.risk").alias("risk_level"),
    )


def missing_ids(all_ids: DataFrame, ids: DataFrame, key: str, samples: int = 5) -> DataFrame:
    """One row: how many ids of ``all_ids`` are absent from ``ids``, and the smallest ones."""
    absent = diff_ids(all_ids, ids, key)
    first = absent.orderBy(key).limit(samples).agg(
        F.array_join(F.sort_array(F.collect_list(F.col(key))), ", ").alias("s")
    )
    return absent.agg(F.count(F.lit(1)).alias("missing_count")).select(
        "missing_count", first.scalar().alias("sample_ids")
    )


def union_ids(frames: Sequence[tuple[DataFrame, str]], name: str = "id") -> DataFrame:
    """Distinct ids over tables; each table is reduced before the union is."""
    kind = key_type(frames)
    parts = [
        df.select(F.col(key).cast(kind).alias(name)).filter(F.col(name).isNotNull())
        for df, key in frames
    ]
    return union_all(parts).distinct()


def diff_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct ids of ``a`` that ``b`` lacks."""
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def concat_tables(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all tables; a column some table lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def outer_join_common_keys(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Chain of full outer joins on the key columns both sides have.

    A frame that shares no key is left out. Other columns present on both sides keep
    both copies, told apart by the suffixes _x and _y.
    """
    out = frames[0]
    for df in frames[1:]:
        on = [k for k in keys if k in out.columns and k in df.columns]
        if not on:
            continue
        both = (set(out.columns) & set(df.columns)) - set(on)
        left = out.withColumnsRenamed({c: f"{c}_x" for c in both})
        right = df.withColumnsRenamed({c: f"{c}_y" for c in both})
        out = left.join(right, on, "full")
    return out


def table_columns(tables: Mapping[str, DataFrame]) -> dict[str, list[str]]:
    """Column name -> tables that have it."""
    owners: dict[str, list[str]] = {}
    for name, df in tables.items():
        for c in df.columns:
            owners.setdefault(c, []).append(name)
    return owners


def field_overlap(tables: Mapping[str, DataFrame]) -> DataFrame:
    """For every column two tables share: its distinct values in one and how many the other has. One row per column and ordered pair.

    Columns of dense whole numbers are compared as bitmaps, all others by value, each reduced to distinct ones before the shuffle.
    """
    shared = {c: ts for c, ts in table_columns(tables).items() if len(ts) > 1}

    def values(columns: Sequence[str], kind: str) -> DataFrame:
        return union_all([
            tables[t].select(F.lit(c).alias("name"), F.lit(t).alias("table_name"), F.col(c).cast(kind).alias("value"))
            for c in columns for t in shared[c]
        ])

    whole = [c for c, ts in shared.items() if key_type([(tables[t], c) for t in ts]) == "long"]
    dense = dense_sets(values(whole, "long")) if whole else []
    parts = []
    if dense:
        parts.append(_overlap_of_bitmaps(set_bitmaps(values(dense, "long")), {c: shared[c] for c in dense}))
    rest = {c: ts for c, ts in shared.items() if c not in dense}
    if rest:
        parts.append(_overlap_of_values(values(list(rest), "string"), rest))
    return union_all(parts).withColumn("share", F.round(percent(F.col("in_other"), F.col("distinct_values")), 2))


def _overlap_of_bitmaps(bitmaps: DataFrame, shared: Mapping[str, Sequence[str]]) -> DataFrame:
    names = sorted({t for ts in shared.values() for t in ts})
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    sizes = _set_sizes(bitmaps, [*[[t] for t in names], *pairs])
    own = {t: f"n{i}" for i, t in enumerate(names)}
    # What two sets share is what their union lacks of both sizes.
    both = {frozenset(p): f"{own[p[0]]} + {own[p[1]]} - n{len(names) + i}" for i, p in enumerate(pairs)}
    rows = [f"'{a}', '{b}', {own[a]}, {both[frozenset((a, b))]}" for a in names for b in names if a != b]
    found = sizes.select(
        F.col("name").alias("column"), F.expr(f"stack({len(rows)}, {', '.join(rows)}) as (table_name, other_table, distinct_values, in_other)")
    )
    return found.filter(_shared_by(shared))


def _shared_by(shared: Mapping[str, Sequence[str]]) -> Column:
    """Rows of a column and two tables that have it."""
    in_column = F.lit(False)
    for c, ts in shared.items():
        here = F.col("table_name").isin(list(ts)) & F.col("other_table").isin(list(ts))
        in_column = in_column | ((F.col("column") == c) & here)
    return in_column


def _overlap_of_values(values: DataFrame, shared: Mapping[str, Sequence[str]]) -> DataFrame:
    names = sorted({t for ts in shared.values() for t in ts})
    held = (
        values.filter(F.col("value").isNotNull())
        .groupBy(F.col("name").alias("column"), "value")
        .agg(*[F.bool_or(F.col("table_name") == t).alias(f"_t{i}") for i, t in enumerate(names)])
    )
    aggs, rows = [], []
    for i, a in enumerate(names):
        aggs.append(F.count_if(f"_t{i}").alias(f"_n{i}"))
        for j, b in enumerate(names):
            if i != j:
                aggs.append(F.count_if(F.col(f"_t{i}") & F.col(f"_t{j}")).alias(f"_n{i}_{j}"))
                rows.append(f"'{a}', '{b}', _n{i}, _n{i}_{j}")
    pairs = F.expr(
        f"stack({len(rows)}, {', '.join(rows)}) as (table_name, other_table, distinct_values, in_other)"
    )
    return held.groupBy("column").agg(*aggs).select("column", pairs).filter(_shared_by(shared))
