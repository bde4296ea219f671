"""First-per-key, top-k and global ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordlens.functions.runtime import materialize

# Rows of a group that one task puts in order by itself; larger groups are spread over tasks.
TASK_ROWS = 100_000


def _cols(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def top_per_group(
    df: DataFrame, by: Sequence[str], order: Sequence[str | Column], k: int = 1,
    rank_col: str | None = None,
) -> DataFrame:
    """The first ``k`` rows of every group.

    The rank filter reaches the map side (window group limit), so a hot group sends
    at most ``k`` rows per task through the shuffle.
    """
    w = W.partitionBy(*by).orderBy(*_cols(order))
    out = df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k)
    if rank_col:
        return out.withColumnRenamed("_rank", rank_col)
    return out.drop("_rank")


def dedupe_first(df: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """The first row of every key in source order."""
    return top_per_group(df, [key], order)


def global_rank(
    df: DataFrame, order: Sequence[str | Column], rank_col: str = "rank"
) -> DataFrame:
    """1..n over all rows in ``order``, without sorting them in one task.

    ``order`` must be total. Rows are range partitioned and stored with their place
    in the partition; the partition sizes (one row per partition) give the offsets.
    """
    cols = _cols(order)
    placed = materialize(
        df.repartitionByRange(*cols)
        .sortWithinPartitions(*cols)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    part = F.shiftright("_mid", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before")
    )
    # One row per partition, so the broadcast does not grow with the rows.
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(
            rank_col,
            F.col("_before") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)) + 1,
        )
        .drop("_part", "_mid", "_before")
    )


def large_groups(df: DataFrame, by: Sequence[str], limit: int) -> DataFrame:
    """(by, rows): the groups of more than ``limit`` rows, hence at most rows / limit of them."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > limit)


def places_in_groups(
    df: DataFrame, by: Sequence[str], order: Sequence[str | Column], hot: DataFrame | None, name: str, size: str | None = None
) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... within each group, in ``order``; and with ``size``, if given, the rows of the group.

    ``hot`` names groups whose rows are too many for one task, by some or all of the columns of ``by``. They are range
    partitioned by group and place, so such a group is spread over many tasks, and places follow from the rows before each
    partition and the first one of a group. All others take one shuffle and a window.
    """
    window = W.partitionBy(*by).orderBy(*_cols(order))
    places = {name: F.row_number().over(window) - 1}
    sizes = []
    if size:
        # One sort serves both windows.
        places[size] = F.count(F.lit(1)).over(W.partitionBy(*by))
        sizes = [F.count(F.lit(1)).alias(size)]
    if hot is None:
        return df.withColumns(places)
    keys = hot.select(*[c for c in hot.columns if c in by])
    regular = df.join(keys, keys.columns, "left_anti").withColumns(places)
    ranked = global_rank(df.join(keys, keys.columns, "left_semi"), [*by, *order], "_in_all")
    first = ranked.groupBy(*by).agg(F.min("_in_all").alias("_group_at"), *sizes)
    placed = ranked.join(first, list(by)).withColumn(name, (F.col("_in_all") - F.col("_group_at")).cast("int"))
    return regular.unionByName(placed.drop("_in_all", "_group_at"))
