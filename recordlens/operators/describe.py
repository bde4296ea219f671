"""Distributions, concentration, time, density, flags and correlation over entities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlens.functions.comoments import MOMENT_SCHEMA, merge_rows, moment_batch, moment_rows
from recordlens.functions.quantiles import LINEAR, NEAREST, quantile_scalar, quantiles
from recordlens.functions.ranking import top_per_group
from recordlens.functions.runtime import bind, exact_sum, materialize, percent
from recordlens.functions.scalars import coerce_number, decade_bucket, share_band, tier
from recordlens.operators.profile import per_column, union_all

# Limits used by the reports.
STRONG, MODERATE, HIGH = 0.7, 0.3, 0.5
DIVERSITY_LIMITS = (5, 20, 50)
DIVERSITY_NAMES = ("simple", "moderate", "complex", "very_complex")
GROUP_MIN = 10
PROFILE_GROUPS, PROFILE_MIN, SPECIAL = 15, 5, 1.5
TREND_FROM, TREND_YEARS = 2000, 10
LONG_YEARS = 20


# --- groups ---------------------------------------------------------------


def group_counts(df: DataFrame, group: str) -> DataFrame:
    return df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"))


def total_rows(df: DataFrame) -> Column:
    """The row count as a scalar subquery."""
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def group_distribution(df: DataFrame, group: str, k: int | None = None) -> DataFrame:
    """Entities per group and their percent of all entities; the ``k`` largest if given."""
    share = percent(F.col("n"), total_rows(df))
    out = group_counts(df, group).select(
        group, "n", F.round(share, 1).alias("pct"), share_band(share).alias("band")
    )
    return out if k is None else out.orderBy(F.desc("n"), group).limit(k)


def share_bands(df: DataFrame, group: str) -> DataFrame:
    """Groups and entities per share band."""
    return group_distribution(df, group).groupBy("band").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n").alias("entities")
    )


def group_count_stats(df: DataFrame, group: str) -> DataFrame:
    """Mean, median, sample deviation, maximum, minimum of the group sizes; large spread?"""
    counts = group_counts(df, group)
    median = quantile_scalar(counts, "n", 0.5)
    return counts.agg(
        F.count(F.lit(1)).alias("groups"),
        F.avg("n").alias("mean"),
        F.stddev_samp("n").alias("std"),
        F.max("n").alias("max"),
        F.min("n").alias("min"),
    ).select("*", median.alias("median"), (F.col("std") > F.col("mean")).alias("uneven"))


def concentration_ratio(df: DataFrame, group: str, ks: Sequence[int] = (3, 5)) -> DataFrame:
    """Percent of entities in the largest groups, one column per k."""
    counts = group_counts(df, group)
    largest = counts.orderBy(F.desc("n"), group).limit(max(ks))
    sizes = largest.agg(
        F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), group))).alias("a")
    )
    total = total_rows(df)

    def top(k: int) -> Column:
        first = F.slice("a", 1, k)
        return F.aggregate(first, F.lit(0).cast("long"), lambda acc, x: acc - x["m"])

    return sizes.select(*[percent(top(k), total).alias(f"top{k}_pct") for k in ks])


# --- time -----------------------------------------------------------------


def start_year_stats(df: DataFrame, year: str) -> DataFrame:
    """Minimum, maximum, mean, median and mode (smallest on ties) of the numeric years."""
    years = df.select(coerce_number(F.col(year)).alias("y")).filter(F.col("y").isNotNull())
    counts = years.groupBy("y").agg(F.count(F.lit(1)).alias("c"))
    median = quantile_scalar(years, "y", 0.5)
    return counts.agg(
        F.min("y").cast("int").alias("min_year"),
        F.max("y").cast("int").alias("max_year"),
        (F.sum(F.col("y") * F.col("c")) / F.sum("c")).alias("mean_year"),
        F.max_by("y", F.struct("c", (-F.col("y")).alias("s"))).cast("int").alias("mode_year"),
        F.sum("c").alias("n"),
    ).select("*", median.alias("median_year"))


def decade_histogram(df: DataFrame, year: str) -> DataFrame:
    """Entities per decade and their percent of those with a year."""
    years = df.select(coerce_number(F.col(year)).alias("y")).filter(F.col("y").isNotNull())
    counts = years.groupBy(decade_bucket(F.col("y")).alias("decade")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("decade", "n", percent(F.col("n"), total_rows(years)).alias("pct"))


def recent_year_trend(
    df: DataFrame, year: str, since: int = TREND_FROM, k: int = TREND_YEARS
) -> DataFrame:
    """Entities per year from ``since`` on; the last ``k`` years present."""
    return (
        df.select(coerce_number(F.col(year)).cast("int").alias("year"))
        .filter(F.col("year") >= since)
        .groupBy("year").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("year")).limit(k)
    )


def period_shares(df: DataFrame, year: str, periods: Mapping[str, tuple[int, int | None]]) -> DataFrame:
    """Percent of entities per period [from, to) of the years known; open end with None."""
    y = coerce_number(F.col(year))
    n = F.count(y)

    def inside(lo: int, hi: int | None) -> Column:
        return (y >= lo) if hi is None else (y >= lo) & (y < hi)

    return df.agg(
        n.alias("n"),
        *[percent(F.count_if(inside(lo, hi)), n).alias(name) for name, (lo, hi) in periods.items()],
    )


def group_recency(df: DataFrame, group: str, year: str, recent: int, k: int = 10) -> DataFrame:
    """For the ``k`` largest groups: entities with year, percent recent, mean, oldest, newest."""
    y = coerce_number(F.col(year))
    per_group = df.filter(F.col(group).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("_size"),
        F.count(y).alias("n"),
        percent(F.count_if(y >= recent), F.count(y)).alias("recent_pct"),
        F.avg(y).alias("mean_year"),
        F.min(y).cast("int").alias("oldest"),
        F.max(y).cast("int").alias("newest"),
    )
    return per_group.orderBy(F.desc("_size"), group).limit(k).filter(F.col("n") > 0).drop("_size")


def density_by_decade(
    df: DataFrame, year: str, total: str, first: int = 1990, last: int = 2020
) -> DataFrame:
    """Entities, mean and maximum of the related records per decade."""
    decade = decade_bucket(coerce_number(F.col(year)))
    return (
        df.withColumn("decade", decade)
        .filter(F.col("decade").between(first, last))
        .groupBy("decade")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(total).alias("mean_records"),
            F.max(total).alias("max_records"),
        )
    )


def category_recency(df: DataFrame, category: str, year: str, recent: int) -> DataFrame:
    """Per category: entities with year, mean year, percent recent."""
    y = coerce_number(F.col(year))
    return (
        df.filter(F.col(category).isNotNull() & y.isNotNull())
        .groupBy(category)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(y).alias("mean_year"),
            percent(F.count_if(y >= recent), F.count(F.lit(1))).alias("recent_pct"),
        )
    )


def _duration(start: str, end: str) -> Column:
    return coerce_number(F.col(end)) - coerce_number(F.col(start))


def duration_long(
    df: DataFrame, start: str, end: str, years: int = LONG_YEARS
) -> DataFrame:
    """One row: entities lasting at least ``years``, their percent, mean and maximum."""
    d = F.col("_d")
    long = d >= years
    return df.select(_duration(start, end).alias("_d")).agg(
        F.count_if(long).alias("n"),
        percent(F.count_if(long), F.count(F.lit(1))).alias("pct"),
        F.avg(F.when(long, d)).alias("mean_duration"),
        F.max(d).alias("max_duration"),
    )


def duration_long_groups(
    df: DataFrame, start: str, end: str, group: str, years: int = LONG_YEARS
) -> DataFrame:
    return (
        df.filter(_duration(start, end) >= years).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    )


def duration_longest(
    df: DataFrame, start: str, end: str, key: str, columns: Sequence[str],
    years: int = LONG_YEARS, k: int = 3,
) -> DataFrame:
    d = _duration(start, end)
    return (
        df.filter(d >= years).select(key, *columns, d.alias("duration"))
        .orderBy(F.desc("duration"), key).limit(k)
    )


# --- density of child records --------------------------------------------


def child_density(df: DataFrame, count_cols: Sequence[str], rule: str = LINEAR) -> DataFrame:
    """Per child table: entities with data, coverage, mean, median, maximum, deviation, total."""
    names = [c.removesuffix("_count") for c in count_cols]
    cols = [F.col(c) for c in count_cols]
    n = F.count(F.lit(1))
    stats = per_column(
        df, names,
        {
            "entities_with_data": tuple(F.count_if(c > 0) for c in cols),
            "coverage_pct": tuple(percent(F.count_if(c > 0), n) for c in cols),
            "mean": tuple(F.avg(c) for c in cols),
            "max": tuple(F.max(c) for c in cols),
            "std": tuple(F.stddev_samp(c) for c in cols),
            "total": tuple(F.sum(c) for c in cols),
        },
    )
    medians = quantiles(_long_counts(df, count_cols), "n", {"median": 0.5}, by=["column"], rule=rule)
    # One row per child table on both sides.
    return stats.join(F.broadcast(medians), "column").withColumnRenamed("column", "child")


def _long_counts(df: DataFrame, count_cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(column, n): a row per entity and child table."""
    wide = df.select(*keep, *[F.col(c).cast("long").alias(c.removesuffix("_count")) for c in count_cols])
    return wide.unpivot(list(keep), [c.removesuffix("_count") for c in count_cols], "column", "n")


def child_density_from_nested(df: DataFrame, array_cols: Sequence[str], key: str | None = None) -> DataFrame:
    """Coverage, mean, upper median, total and maximum of the sizes of non-empty arrays.

    With ``key``, an entity's records may be spread over several rows (chunks): their sizes
    are added up first.
    """
    sizes = df.select(*([key] if key else []), *[F.greatest(F.size(c), F.lit(0)).cast("long").alias(c) for c in array_cols])
    if key:
        # Stored, as it is read several times and the arrays behind it are much larger.
        sizes = materialize(sizes.groupBy(key).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in array_cols]).drop(key))
    filled = [F.when(F.col(c) > 0, F.col(c)) for c in array_cols]
    n = F.count(F.lit(1))
    stats = per_column(
        sizes, array_cols,
        {
            "coverage_pct": tuple(F.round(percent(F.count(c), n), 1) for c in filled),
            "mean": tuple(F.round(F.coalesce(F.avg(c), F.lit(0.0)), 1) for c in filled),
            "total": tuple(F.coalesce(F.sum(c), F.lit(0)) for c in filled),
            "max": tuple(F.coalesce(F.max(c), F.lit(0)) for c in filled),
        },
    )
    lengths = sizes.unpivot([], list(array_cols), "column", "n").filter(F.col("n") > 0)
    medians = quantiles(lengths, "n", {"median": 0.5}, by=["column"], rule=NEAREST)
    return (
        stats.join(F.broadcast(medians), "column", "left")
        .withColumn("median", F.coalesce("median", F.lit(0.0)).cast("long"))
        .withColumnRenamed("column", "child")
    )


def related_distribution(df: DataFrame, total: str) -> DataFrame:
    """Mean, median, deviation, extremes and percentiles of the related records."""
    q = quantiles(
        df, total, {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
    )
    moments = df.agg(
        F.avg(total).alias("mean"),
        F.stddev_samp(total).alias("std"),
        F.min(total).alias("min"),
        F.max(total).alias("max"),
    )
    return bind(moments, q, "_q").select("*", "_q.*").drop("_q")


def highest_lowest(density: DataFrame, measures: Sequence[str], name: str = "child") -> DataFrame:
    """The child tables with the largest and smallest value of each measure."""
    aggs, rows = [], []
    for m in measures:
        # Struct order gives the first name on ties.
        aggs += [
            F.max_by(name, F.struct(F.col(m).alias("m"), F.col(name).alias("c"))).alias(f"_hi_{m}"),
            F.max(m).cast("double").alias(f"_hv_{m}"),
            F.min_by(name, F.struct(F.col(m).alias("m"), F.col(name).alias("c"))).alias(f"_lo_{m}"),
            F.min(m).cast("double").alias(f"_lv_{m}"),
        ]
        rows.append(f"'{m}', _hi_{m}, _hv_{m}, _lo_{m}, _lv_{m}")
    return density.agg(*aggs).select(
        F.expr(
            f"stack({len(rows)}, {', '.join(rows)}) "
            "as (measure, highest, highest_value, lowest, lowest_value)"
        )
    )


# --- flags and correlation -----------------------------------------------


def flag_frequency(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Rows with a positive value per flag column, percent of all rows, and the top flag."""
    set_ = [F.count_if(coerce_number(F.col(c), 0.0) > 0) for c in flags]
    counts = per_column(
        df, flags,
        {"n": tuple(set_), "pct": tuple(percent(s, F.count(F.lit(1))) for s in set_)},
    )
    top = counts.agg(F.max_by("column", F.struct("n", "column")).alias("t")).scalar()
    return counts.select(F.col("column").alias("flag"), "n", "pct", (F.col("column") == top).alias("is_top"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns over the rows that have both, in one pass over the rows.

    Every task adds up the co-moments of all pairs as matrix products, a block of rows at a time, and sends a row per
    column; these are merged in two levels. The plan does not grow with the number of pairs.
    """
    names = list(columns)
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], "var1 string, var2 string, r double")
    values = df.select(F.array(*[F.col(c).cast("double") for c in names]).alias("v"))
    moments = values.mapInArrow(lambda batches: moment_rows(batches, len(names)), MOMENT_SCHEMA)

    def merged(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([moment_batch([table["i"][0].as_py()], table["part"][0].as_py(), merge_rows(table)[:, None])])

    def correlations(table: pa.Table) -> pa.Table:
        i = table["i"][0].as_py()
        n, _, _, xx, yy, xy, bad = merge_rows(table)[:, i + 1 :]
        with np.errstate(all="ignore"):
            r = np.where(bad > 0, np.nan, xy / np.sqrt(xx * yy))
        # Undefined for less than two rows, or without any spread.
        missing = (n < 2) | ((bad == 0) & ((xx == 0) | (yy == 0)))
        return pa.table({
            "var1": pa.array([names[i]] * len(r), pa.string()), "var2": pa.array(names[i + 1 :], pa.string()),
            "r": pa.array(r, pa.float64(), mask=missing),
        })

    once = moments.groupBy("i", "part").applyInArrow(merged, MOMENT_SCHEMA)
    found = once.groupBy("i").applyInArrow(correlations, "var1 string, var2 string, r double")
    # Without rows there are pairs all the same; one row per pair.
    pairs = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in range(len(names))])).alias("i"))
    name = F.array(*[F.lit(c) for c in names])
    every = pairs.select(F.element_at(name, F.col("i") + 1).alias("var1"), F.explode(F.slice(name, F.col("i") + 2, len(names))).alias("var2"))
    return every.join(found, ["var1", "var2"], "left")


def correlation_pairs(matrix: DataFrame, above: float = MODERATE) -> DataFrame:
    """Pairs beyond ``above`` with their band and whether they count as high."""
    strength = F.abs("r")
    return matrix.filter(strength > above).select(
        "var1", "var2", "r",
        F.when(strength > STRONG, "strong").otherwise("moderate").alias("band"),
        (strength > HIGH).alias("is_high"),
    )


def group_density(
    df: DataFrame, group: str, total: str, minimum: int = GROUP_MIN, k: int = 10
) -> DataFrame:
    """Mean, deviation and size of groups with enough entities; the ``k`` densest."""
    return (
        df.groupBy(group)
        .agg(
            F.round(F.avg(total), 2).alias("mean"),
            F.round(F.stddev_samp(total), 2).alias("std"),
            F.count(total).alias("n"),
        )
        .filter(F.col("n") >= minimum)
        .orderBy(F.desc("mean"), group)
        .limit(k)
    )


def specialization_index(
    df: DataFrame, group: str, count_cols: Sequence[str], total: str,
    k: int = PROFILE_GROUPS, minimum: int = PROFILE_MIN, report: float = SPECIAL,
) -> DataFrame:
    """Group mean over overall mean per child table, for the ``k`` largest groups."""
    means = [F.avg(c).alias(f"_m{i}") for i, c in enumerate(count_cols)]
    overall = df.agg(*[F.avg(c).alias(c) for c in count_cols])
    per_group = (
        df.filter(F.col(group).isNotNull())
        .groupBy(group)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(total).alias("mean_total"),
            F.stddev_samp(total).alias("std_total"),
            *means,
        )
        .orderBy(F.desc("n"), group)
        .limit(k)
        .filter(F.col("n") >= minimum)
    )
    index = {
        f"_s{i}": F.when(F.col(f"_o.{c}") > 0, F.col(f"_m{i}") / F.col(f"_o.{c}")).otherwise(0.0)
        for i, c in enumerate(count_cols)
    }
    rows = ", ".join(f"'{c.removesuffix('_count')}', _s{i}" for i, c in enumerate(count_cols))
    return (
        bind(per_group, overall, "_o").withColumns(index)
        .select(
            group, "n", "mean_total", "std_total",
            F.expr(f"stack({len(count_cols)}, {rows}) as (child, specialization)"),
        )
        .withColumn("is_special", F.col("specialization") >= report)
    )


# --- recipients and goals -------------------------------------------------


def recipient_diversity(
    child: DataFrame, key: str, recipient: str, contract: str, amount: str
) -> DataFrame:
    """Per entity: distinct recipients and contract types, amount, concentration.

    ``hhi_equal`` weighs all recipients the same; ``hhi_amount`` weighs them by amount.
    Rows are first summed per entity and recipient, so a hot entity is spread by recipient.
    """
    who, how = F.trim(F.col(recipient).cast("string")), F.trim(F.col(contract).cast("string"))
    paid = F.when(F.col(amount) > 0, F.col(amount))
    base = child.select(
        key, F.when(who != "", who).alias("_who"), F.when(how != "", how).alias("_how"), paid.alias("_paid")
    )
    by_recipient = base.groupBy(key, "_who").agg(exact_sum(F.col("_paid")).alias("_sum"))
    recipients = by_recipient.groupBy(key).agg(
        F.count("_who").alias("recipients"),
        F.coalesce(F.sum("_sum"), F.lit(0)).cast("double").alias("amount"),
        F.sum(
            F.when(F.col("_who").isNotNull(), F.col("_sum").cast("double") ** 2)
        ).alias("_squares"),
        F.sum(F.when(F.col("_who").isNotNull(), F.col("_sum"))).cast("double").alias("_named"),
    )
    contracts = (
        base.filter(F.col("_how").isNotNull()).groupBy(key, "_how").agg(F.lit(1).alias("_one"))
        .groupBy(key).agg(F.count(F.lit(1)).alias("contract_types"))
    )
    return (
        recipients.filter(F.col("recipients") > 0)
        .join(contracts, key, "left")
        .select(
            key, "recipients",
            F.coalesce("contract_types", F.lit(0)).alias("contract_types"),
            "amount",
            (F.lit(1.0) / F.col("recipients")).alias("hhi_equal"),
            (F.col("_squares") / (F.col("_named") ** 2)).alias("hhi_amount"),
        )
    )


def diversity_stats(
    diversity: DataFrame, limits: Sequence[int] = DIVERSITY_LIMITS, names: Sequence[str] = DIVERSITY_NAMES
) -> DataFrame:
    """One row over all entities: recipients, contract types, concentration, class sizes."""
    kind = tier(F.col("recipients"), limits, names, closed=False)
    med = {}
    for c in ("recipients", "contract_types", "hhi_equal"):
        med[c] = quantile_scalar(diversity, c, 0.5)
    return diversity.agg(
        F.count(F.lit(1)).alias("entities"),
        F.avg("recipients").alias("mean_recipients"),
        F.max("recipients").alias("max_recipients"),
        F.min("recipients").alias("min_recipients"),
        F.stddev_pop("recipients").alias("std_recipients"),
        F.avg("contract_types").alias("mean_contract_types"),
        F.max("contract_types").alias("max_contract_types"),
        F.stddev_pop("contract_types").alias("std_contract_types"),
        F.avg("hhi_equal").alias("mean_hhi"),
        *[F.count_if(kind == n).alias(n) for n in names],
    ).select(
        "*",
        med["recipients"].alias("median_recipients"),
        med["contract_types"].alias("median_contract_types"),
        med["hhi_equal"].alias("median_hhi"),
    )


def diversity_top(diversity: DataFrame, key: str, k: int = 5) -> DataFrame:
    """The ``k`` entities with most recipients and with most contract types."""
    frames = []
    for m in ("recipients", "contract_types"):
        frames.append(
            diversity.select(F.lit(m).alias("measure"), key, F.col(m).alias("value"))
            .orderBy(F.desc("value"), key).limit(k)
        )
    return union_all(frames)


def goal_stats(child: DataFrame, key: str, named_fields: Sequence[str]) -> DataFrame:
    """Records per entity: mean, median, extremes, population deviation; filled named fields."""
    per_key = child.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"_f{i}") for i, c in enumerate(named_fields)]
    )
    filled = F.lit(0).cast("long")
    for i in range(len(named_fields)):
        filled = filled + F.sum(f"_f{i}")
    median = quantile_scalar(per_key, "n", 0.5)
    return per_key.agg(
        F.count(F.lit(1)).alias("entities"),
        F.avg("n").alias("mean"),
        F.max("n").alias("max"),
        F.min("n").alias("min"),
        F.stddev_pop("n").alias("std"),
        filled.alias("named_fields"),
    ).select("*", median.alias("median"))


# --- top and bottom -------------------------------------------------------


def top_k_entities(df: DataFrame, by: str, key: str, columns: Sequence[str], k: int) -> DataFrame:
    """The ``k`` entities with the largest value: a bounded heap per task, no full sort."""
    return df.select(key, *columns, by).orderBy(F.desc(by), key).limit(k)


def quantile_outliers(df: DataFrame, total: str) -> DataFrame:
    """Thresholds and sizes of the upper 5% and 1%."""
    q = quantiles(df, total, {"p95": 0.95, "p99": 0.99})
    marked = bind(df.select(total), q, "_q")
    return marked.agg(
        F.count_if(F.col(total) >= F.col("_q.p95")).alias("high_count"),
        F.count_if(F.col(total) >= F.col("_q.p99")).alias("ultra_count"),
        F.max("_q.p95").alias("p95"),
        F.max("_q.p99").alias("p99"),
    )


def outlier_entities(
    df: DataFrame, total: str, key: str, columns: Sequence[str], p: float = 0.95, k: int = 5
) -> DataFrame:
    high = df.filter(F.col(total) >= quantile_scalar(df, total, p))
    return top_k_entities(high, total, key, columns, k)


def per_table_outliers(
    df: DataFrame, count_cols: Sequence[str], key: str, p: float = 0.95, k: int = 3
) -> DataFrame:
    """Per child table with a positive threshold: threshold, entities at or above it, the first ``k``."""
    long = _long_counts(df, count_cols, [key])
    thresholds = quantiles(long, "n", {"threshold": p}, by=["column"]).filter(F.col("threshold") > 0)
    marked = long.join(thresholds, "column").filter(F.col("n") >= F.col("threshold"))
    stats = marked.groupBy("column", "threshold").agg(F.count(F.lit(1)).alias("entities"))
    top = top_per_group(marked, ["column"], [F.desc("n"), F.col(key)], k, "rank")
    # One row per child table.
    return top.drop("threshold").join(F.broadcast(stats), "column").select(
        F.col("column").alias("child"), "threshold", "entities", "rank", key, "n"
    )


# --- rules over the measures ---------------------------------------------


def derived_flags(measures: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Named yes/no findings over a frame of measures."""
    return measures.select(*[F.coalesce(r, F.lit(False)).alias(n) for n, r in rules.items()])
