"""Amounts per entity: the record of a year, statistics, top-percent lists, group ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordlens.functions.quantiles import LINEAR, NEAREST, quantile_scalar, quantiles
from recordlens.functions.ranking import global_rank, top_per_group
from recordlens.functions.runtime import bind, exact_sum, materialize, percent
from recordlens.functions.scalars import SIZE_LIMITS, SIZE_NAMES, execution_rate, size_tier

# Quantiles of the statistics.
AMOUNT_PERCENTILES = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
GROUP_MIN = 3


def pick_year_first(
    records: DataFrame, key: str, year: str, target: int, order: Sequence[str]
) -> DataFrame:
    """Per entity the first record of the target year, else its first record."""
    wanted = F.when(F.col(year) == target, 0).otherwise(1)
    return top_per_group(records, [key], [wanted, *order])


def pick_year_sum(
    records: DataFrame, key: str, year: str, target: int, order: Sequence[str],
    current: str, amounts: Sequence[str],
) -> DataFrame:
    """Per entity the last record of the target year, else positive sums over all years.

    Without any positive current amount the first record is taken. One aggregation with
    partial results per task, so a hot entity is not gathered.
    """
    place = F.struct(*order)
    in_year = F.col(year) == target
    aggs = [F.count_if(in_year).alias("_hits"), F.count_if(F.col(current) > 0).alias("_positive")]
    names = list(dict.fromkeys([current, *amounts]))
    for a in names:
        c = F.col(a)
        aggs += [
            F.max_by(F.struct(c.alias("v")), F.when(in_year, place)).alias(f"_last_{a}"),
            exact_sum(F.when(c > 0, c)).cast("double").alias(f"_sum_{a}"),
            F.min_by(F.struct(c.alias("v")), place).alias(f"_first_{a}"),
        ]

    def chosen(a: str) -> Column:
        value = (
            F.when(F.col("_hits") > 0, F.col(f"_last_{a}")["v"])
            .when(F.col("_positive") > 0, F.col(f"_sum_{a}"))
            .otherwise(F.col(f"_first_{a}")["v"])
        )
        return F.coalesce(value.cast("double"), F.lit(0.0)).alias(a)

    return records.groupBy(key).agg(*aggs).select(key, *[chosen(a) for a in names])


def amount_rank(df: DataFrame, amount: str, key: str) -> DataFrame:
    """1..n by amount, largest first; the key decides ties."""
    return global_rank(df, [F.desc(amount), F.col(key)])


def top_percent(
    df: DataFrame, amount: str, pct: float = 1.0, rule: str = LINEAR
) -> DataFrame:
    """Entities with a positive amount at or above the threshold of the upper ``pct`` percent."""
    valid = df.filter(F.col(amount) > 0)
    threshold = quantile_scalar(valid, amount, 1 - pct / 100, rule=rule)
    return valid.filter(F.col(amount) >= threshold)


def top_percent_list(
    df: DataFrame, amount: str, key: str, columns: Sequence[str],
    executed: str | None = None, pct: float = 1.0, rule: str = LINEAR,
) -> DataFrame:
    """The ranked list with names, amounts and, if given, the execution rate (1 dp)."""
    top = top_percent(df, amount, pct, rule).select(
        key, *columns, amount, *([executed] if executed else [])
    )
    ranked = amount_rank(top, amount, key)
    if executed:
        ranked = ranked.withColumn(
            "execution_rate", F.round(execution_rate(F.col(executed), F.col(amount)), 1)
        )
    return ranked


def top_share_by_group(top: DataFrame, group: str, amount: str) -> DataFrame:
    """Per group in the top list: entities, percent of the list, total and mean amount."""
    size = top.agg(F.count(F.lit(1)).alias("n")).scalar()
    total = exact_sum(F.col(amount))
    return top.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        total.cast("double").alias("total"),
        (total.cast("double") / F.count(F.lit(1))).alias("mean"),
    ).withColumn("pct", percent(F.col("n"), size))


def top_concentration(
    df: DataFrame, amount: str, pct: float = 1.0, rule: str = NEAREST
) -> DataFrame:
    """One row: entities and amount in the top list, total amount, share in percent."""
    valid = df.filter(F.col(amount) > 0)
    q = quantiles(valid, amount, {"threshold": 1 - pct / 100}, rule=rule)
    a = F.col(amount)
    in_top = a >= F.col("_q.threshold")
    return bind(valid.select(amount), q, "_q").agg(
        F.count(F.lit(1)).alias("entities"),
        F.count_if(in_top).alias("top_entities"),
        exact_sum(F.when(in_top, a)).cast("double").alias("top_amount"),
        exact_sum(a).cast("double").alias("total_amount"),
        F.max("_q.threshold").alias("threshold"),
    ).withColumn("share_pct", percent(F.col("top_amount"), F.col("total_amount")))


def amount_stats(df: DataFrame, amount: str, executed: str | None = None) -> DataFrame:
    """One row over entities with a positive amount: moments, percentiles, execution rates. The amounts are stored once."""
    a = F.col("_a")
    rows = materialize(df.select(F.col(amount).alias("_a"), *([F.col(executed).alias("_x")] if executed else [])))
    valid = rows.filter(a > 0)
    q = quantiles(valid, "_a", AMOUNT_PERCENTILES)
    aggs = [
        F.count(F.lit(1)).alias("with_amount"),
        (exact_sum(a).cast("double") / F.count(F.lit(1))).alias("mean"),
        F.stddev_pop(a).alias("std"),
        F.min(a).alias("min"),
        F.max(a).alias("max"),
        exact_sum(a).cast("double").alias("total"),
    ]
    extra = ["_q.*"]
    if executed:
        rate = execution_rate(F.col("_x"), a)
        rates = valid.select(rate.alias("r")).filter(F.col("r") > 0)
        aggs += [
            F.avg(F.when(rate > 0, rate)).alias("mean_rate"),
            F.count_if(rate > 0).alias("with_execution"),
        ]
        extra.append(quantile_scalar(rates, "r", 0.5).alias("median_rate"))
    every = rows.agg(F.count(F.lit(1)).alias("entities"))
    out = bind(bind(valid.agg(*aggs), q, "_q"), every, "_e").select("_e.*", "*", *extra).drop("_q", "_e")
    return out.withColumn("coverage_pct", percent(F.col("with_amount"), F.col("entities")))


def skew_flag(stats: DataFrame) -> DataFrame:
    """Whether few large amounts pull the mean beyond twice the median."""
    return stats.select("mean", F.col("p50").alias("median"), (F.col("mean") > F.col("p50") * 2).alias("is_skewed"))


def group_amount_ranking(df: DataFrame, group: str, amount: str, k: int = 10) -> DataFrame:
    """Total, entities and mean per group; the ``k`` largest totals, ranked."""
    a = F.col(amount)
    total = exact_sum(a)
    ranked = (
        df.filter(a > 0)
        .groupBy(group)
        .agg(
            total.alias("_t"),
            F.count(F.lit(1)).alias("n"),
            (total.cast("double") / F.count(F.lit(1))).alias("mean"),
        )
        .orderBy(F.desc("_t"), group)
        .limit(k)
    )
    # k rows.
    w = W.partitionBy().orderBy(F.desc("_t"), group)
    return ranked.select(
        F.row_number().over(w).alias("rank"), group, F.col("_t").cast("double").alias("total"), "n", "mean"
    )


def group_amount_stats(
    df: DataFrame, group: str, amount: str, minimum: int = GROUP_MIN, k: int = 10
) -> DataFrame:
    """Entities, total, mean, median and maximum of groups with enough entities, by total."""
    a = F.col(amount)
    valid = df.filter((a > 0) & F.col(group).isNotNull())
    largest = (
        valid.groupBy(group)
        .agg(
            F.count(F.lit(1)).alias("n"),
            exact_sum(a).alias("_t"),
            F.max(a).alias("max"),
        )
        .filter(F.col("n") >= minimum)
        .orderBy(F.desc("_t"), group)
        .limit(k)
    )
    # At most k groups, so their medians need only the rows of those groups.
    wanted = valid.join(F.broadcast(largest.select(group)), group, "left_semi")
    medians = quantiles(wanted, amount, {"median": 0.5}, by=[group])
    return largest.join(F.broadcast(medians), group).select(
        group, "n", F.col("_t").cast("double").alias("total"),
        (F.col("_t").cast("double") / F.col("n")).alias("mean"), "median", "max",
    )


def trimmed_amount_stats(
    df: DataFrame, amount: str, low: float | None = 0.01, high: float = 0.99
) -> DataFrame:
    """Statistics after dropping the tails: above p99, and with ``low`` also below p1."""
    bounds = {"hi": high} if low is None else {"lo": low, "hi": high}
    q = quantiles(df, amount, bounds)
    a, hi = F.col(amount), F.col("_q.hi")
    inside = a <= hi if low is None else (a >= F.col("_q.lo")) & (a <= hi)
    kept = bind(df.select(amount), q, "_q").filter(inside).select(amount)
    inner = quantiles(kept, amount, {"median": 0.5, "q25": 0.25, "q75": 0.75, "q90": 0.9, "q95": 0.95})
    moments = kept.agg(
        F.count(F.lit(1)).alias("n"),
        (exact_sum(a).cast("double") / F.count(F.lit(1))).alias("mean"),
        F.stddev_pop(a).alias("std"),
        F.min(a).alias("min"),
        F.max(a).alias("max"),
    )
    return bind(moments, inner, "_q").select("*", "_q.*").drop("_q")


def size_tiers(
    df: DataFrame, amount: str, limits: Sequence[float] = SIZE_LIMITS, names: Sequence[str] = SIZE_NAMES
) -> DataFrame:
    """Entities with a positive amount per tier."""
    return (
        df.filter(F.col(amount) > 0)
        .groupBy(size_tier(F.col(amount), limits, names).alias("tier"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def amount_coverage(records: DataFrame, entities: DataFrame, key: str, amount: str) -> DataFrame:
    """Entities with records, percent of all; mean, upper median, extremes of positive amounts."""
    a = F.col(amount)
    with_records = records.filter(F.col(key).isNotNull()).agg(
        F.count_distinct(key).alias("n")
    ).scalar()
    every = entities.agg(F.count(F.lit(1)).alias("n")).scalar()
    positive = records.filter(a > 0)
    median = quantile_scalar(positive, amount, 0.5, rule=NEAREST)
    return positive.agg(
        F.count(F.lit(1)).alias("amounts"),
        (exact_sum(a).cast("double") / F.count(F.lit(1))).alias("mean"),
        F.max(a).alias("max"),
        F.min(a).alias("min"),
    ).select(
        with_records.alias("entities_with_records"),
        F.round(percent(with_records, every), 1).alias("coverage_pct"),
        "*", median.alias("median"),
    )
