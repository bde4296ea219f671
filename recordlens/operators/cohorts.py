"""Cohorts of entities: the dense, those with many children, complexity tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordlens.functions.quantiles import quantile_scalar, quantiles
from recordlens.functions.ranking import top_per_group
from recordlens.functions.runtime import bind, percent
from recordlens.functions.scalars import coerce_number
from recordlens.operators.describe import top_k_entities, total_rows

# Cohort limits and the names of the complexity tiers.
DENSE, MANY = 0.95, 0.9
TIERS = ("simple", "moderate", "complex", "very_complex")


def cohort(df: DataFrame, measure: str, p: float) -> DataFrame:
    """Entities at or above the p-quantile of a measure."""
    return df.filter(F.col(measure) >= quantile_scalar(df, measure, p))


def cohort_summary(
    df: DataFrame, measure: str, p: float = DENSE, flags: Sequence[str] = ()
) -> DataFrame:
    """One row: threshold, size, percent of all, mean, maximum, percent per flag."""
    marked = bind(df, quantiles(df, measure, {"threshold": p}), "_q")
    members = marked.filter(F.col(measure) >= F.col("_q.threshold"))
    n = F.count(F.lit(1))
    return members.agg(
        F.max("_q.threshold").alias("threshold"),
        n.alias("n"),
        percent(n, total_rows(df)).alias("pct"),
        F.avg(measure).alias("mean"),
        F.max(measure).alias("max"),
        *[percent(F.count_if(coerce_number(F.col(f), 0.0) > 0), n).alias(f"{f}_pct") for f in flags],
    )


def cohort_profile(
    df: DataFrame, measure: str, dimensions: Sequence[str], p: float = DENSE
) -> DataFrame:
    """Cohort members per value of each dimension, all dimensions in one aggregation."""
    members = cohort(df, measure, p)
    sets = [[d] for d in dimensions]
    counted = members.groupingSets(sets, *dimensions).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g")
    )
    # Bit i of the grouping id, from the left, tells that dimension i is rolled up.
    k = len(dimensions)
    full = (1 << k) - 1
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, d in enumerate(dimensions):
        here = F.col("_g") == full - (1 << (k - 1 - i))
        name = F.when(here, F.lit(d)).otherwise(name)
        value = F.when(here, F.col(d).cast("string")).otherwise(value)
    return counted.select(name.alias("dimension"), value.alias("value"), "n")


def cohort_top(
    df: DataFrame, measure: str, key: str, columns: Sequence[str], p: float, k: int
) -> DataFrame:
    return top_k_entities(cohort(df, measure, p), measure, key, columns, k)


def complexity_score(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Add ``score``, the sum of the measures."""
    score = F.lit(0).cast("long")
    for m in measures:
        score = score + F.coalesce(F.col(m), F.lit(0))
    return df.withColumn("score", score)


def with_tier(scored: DataFrame) -> DataFrame:
    """Tier by the quartiles and the 90th percentile of the score; a limit belongs below."""
    q = quantiles(scored, "score", {"q25": 0.25, "q75": 0.75, "q90": 0.9})
    c, s = F.col("score"), F.col("_q")
    named = F.when(c <= s["q25"], TIERS[0]).when(c <= s["q75"], TIERS[1])
    named = named.when(c <= s["q90"], TIERS[2]).otherwise(TIERS[3])
    return bind(scored, q, "_q").withColumn("tier", named).drop("_q")


def complexity_tiers(tiered: DataFrame, total: str) -> DataFrame:
    """Per tier: entities, percent of all, mean score, mean related records."""
    return tiered.groupBy("tier").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("score").alias("mean_score"),
        F.avg(total).alias("mean_total"),
    ).withColumn("pct", percent(F.col("n"), total_rows(tiered)))


def tier_top_values(tiered: DataFrame, dimension: str, k: int = 3) -> DataFrame:
    """The ``k`` most frequent values of a dimension in each tier."""
    counts = tiered.filter(F.col(dimension).isNotNull()).groupBy("tier", dimension).agg(
        F.count(F.lit(1)).alias("n")
    )
    return top_per_group(counts, ["tier"], [F.desc("n"), F.col(dimension)], k, "rank")


def group_rank(scored: DataFrame, group: str, measure: str = "score", k: int = 10) -> DataFrame:
    """The ``k`` largest groups ranked by their mean score."""
    largest = (
        scored.groupBy(group)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(measure).alias("mean_score"))
        .orderBy(F.desc("n"), group)
        .limit(k)
    )
    # k rows.
    w = W.partitionBy().orderBy(F.desc("mean_score"), group)
    return largest.withColumn("rank", F.row_number().over(w))
