"""From entities and child tables to the ranked top-percent list with its group shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.functions.quantiles import LINEAR
from recordlens.functions.runtime import bind, exact_sum, materialize
from recordlens.operators import amounts as A
from recordlens.operators import master as M


def top_list_report(
    entities: DataFrame, key: str, amount: str, group: str, children: Mapping[str, M.Child],
    order: Sequence[str], pct: float = 1.0, rule: str = LINEAR,
) -> DataFrame:
    """Master rows of the top list (with ``chunk``, see :func:`build_master`) with rank, share of the list's amount, and group share.

    The list is stored once: the ranks, the shares and the nested children all start from
    it, and children are read for its entities only.
    """
    top = materialize(A.top_percent(entities, amount, pct, rule))
    kept = {n: replace(c, df=M.restrict_to_ids(c.df, key, top)) for n, c in children.items()}
    ranked = M.build_master(A.amount_rank(top, amount, key), key, order, [], kept)
    shares = A.top_share_by_group(top, group, amount).select(
        group, F.col("n").alias("group_entities"), F.col("pct").alias("group_pct")
    )
    total = top.agg(exact_sum(F.col(amount)).cast("double").alias("total"))
    return (
        bind(ranked.join(shares, group, "left"), total, "_list")
        .withColumn("amount_pct", F.col(amount) * 100 / F.col("_list.total"))
        .drop("_list")
    )
