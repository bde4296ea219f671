"""Connected components of an edge table, by joins and minima alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.llm.common import store


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (or smaller) neighbours of every node on its least neighbour."""
    pairs = _both_ways(edges)
    if not large:
        pairs = pairs.filter("v < u")
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = pairs.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for all nodes of ``edges`` (a, b: of one type with an order); the root is the least node of its component.

    Alternates large-star and small-star steps, which end in one star per component after a
    number of rounds logarithmic in the number of nodes. A hub's neighbours are never
    gathered: each step is a minimum per node, aggregated before the shuffle, and a join that
    adaptive execution may split. Every round is stored in the shared folder.
    """
    now = store(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(),
        "edges",
    )
    seen = None
    for _ in range(rounds):
        state = now.agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"),
            F.sum(F.shiftrightunsigned(F.xxhash64("b", "a"), 16).cast("decimal(38,0)")).alias("s"),
        ).first()
        if state == seen:
            # Stars: every node points at its root.
            out = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return out.unionByName(out.select(F.col("root").alias("node"), "root").distinct())
        seen = state
        now = store(_star(_star(now, large=True), large=False), "edges")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
