"""Session-level helpers: stored intermediates and one-row columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for stored intermediates.

    A cluster names it in ``spark.checkpoint.dir``. Only a session that is a single process
    (``local[...]``) may do without it, and then uses a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="recordlens-")
        spark.sparkContext.setCheckpointDir(shared)
    return shared


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/recordlens-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Store ``df`` now, as Parquet in the shared folder, so that later uses read the same rows even if executors are lost.

    Later reads take only the columns they need. The folder belongs to the caller of the session, who
    removes it when its results are no longer read.
    """
    path = scratch_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_small(df: DataFrame, by: list[str]) -> DataFrame:
    """``df`` dealt over all cores by ``by``, if its files hold less than a full split for each of them.

    Such a table may be one row group, hence one task, whatever a CPU-bound step then does with it. Its shuffle is at most
    one split per core; larger tables have tasks enough and stay where they are. The rows are the same.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores, *by) if size < cores * split else df


def bind(df: DataFrame, one_row: DataFrame, name: str) -> DataFrame:
    """Add the single row of ``one_row`` as a struct column: a scalar subquery, run once.

    Referring to the column instead of the subquery keeps one copy of it in the plan.
    """
    return df.withColumn(name, one_row.select(F.struct(*one_row.columns).alias("s")).scalar())


def percent(num: Column, den: Column) -> Column:
    """num of den in percent; null when den is 0."""
    return F.when(den != 0, num.cast("double") * 100.0 / den)


def exact_sum(col: Column, scale: int = 2) -> Column:
    """Decimal sum of doubles with ``scale`` places, which does not depend on the order.

    The scaled value passes through a whole number: a direct cast of a double to decimal
    goes over its text.
    """
    whole = F.rint(col.cast("double") * F.lit(float(10**scale))).cast("long").cast("decimal(18,0)")
    return F.sum(whole) / F.lit(10**scale).cast("decimal(18,0)")
