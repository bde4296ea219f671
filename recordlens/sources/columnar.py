"""Columnar tables by name, narrowed numeric types, JSON sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

_INTEGERS = ((T.ByteType(), 7), (T.ShortType(), 15), (T.IntegerType(), 31), (T.LongType(), 63))
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def read_columnar(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """The named Parquet tables of a folder; absent ones are skipped."""
    tables = {}
    for name in names:
        try:
            tables[name] = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return tables


def write_columnar(df: DataFrame, path: str) -> None:
    df.write.parquet(path, mode="overwrite", compression="snappy")


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line, nested columns as they are."""
    df.write.json(path, mode="overwrite")


def read_nested_json(
    spark: SparkSession, path: str, id_field: str = "entity_id", name_field: str = "master_info.name",
    schema: str | None = None,
) -> DataFrame:
    """(id, name) of an earlier nested result; entries without a name are left out."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return (
        reader.json(path)
        .select(F.col(id_field).try_cast("long").alias("id"), F.col(name_field).alias("name"))
        .filter(F.col("id").isNotNull() & (F.col("name") != ""))
    )


def narrow_plan(df: DataFrame) -> dict[str, T.DataType]:
    """The smallest type per numeric column that keeps its values, from one aggregation.

    A column of whole numbers becomes the smallest integer type; other doubles become
    float only if every value survives the change.
    """
    fields = [
        f for f in df.schema.fields if isinstance(f.dataType, (*_WHOLE, T.FloatType, T.DoubleType))
    ]
    if not fields:
        return {}
    aggs = []
    for i, f in enumerate(fields):
        c = F.col(f.name)
        aggs += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
        if not isinstance(f.dataType, _WHOLE):
            d = c.cast("double")
            aggs += [
                F.coalesce(F.bool_and(d == F.rint(d)), F.lit(False)).alias(f"whole{i}"),
                F.coalesce(F.bool_and(d == d.cast("float").cast("double")), F.lit(False)).alias(f"flt{i}"),
            ]
    # One row, whatever the size of the table: types must be known to build the plan.
    row = df.agg(*aggs).first()
    plan: dict[str, T.DataType] = {}
    for i, f in enumerate(fields):
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        if lo is None:
            continue
        whole = isinstance(f.dataType, _WHOLE) or row[f"whole{i}"]
        if whole and abs(lo) < 2**53 and abs(hi) < 2**53 or isinstance(f.dataType, _WHOLE):
            for kind, bits in _INTEGERS:
                if -(1 << bits) <= lo and hi < (1 << bits):
                    plan[f.name] = kind
                    break
        elif row[f"flt{i}"]:
            plan[f.name] = T.FloatType()
    return plan


def narrow_numeric(df: DataFrame) -> DataFrame:
    """Cast numeric columns to the types of :func:`narrow_plan`; texts are untouched."""
    return df.withColumns({c: F.col(c).cast(t) for c, t in narrow_plan(df).items()})
