"""Queries by name, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6


class Tables:
    """Parquet tables of a folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Register ``f(tables)`` under ``name``.

    Columns listed in ``doubles`` are rounded on both sides, as floating sums depend on
    the order of additions.
    """
    rounded = doubles.split()

    def register(f: Callable[[Tables], DataFrame]):
        @wraps(f)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            out = f(Tables(spark, folder))
            return out.withColumns({c: F.round(F.col(c).cast("double"), DIGITS) for c in rounded})

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            text = sql.strip()
            if rounded:
                casts = ", ".join(f"round(CAST({c} AS DOUBLE), {DIGITS}) AS {c}" for c in rounded)
                text = f"SELECT * REPLACE ({casts}) FROM (\n{text}\n) AS r"
            ORACLES[name] = text
        return f

    return register
