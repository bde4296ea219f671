"""From a folder of CSV files to narrowed columnar tables and their inventory."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

from recordlens.operators.profile import table_inventory
from recordlens.sources import columnar, csv


def discover(spark: SparkSession, folder: str, suffix: str = ".csv") -> dict[str, list[str]]:
    """Table name -> its files: a file ``x.csv`` or the part files of a folder ``x.csv``, in any store Spark lists."""
    files = spark.read.option("recursiveFileLookup", "true").text(folder).inputFiles()
    tables: dict[str, list[str]] = {}
    for path in sorted(files):
        parts = unquote(path).rstrip("/").split("/")
        name = next((p for p in reversed(parts[-2:]) if p.endswith(suffix) and not p.startswith("part-")), None)
        if name:
            tables.setdefault(name.removesuffix(suffix), []).append(path)
    return tables


def category_of(name: str) -> str:
    return next((c for prefix, c in csv.CATEGORIES.items() if name.startswith(prefix)), csv.UNKNOWN_CATEGORY)


def ingest(spark: SparkSession, folder: str, target: str, encodings: Sequence[str] = csv.ENCODINGS) -> DataFrame:
    """Read every CSV table of ``folder``, narrow it, store it under ``target``, and return the inventory.

    This stores the tables at once, one after the other, as ``target/<name>.parquet``; each may have
    its own encoding and header.
    """
    found = discover(spark, folder)
    for name, paths in found.items():
        raw = csv.read_csv_any_encoding(spark, paths, encodings)
        columnar.write_columnar(columnar.narrow_numeric(raw), f"{target.rstrip('/')}/{name}.parquet")
    stored = columnar.read_columnar(spark, target, list(found))
    return table_inventory({n: (category_of(n), df) for n, df in stored.items()})
