"""Column and table profiles, samples, and the audit of a converted copy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordlens.functions.ranking import top_per_group
from recordlens.functions.runtime import percent

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)

# Values looked at per column, and distinct values up to which the top is listed.
KIND_SAMPLE = 100
TOP_VALUES = 5
TOP_BELOW = 100


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def per_column(
    df: DataFrame, columns: Sequence[str], measures: Mapping[str, tuple[Column, ...]]
) -> DataFrame:
    """One aggregation over all columns, returned as one row per column.

    ``measures`` maps an output name to one aggregate per column.
    """
    aggs = [m[i].alias(f"_{name}_{i}") for name, m in measures.items() for i in range(len(columns))]
    rows = ", ".join(
        ", ".join([f"'{c}'"] + [f"_{name}_{i}" for name in measures]) for i, c in enumerate(columns)
    )
    names = ", ".join(["column", *measures])
    return df.agg(*aggs).select(F.expr(f"stack({len(columns)}, {rows}) as ({names})"))


def profile_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean, minimum, maximum and nulls of every numeric column, in one pass."""
    columns = list(columns or numeric_columns(df))
    d = [F.col(c).cast("double") for c in columns]
    return per_column(
        df, columns,
        {
            "mean": tuple(F.avg(c) for c in d),
            "min": tuple(F.min(c) for c in d),
            "max": tuple(F.max(c) for c in d),
            "null_count": tuple(F.count_if(c.isNull()) for c in d),
        },
    )


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) over all given columns; values are counted before the shuffle."""
    return (
        df.select(*[F.col(c).cast("string").alias(c) for c in columns])
        .unpivot([], list(columns), "column", "value")
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def distinct_by_hash(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, distinct_values) over all given columns; 128 bits stand for a value, so long texts are not shuffled."""
    def digest(c: str) -> Column:
        text = F.col(c).cast("string")
        return F.when(F.col(c).isNotNull(), F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")))

    return (
        df.select(*[digest(c).alias(c) for c in columns])
        .unpivot([], list(columns), "column", "value")
        .filter(F.col("value").isNotNull())
        .distinct()
        .groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"))
    )


def many_valued(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns that surely have ``TOP_BELOW`` distinct values or more, by one pass of sketches of bounded size.

    The margin is tenfold, far beyond any error of a sketch; what lies between counts as few.
    """
    if not columns:
        return []
    row = df.agg(*[F.approx_count_distinct(F.col(c).cast("string")).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[f"_{i}"] >= 10 * TOP_BELOW]


def profile_categorical(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct values, nulls, and the top values of columns with few distinct ones.

    Values themselves are counted, and shuffled, for columns that may have few of them only; all others are counted by hash.
    """
    columns = list(columns or text_columns(df))
    many = many_valued(df, columns)
    few = [c for c in columns if c not in many]
    known = F.col("value").isNotNull()
    parts = []
    if few or not many:
        counts = value_counts(df, few)
        stats = counts.groupBy("column").agg(
            F.count_if(known).alias("distinct_values"),
            F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("null_count"),
        )
        top = top_per_group(counts.filter(known), ["column"], [F.desc("n"), F.col("value")], TOP_VALUES, "r")
        shown = top.groupBy("column").agg(
            F.sort_array(F.collect_list(F.struct("r", "value", "n"))).alias("_top")
        )
        joined = F.array_join(
            F.transform("_top", lambda x: F.concat(x["value"], F.lit(":"), x["n"].cast("string"))), ", "
        )
        parts.append(
            stats.join(shown, "column", "left").select(
                "column", "distinct_values", "null_count",
                F.when(F.col("distinct_values") < TOP_BELOW, joined).alias("top_values"),
            )
        )
    if many:
        nulls = per_column(df, many, {"null_count": tuple(F.count_if(F.col(c).isNull()) for c in many)})
        parts.append(
            distinct_by_hash(df, many).join(nulls, "column")
            .select("column", "distinct_values", "null_count", F.lit(None).cast("string").alias("top_values"))
        )
    return union_all(parts)


def approx_distinct(df: DataFrame, columns: Sequence[str], rsd: float = 0.02) -> DataFrame:
    """Distinct values per column by sketch, when exact counting is not needed."""
    return per_column(
        df, columns, {"distinct_values": tuple(F.approx_count_distinct(c, rsd) for c in columns)}
    )


def profile_nulls(df: DataFrame) -> DataFrame:
    """Null count and percent of the columns that have nulls."""
    columns = df.columns
    counts = per_column(
        df, columns,
        {
            "null_count": tuple(F.count_if(F.col(c).isNull()) for c in columns),
            "_rows": tuple(F.count(F.lit(1)) for _ in columns),
        },
    )
    return counts.filter(F.col("null_count") > 0).select(
        "column", "null_count",
        F.round(percent(F.col("null_count"), F.col("_rows")), 2).alias("null_pct"),
    )


def infer_column_kind(df: DataFrame, order: Sequence[str] = (), sample: int | None = None) -> DataFrame:
    """numeric, text or empty per column, judged by all its values in one pass over the table.

    With ``sample``, by the first so many non-null values in ``order``: every column is then a top-k over
    its own values, so nothing is sorted or shuffled whole.
    """
    if sample is None:
        values = [F.col(c).cast("string") for c in df.columns]
        found = per_column(
            df, df.columns,
            {
                "sampled": tuple(F.count(v) for v in values),
                "_bad": tuple(F.count_if(v.isNotNull() & F.trim(v).try_cast("double").isNull()) for v in values),
            },
        ).withColumn("numeric", F.col("_bad") == 0)
    else:
        frames = []
        for c in df.columns:
            first = (
                df.filter(F.col(c).isNotNull())
                .select(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.col(c).cast("string").alias("_v"))
                .orderBy(*[f"_o{i}" for i in range(len(order))])
                .limit(sample)
            )
            frames.append(
                first.agg(
                    F.count(F.lit(1)).alias("sampled"),
                    F.coalesce(
                        F.bool_and(F.trim("_v").try_cast("double").isNotNull()), F.lit(False)
                    ).alias("numeric"),
                ).withColumn("column", F.lit(c))
            )
        found = union_all(frames)
    kind = (
        F.when(F.col("sampled") == 0, "empty").when(F.col("numeric"), "numeric").otherwise("text")
    )
    return found.select("column", "sampled", kind.alias("kind"))


def kind_counts(kinds: DataFrame) -> DataFrame:
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("columns"))


def table_inventory(tables: Mapping[str, tuple[str, DataFrame]]) -> DataFrame:
    """Rows and columns per table, per category and in all; ``tables``: name -> (category, frame)."""
    frames = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(category).alias("category"), F.lit(name).alias("table_name"),
            "rows", F.lit(len(df.columns)).cast("long").alias("columns"),
        )
        for name, (category, df) in tables.items()
    ]
    return (
        union_all(frames)
        .groupingSets([["category", "table_name"], ["category"], []], "category", "table_name")
        .agg(
            F.count(F.lit(1)).alias("tables"),
            F.sum("rows").alias("rows"),
            F.sum("columns").alias("columns"),
        )
    )


def completeness(df: DataFrame) -> DataFrame:
    """Cells, missing cells and percent complete over all columns."""
    missing = F.lit(0)
    for c in df.columns:
        missing = missing + F.col(c).isNull().cast("int")
    return (
        df.agg(
            (F.count(F.lit(1)) * len(df.columns)).alias("cells"),
            F.coalesce(F.sum(missing), F.lit(0)).alias("missing_cells"),
        )
        .withColumn(
            "complete_pct",
            F.round(percent(F.col("cells") - F.col("missing_cells"), F.col("cells")), 2),
        )
    )


def sample_rows(tables: Mapping[str, tuple[DataFrame, Sequence[str]]], k: int = 3) -> DataFrame:
    """The first ``k`` rows of every table as JSON, by the given order."""
    frames = []
    for name, (df, order) in tables.items():
        first = df.orderBy(*order).limit(k)
        frames.append(
            first.select(
                F.lit(name).alias("table_name"),
                F.to_json(F.struct(*order)).alias("row_key"),
                F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row"),
            )
        )
    return union_all(frames)


def _common_type(a: T.DataType | None, b: T.DataType | None) -> str:
    """The type in which values of both are compared: the wider number, else text."""
    if isinstance(a, NUMERIC) and isinstance(b, NUMERIC):
        whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
        if isinstance(a, whole) and isinstance(b, whole):
            return "bigint"
        if isinstance(a, (T.DecimalType, *whole)) and isinstance(b, (T.DecimalType, *whole)):
            return "decimal(38,10)"
        return "double"
    return a.simpleString() if a is not None and a == b and not isinstance(a, T.StringType) else "string"


def _fingerprint(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Rows, nulls and an order-free hash sum per column, over values of the given types."""
    columns = df.columns
    values = []
    for c in columns:
        v = F.col(c).cast(types[c])
        values.append(v + F.lit(0.0) if types[c] == "double" else v)  # no negative zero
    # 48-bit hashes keep the sum of up to 2^40 rows within a decimal without overflow.
    hashes = [F.shiftrightunsigned(F.xxhash64(v), 16).cast("decimal(38,0)") for v in values]
    return per_column(
        df, columns,
        {
            "rows": tuple(F.count(F.lit(1)) for _ in columns),
            "nulls": tuple(F.count_if(v.isNull()) for v in values),
            "hash_sum": tuple(F.sum(F.when(v.isNotNull(), h)) for v, h in zip(values, hashes)),
        },
    )


def audit_conversion(raw: DataFrame, converted: DataFrame) -> DataFrame:
    """Per column of either side: present on both, and the same rows, nulls and values?

    Numbers are compared as the wider of their two types, so narrowing changes nothing unless it
    changes a value; other differing types are compared as text.
    """
    left, right = ({f.name: f.dataType for f in df.schema.fields} for df in (raw, converted))
    types = {c: _common_type(left.get(c), right.get(c)) for c in {**left, **right}}
    a, b = _fingerprint(raw, types), _fingerprint(converted, types)
    joined = a.alias("a").join(b.alias("b"), F.col("a.column") == F.col("b.column"), "full")
    both = F.col("a.column").isNotNull() & F.col("b.column").isNotNull()
    return joined.select(
        F.coalesce("a.column", "b.column").alias("column"),
        F.when(both, "both").when(F.col("a.column").isNull(), "added").otherwise("missing").alias("state"),
        F.col("a.rows").alias("raw_rows"),
        F.col("b.rows").alias("converted_rows"),
        F.col("a.nulls").alias("raw_nulls"),
        F.col("b.nulls").alias("converted_nulls"),
        (
            both
            & (F.col("a.rows") == F.col("b.rows"))
            & F.col("a.hash_sum").eqNullSafe(F.col("b.hash_sum"))
        ).alias("same_values"),
    )


def audit_summary(audits: Mapping[str, DataFrame]) -> DataFrame:
    """Per table: columns on either side, missing, added, equal; one row per table."""
    frames = [a.withColumn("table_name", F.lit(name)) for name, a in audits.items()]
    state = F.col("state")
    return union_all(frames).groupBy("table_name").agg(
        F.count_if(state != "added").alias("raw_columns"),
        F.count_if(state != "missing").alias("converted_columns"),
        F.count_if(state == "missing").alias("missing_columns"),
        F.count_if(state == "added").alias("added_columns"),
        F.bool_and("same_values").alias("all_equal"),
    )
