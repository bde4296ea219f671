"""Row-level expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The limits of the amount tiers, in currency units.
SIZE_LIMITS = (1e8, 1e9, 1e10)
SIZE_NAMES = ("small", "medium", "large", "mega")
TOP_LIMITS = (1e11, 1e12)
TOP_NAMES = ("medium", "large", "mega")
# Limits of the group share in percent.
SHARE_LIMITS = (5.0, 10.0)
SHARE_NAMES = ("low", "mid", "high")
# Words looked for in a name that found no partner.
NAME_KEYWORDS = ("AI", "ＡＩ", "A.I.", "人工知能", "機械学習", "生成AI", "生成ＡＩ")
NAME_BRACKETS = ("（", "）")
LONG_NAME = 50
# Plausible range of an amount found in text.
AMOUNT_RANGE = (1e3, 1e12)


def coerce_number(col: Column, bad: float | None = None) -> Column:
    """Text to double; what is no number becomes null, or ``bad``."""
    number = F.trim(col.cast("string")).try_cast("double")
    return number if bad is None else F.coalesce(number, F.lit(float(bad)))


def parse_money(col: Column) -> Column:
    """'1,234円' to 1234.0; null unless it is a positive number."""
    number = F.trim(F.regexp_replace(col.cast("string"), "[,円]", "")).try_cast("double")
    return F.when(number > 0, number)


def extract_numbers(col: Column, bounds: tuple[float, float] | None = None) -> Column:
    """Every run of digits in a text, thousands separators removed, as doubles."""
    runs = F.regexp_extract_all(F.regexp_replace(col, ",", ""), F.lit(r"(\d+)"), 1)
    numbers = F.transform(runs, lambda x: x.try_cast("double"))
    if bounds is None:
        return numbers
    return F.filter(numbers, lambda x: x.between(*bounds))


def matching_fields(
    columns: Sequence[str], parts: Sequence[str], exclude: Sequence[str] = ()
) -> list[str]:
    """Column names holding one of ``parts`` and none of ``exclude``."""
    return [
        c for c in columns if any(p in c for p in parts) and not any(x in c for x in exclude)
    ]


def field_key_filter(
    fields: Column, parts: Sequence[str], exclude: Sequence[str] = ()
) -> Column:
    """The entries of a map whose key holds one of ``parts`` and none of ``exclude``."""

    def keep(key: Column, _: Column) -> Column:
        wanted = F.lit(False)
        for p in parts:
            wanted = wanted | key.contains(p)
        for x in exclude:
            wanted = wanted & ~key.contains(x)
        return wanted

    return F.map_filter(fields, keep)


def clip_text(col: Column, length: int = 300) -> Column:
    return F.substring(col, 1, length)


def has_child_flags(df: DataFrame, count_cols: Sequence[str]) -> DataFrame:
    """``has_x`` for every ``x_count``."""
    return df.withColumns(
        {f"has_{c.removesuffix('_count')}": F.coalesce(F.col(c), F.lit(0)) > 0 for c in count_cols}
    )


def total_related(count_cols: Sequence[str]) -> Column:
    total = F.lit(0).cast("long")
    for c in count_cols:
        total = total + F.coalesce(F.col(c), F.lit(0))
    return total


def decade_bucket(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def execution_rate(executed: Column, current: Column) -> Column:
    """Executed share of the current amount in percent, 0 without a current amount."""
    return F.when(current > 0, F.coalesce(executed, F.lit(0.0)) / current * 100).otherwise(0.0)


def tier(col: Column, limits: Sequence[float], names: Sequence[str], closed: bool = True) -> Column:
    """Name of the interval a value falls in; with ``closed`` a limit belongs to the upper one."""
    if len(names) != len(limits) + 1:
        raise ValueError("one name more than limits is needed")
    out = F.when(col.isNull(), F.lit(None).cast("string"))
    for limit, name in zip(limits, names):
        out = out.when(col < limit if closed else col <= limit, F.lit(name))
    return out.otherwise(F.lit(names[-1]))


def size_tier(
    amount: Column, limits: Sequence[float] = SIZE_LIMITS, names: Sequence[str] = SIZE_NAMES
) -> Column:
    return tier(amount, limits, names)


def top_list_tier(
    amount: Column, limits: Sequence[float] = TOP_LIMITS, names: Sequence[str] = TOP_NAMES
) -> Column:
    return tier(amount, limits, names)


def share_band(share: Column) -> Column:
    """Group share in percent: above 10 high, above 5 mid, else low."""
    return tier(share, SHARE_LIMITS, SHARE_NAMES, closed=False)


def missing_text(col: Column) -> Column:
    """Null for null, blank and the text 'nan'."""
    return F.when(F.trim(col).isin("", "nan"), F.lit(None).cast("string")).otherwise(col)


def null_policy(df: DataFrame, policy: Mapping[str, str]) -> DataFrame:
    """Apply 'zero', 'empty' or 'missing' to the named columns that exist."""
    rules = {
        "zero": lambda c: F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0)),
        "empty": lambda c: F.coalesce(c, F.lit("")),
        "missing": missing_text,
    }
    return df.withColumns(
        {name: rules[rule](F.col(name)) for name, rule in policy.items() if name in df.columns}
    )


def diagnose_unmatched(df: DataFrame, name: str) -> DataFrame:
    """Why a name may have found no partner: words found, length, brackets."""
    c = F.col(name)
    found = [F.when(c.contains(k), F.lit(k)) for k in NAME_KEYWORDS]
    brackets = F.lit(False)
    for b in NAME_BRACKETS:
        brackets = brackets | c.contains(b)
    return df.select(
        name,
        F.concat_ws(", ", *found).alias("keywords_found"),
        (F.coalesce(*found).isNull()).alias("no_keyword"),
        F.length(c).alias("name_length"),
        (F.length(c) > LONG_NAME).alias("is_long"),
        brackets.alias("has_brackets"),
    )


def prefix_columns(df: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """Keys first, then every other column as ``table_column`` in name order."""
    rest = sorted(c for c in df.columns if c not in keys)
    return df.select(*keys, *[F.col(c).alias(f"{table}_{c}") for c in rest])
