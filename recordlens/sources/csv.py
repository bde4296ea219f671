"""CSV files of unknown text encoding, their categories, and name lists."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlens.sources.records import read_quoted

# ---------------------------------------------------------------------------
# Encodings in the order they are tried.
ENCODINGS = ("utf-8", "shift-jis", "cp932", "utf-8-sig", "iso-2022-jp", "euc-jp")
# The JVM names of the encodings.
JAVA_CHARSETS = {
    "utf-8": "UTF-8",
    "shift-jis": "Shift_JIS",
    "cp932": "MS932",
    "utf-8-sig": "UTF-8",
    "iso-2022-jp": "ISO-2022-JP",
    "euc-jp": "EUC-JP",
}
# Categories by the prefix of the file name.
CATEGORIES = {
    "1-": "基本情報",
    "2-": "予算・執行",
    "3-": "効果発現経路",
    "4-": "点検・評価",
    "5-": "支出先",
    "6-": "その他",
}
UNKNOWN_CATEGORY = "不明"
# ---------------------------------------------------------------------------


def _python_encodings(lines: DataFrame, encodings: Sequence[str]) -> DataFrame:
    """(path, encoding) by decoding every non-ASCII line in every encoding."""

    @F.pandas_udf("long")
    def failed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def mask(line: bytes) -> int:
            bad = 0
            for i, name in enumerate(encodings):
                try:
                    line.decode(name)
                except UnicodeDecodeError:
                    bad |= 1 << i
            return bad

        for lines in batches:
            yield lines.map(lambda b: mask(bytes(b))).astype("int64")

    # An all-ASCII line without an escape decodes the same in every encoding.
    plain = ~F.col("line").cast("string").rlike(r"[^\x01-\x1a\x1c-\x7f]")
    per_file = (
        lines.select("path", F.when(plain, F.lit(0).cast("long")).otherwise(failed("line")).alias("bad"))
        .groupBy("path")
        .agg(F.bit_or("bad").alias("bad"))
    )
    first = F.lit(None).cast("string")
    for i, name in reversed(list(enumerate(encodings))):
        first = F.when(F.col("bad").bitwiseAND(F.lit(1 << i)) == 0, F.lit(name)).otherwise(first)
    return per_file.select("path", first.alias("encoding"))


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Lines of raw bytes, so that a large file is split over many tasks.

    All supported encodings keep the line feed byte for line ends only.
    """
    return spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("line"), F.col("value"),
    )


def detect_encodings(
    spark: SparkSession, paths: Sequence[str], encodings: Sequence[str] = ENCODINGS
) -> DataFrame:
    """(path, encoding): the first encoding that decodes every line of a file, null if none does.

    Where UTF-8 comes first, files that are valid in it are settled in the JVM, and Python sees
    only the lines of the others.
    """
    lines = _lines(spark, paths)
    if not encodings or encodings[0] not in ("utf-8", "utf-8-sig"):
        return _python_encodings(lines, encodings)
    valid = lines.groupBy("path").agg(F.bool_and(F.is_valid_utf8("value")).alias("ok"))
    rest = lines.join(valid.filter(~F.col("ok")), "path", "left_semi")
    return valid.filter("ok").select("path", F.lit(encodings[0]).alias("encoding")).unionByName(
        _python_encodings(rest, encodings)
    )


def _layout_aggregates() -> list[Column]:
    """The first line of a file as hexadecimal bytes, and whether some line holds an odd number of quotes."""
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    return [F.min_by(F.hex("line"), "at").alias("header"), F.max(quotes % 2 == 1).alias("quoted")]


def _numbered(lines: DataFrame) -> DataFrame:
    return lines.withColumn("at", F.when(F.col("block") == 0, F.monotonically_increasing_id()))


def _layouts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, header, quoted) of each file."""
    return _numbered(_lines(spark, paths)).groupBy("path").agg(*_layout_aggregates())


def _survey(spark: SparkSession, paths: Sequence[str], encodings: Sequence[str]) -> list[tuple[str, str | None, str, bool]]:
    """(path, encoding, header, quoted) of each file, from one scan; files that are not UTF-8 are decoded in a second one."""
    utf8 = bool(encodings) and encodings[0] in ("utf-8", "utf-8-sig")
    lines = _numbered(_lines(spark, paths))
    valid = F.bool_and(F.is_valid_utf8("value")) if utf8 else F.lit(False)
    # One row per file, as the list of files itself.
    found = lines.groupBy("path").agg(valid.alias("ok"), *_layout_aggregates()).collect()
    rest = [r["path"] for r in found if not r["ok"]]
    other = {r["path"]: r["encoding"] for r in _python_encodings(_lines(spark, rest), encodings).collect()} if rest else {}
    return [(r["path"], encodings[0] if r["ok"] else other.get(r["path"]), r["header"], r["quoted"]) for r in found]


def allow_java_charsets(spark: SparkSession) -> None:
    """Accept encodings beyond the default list in this session's CSV readers and writers.

    The setting must still hold when a lazy read runs, so it is not taken back.
    """
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def _read_groups(
    spark: SparkSession, files: Sequence[tuple[str, str, str, bool]], keep_source: bool
) -> DataFrame:
    """Files as (path, encoding, header, quoted) in one all-string frame, united by column name.

    A reader takes the header of one file for all it is given, so files are read by groups of equal
    header, encoding and quoting.
    """
    groups: dict[tuple[str, str, bool], list[str]] = {}
    for path, encoding, header, quoted in files:
        groups.setdefault((encoding, header or "", bool(quoted)), []).append(path)
    if {e for e, _, _ in groups} - {"utf-8", "utf-8-sig"}:
        allow_java_charsets(spark)
    frames = []
    for (encoding, _, quoted), members in sorted(groups.items(), key=lambda g: min(g[1])):
        charset = JAVA_CHARSETS[encoding]
        if quoted:
            df, path = read_quoted(spark, sorted(members), charset), F.col("_path")
            source = F.element_at(F.split(path, "/"), -1)
        else:
            df = spark.read.csv(sorted(members), header=True, inferSchema=False, encoding=charset, quote='"', escape='"')
            source = F.col("_metadata.file_name")
        columns = [F.col(f"`{c}`") for c in df.columns if not (quoted and c == "_path")]
        frames.append(df.select(*columns, *([source.alias("source_file"), F.lit(encoding).alias("encoding")] if keep_source else [])))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# Types of a column of texts, the first that all its values have; a value's mask has a bit for each type that it lacks.
_TYPES = ("int", "bigint", "double", "date", "timestamp", "boolean")
_NO_TYPE, _SEEN = (1 << len(_TYPES)) - 1, 1 << len(_TYPES)
_DATE, _TIME = r"^\s*\d{4}-\d{1,2}-\d{1,2}\s*$", r"^\s*\d{4}-\d{1,2}-\d{1,2}[ T]"
# What casts to whole numbers and to double may take, and more; a failed cast of anything else is dear.
_WHOLE = r"^[\x00-\x20\x7f]*+[+-]?[0-9]++[\x00-\x20\x7f]*$"
_NUMBER = r"^[\x00-\x20\x7f]*+[+-]?(?:[0-9.]++(?:[eE][+-]?[0-9]++)?[dDfF]?|0[xX][0-9a-fA-F.]*[pP][+-]?[0-9]++[dDfF]?|[iI][nN][fF][a-zA-Z]*|[nN][aA][nN])[\x00-\x20\x7f]*$"
# First letters of infinity, nan, true and false.
_LETTERS = [ord(c) for c in "IiNnTtFf"]


def _lacks(v: Column) -> Column:
    """The mask of a value: 0 for none. Most texts are settled by their first character."""

    def only(*types: str) -> Column:
        return F.lit((_NO_TYPE | _SEEN) & ~sum(1 << _TYPES.index(t) for t in types))

    first = F.ascii(v)
    # White space and control characters, digits and signs.
    worth = (first <= 32) | first.between(43, 57) | (first == 127) | first.isin(*_LETTERS)
    return (
        F.when(v.isNull(), F.lit(0)).when(~worth, only())
        .when(v.rlike(_WHOLE) & v.try_cast("int").isNotNull(), only("int", "bigint", "double"))
        .when(v.rlike(_WHOLE) & v.try_cast("bigint").isNotNull(), only("bigint", "double"))
        .when(v.rlike(_NUMBER) & v.try_cast("double").isNotNull(), only("double"))
        .when(v.rlike(_DATE) & v.try_cast("date").isNotNull(), only("date"))
        .when(v.rlike(_TIME) & v.try_cast("timestamp").isNotNull(), only("timestamp"))
        .when(F.lower(F.trim(v)).isin("true", "false"), only("boolean"))
        .otherwise(only())
    )


def infer_types(df: DataFrame, leave: Sequence[str] = ()) -> DataFrame:
    """Cast all-string columns to int, long, double, date, timestamp or boolean where every value allows it.

    One pass over the whole frame, whatever files it came from: every value gives a mask of the types it lacks, and the masks of a
    column are or-ed. A column without values stays a string.
    """
    columns = [c for c in df.columns if c not in leave]
    if not columns:
        return df
    found = df.agg(*[F.bit_or(_lacks(F.col(f"`{c}`"))).alias(f"m{i}") for i, c in enumerate(columns)]).first()  # one row
    casts = {}
    for i, c in enumerate(columns):
        mask = found[f"m{i}"] or 0
        kind = next((t for k, t in enumerate(_TYPES) if not mask >> k & 1), None)
        if mask & _SEEN and kind:
            casts[c] = F.col(f"`{c}`").cast(kind)
    return df.withColumns(casts) if casts else df


def read_csv_any_encoding(
    spark: SparkSession, paths: Sequence[str], encodings: Sequence[str] = ENCODINGS,
    infer: bool = True, keep_source: bool = False,
) -> DataFrame:
    """All files as one frame; a column some file lacks is null there.

    Every file keeps its own header, values may hold quotes and line breaks, and types are those
    that all files' values have. The file list is on the driver as in any Spark read; file contents
    never are. Files in which a quote is open at a line end are read by :mod:`recordlens.sources.records`, all others by
    Spark's own reader; both split large files. Each file is scanned once to know its encoding and layout, and once for the types.
    """
    files = _survey(spark, paths, encodings)
    unreadable = sorted(p for p, e, _, _ in files if e is None)
    if unreadable:
        raise ValueError(f"no encoding decodes {unreadable}")
    df = _read_groups(spark, files, keep_source)
    return infer_types(df, ("source_file", "encoding") if keep_source else ()) if infer else df


def read_all_string(spark: SparkSession, paths: Sequence[str], encoding: str = "utf-8") -> DataFrame:
    """CSV without any type inference, each file with its own header, united by column name."""
    layouts = _layouts(spark, paths).collect()
    return _read_groups(spark, [(r["path"], encoding, r["header"], r["quoted"]) for r in layouts], False)


def tag_source_category(file_name: Column) -> tuple[Column, Column]:
    """Category by the prefix of the file name, and its third part between underscores."""
    category = F.lit(UNKNOWN_CATEGORY)
    for prefix, name in CATEGORIES.items():
        category = F.when(file_name.startswith(prefix), F.lit(name)).otherwise(category)
    part = F.coalesce(F.get(F.split(file_name, "_"), F.lit(2)), F.lit(""))
    return category, part


def read_name_list(spark: SparkSession, path: str) -> DataFrame:
    """(name): one per line, trimmed, blank lines left out, copies kept."""
    return (
        spark.read.text(path)
        .select(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("name"))
        .filter(F.col("name") != "")
    )


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """CSV in UTF-8 with a header; nested columns as JSON text.

    With ``bom`` the first header cell starts with a byte order mark, for spreadsheets.
    """
    nested = {
        f.name: F.to_json(f.name)
        for f in df.schema.fields
        if f.dataType.typeName() in ("array", "struct", "map")
    }
    flat = df.withColumns(nested) if nested else df
    if bom:
        first = flat.columns[0]
        flat = flat.withColumnRenamed(first, f"﻿{first}")
    flat.write.csv(path, header=True, mode="overwrite", escape='"')
