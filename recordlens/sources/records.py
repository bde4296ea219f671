"""CSV files with line breaks in quoted values, read by as many tasks as they have blocks.

Whether a line ends inside quotes depends on whether it started there, so a line is a function of one bit: what it leaves
open if it starts outside quotes, and if it starts inside. Functions of the lines of a block compose to one of the block;
a running composition over the blocks of a file, a row each, tells how every block starts. Then each task cuts its blocks into
records, and the pieces of records that cross a block's edge are put together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A value in quotes up to the next delimiter, or one without; "" within quotes is a quote. All loops are possessive.
_INSIDE = r'(?:[^"]++|"")*+'
_FIELDS = rf'(?:(?:"{_INSIDE}"[^,]*+|[^",][^,]*+|),)*+'
OPENS = rf'\A{_FIELDS}"{_INSIDE}\z'
STAYS_OPEN = rf'\A{_INSIDE}(?:"[^,]*+,{_FIELDS}"{_INSIDE})?\z'

_SUMMARY = "file long, block long, outside boolean, inside boolean"
_PIECES = "path string, block long, first boolean, piece boolean, opens boolean, record string"


def _lines(spark: SparkSession, paths: Sequence[str], charset: str) -> DataFrame:
    """Lines in file order within a task, each with its file, its block, and what it leaves open."""
    raw = spark.read.text(list(paths), lineSep="\n").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value")
    )
    text = F.col("value") if charset == "UTF-8" else F.decode(F.col("value").cast("binary"), charset)
    return raw.select("path", F.xxhash64("path").alias("file"), "block", text.alias("line")).withColumns(
        {"outside": F.col("line").rlike(OPENS), "inside": F.col("line").rlike(STAYS_OPEN)}
    )


def _ends(outside: np.ndarray, inside: np.ndarray, start: bool) -> np.ndarray:
    """Whether quotes are open at the end of each line, if they are at the start of the first."""
    # Some lines end alike however they start, some change nothing, some turn it round.
    fixed = outside == inside
    turns = np.cumsum(outside & ~inside)
    at = np.maximum.accumulate(np.where(fixed, np.arange(len(fixed)), -1))
    known = at >= 0
    since = np.where(known, outside[at], start)
    return since ^ ((turns - np.where(known, turns[at], 0)) % 2 == 1)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """The rows of a batch by (file, block)."""
    file, block = np.asarray(batch.column("file")), np.asarray(batch.column("block"))
    edges = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
    for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(file)], strict=True):
        if hi > lo:
            yield (int(file[lo]), int(block[lo])), batch.slice(lo, hi - lo)


def _bools(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(bool)


def _block_starts(lines: DataFrame) -> DataFrame:
    """(file, block, start): whether a block starts inside quotes. One row per block of a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, into = None, False, True
        for batch in batches:
            for place, rows in _runs(batch):
                if place != now:
                    if now is not None:
                        yield pa.RecordBatch.from_pydict({"file": [now[0]], "block": [now[1]], "outside": [out], "inside": [into]})
                    now, out, into = place, False, True
                outside, inside = _bools(rows.column("outside")), _bools(rows.column("inside"))
                out, into = bool(_ends(outside, inside, out)[-1]), bool(_ends(outside, inside, into)[-1])
        if now is not None:
            yield pa.RecordBatch.from_pydict({"file": [now[0]], "block": [now[1]], "outside": [out], "inside": [into]})

    blocks = lines.select("file", "block", "outside", "inside").mapInArrow(run, _SUMMARY)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # The state before a block: what the last block that fixes it left, turned as often as blocks since then turn it.
    turns = blocks.withColumn("fixed", F.col("outside") == F.col("inside")).withColumn(
        "turned", F.sum((F.col("outside") & ~F.col("inside")).cast("int")).over(Window.partitionBy("file").orderBy("block"))
    )
    fixed = F.last(F.when(F.col("fixed"), F.struct("outside", "turned")), ignorenulls=True).over(before)
    state = turns.withColumns({"last": fixed, "now": F.coalesce(F.max("turned").over(before), F.lit(0))})
    odd = (F.col("now") - F.coalesce(F.col("last.turned"), F.lit(0))) % 2 == 1
    return state.select("file", "block", (F.coalesce(F.col("last.outside"), F.lit(False)) != odd).alias("start"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, path, state, held, head, number = None, "", False, [], False, 0

    def rows(path: str, block: int, records: list[tuple[bool, bool, bool, str]]) -> pa.RecordBatch:
        first, piece, opens, text = (list(x) for x in zip(*records, strict=True)) if records else ([], [], [], [])
        n = len(text)
        return pa.RecordBatch.from_arrays(
            [pa.array([path] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array(first, pa.bool_()),
             pa.array(piece, pa.bool_()), pa.array(opens, pa.bool_()), pa.array(text, pa.string())],
            names=["path", "block", "first", "piece", "opens", "record"],
        )

    def left() -> Iterator[pa.RecordBatch]:
        if now is not None and held:
            yield rows(path, now[1], [(now[1] == 0 and number == 0, True, not head, "\n".join(held))])

    for batch in batches:
        for place, part in _runs(batch):
            if place != now:
                yield from left()
                now, path, held, number = place, part.column("path")[0].as_py(), [], 0
                state = head = bool(part.column("start")[0].as_py())
            ends = _ends(_bools(part.column("outside")), _bools(part.column("inside")), state)
            out = []
            for line, is_open in zip(part.column("line").to_pylist(), ends.tolist(), strict=True):
                if is_open or held:
                    held.append(line)
                    if is_open:
                        continue
                    line, held = "\n".join(held), []
                # What a block starts with inside quotes belongs to a record of the block before.
                out.append((now[1] == 0 and number == 0, head, False, line))
                head, number = False, number + 1
            state = bool(ends[-1])
            yield rows(path, now[1], out)
    yield from left()


def read_records(spark: SparkSession, paths: Sequence[str], charset: str) -> DataFrame:
    """(path, first, record): the records of all files as text, ``first`` for that of the header. Lines end with a line feed, with or
    without a carriage return; where a quote is still open at the end of a file, that line feed is not part of the value."""
    lines = _lines(spark, paths, charset)
    # A row of a few numbers per block of a file, 128 MB by default.
    starts = F.broadcast(_block_starts(lines))
    pieces = lines.join(starts, ["file", "block"]).select("file", "path", "block", "outside", "inside", "line", "start").mapInArrow(_cut, _PIECES)
    whole = pieces.filter("not piece").select("path", "first", "record")
    number = F.sum(F.col("opens").cast("int")).over(Window.partitionBy("path").orderBy("block", "opens"))
    crossing = pieces.filter("piece").withColumn("number", number).groupBy("path", "number").agg(
        F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("block", "record"))).alias("parts")
    )
    joined = crossing.select("path", "first", F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))
    return whole.unionByName(joined).withColumn("record", F.regexp_replace("record", r"\r\z", "")).filter("record <> ''")


def read_quoted(spark: SparkSession, paths: Sequence[str], charset: str) -> DataFrame:
    """All columns as text, with ``_path``; the files share one header."""
    header = spark.read.csv([min(paths)], header=True, inferSchema=False, encoding=charset, quote='"', escape='"', multiLine=True).columns
    names = ", ".join("`{}` string".format(c.replace("`", "``")) for c in header)
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    rows = read_records(spark, paths, charset).filter("not first")
    return rows.select(F.col("path").alias("_path"), F.from_csv("record", names, options).alias("r")).select("_path", "r.*")
