"""Exact copies by an extendible-hash index on shared files, in DataFrame operations alone.

1. The rows, with their normalised text, its 64-bit key and its SHA-256 value, are written once to the shared folder.
2. The directory starts with one bucket for all keys. A bucket of more keys than fit is split by the next bit of the key, and the
   directory doubles as often as its deepest bucket asks. Only slots that hold keys are rows of it, so it may double up to
   all 64 bits; keys that agree in all of them share a bucket of one key, which is never overfull.
3. Owner tasks take contiguous ranges of buckets. Keys with one row need no comparison. Texts of the others are compared byte
   by byte while they are grouped: copies melt into one entry before the shuffle, so a hot text sends a row per task. The
   distinct texts of a key are its chain, in the order of their bytes.
4. Every row finds its place in a chain by its key and SHA-256 value, both narrow.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordlens.llm.common import join_counted, shared_path, shuffle_partitions, store

# Keys of a bucket, and bits by which the first directory is finer than even keys need.
CAPACITY, SPARE_BITS = 4_096, 3
KEY_BITS = 64


def normalised(text: Column) -> Column:
    """A-Z as a-z and nothing else changed; null counts as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), ascii_uppercase, ascii_lowercase)


def _slot(key: Column, depth: int) -> Column:
    """The first ``depth`` bits of a key as a number that is not negative, except for all 64 bits."""
    return F.shiftrightunsigned(key, KEY_BITS - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(depth, slot, bucket, bucket_depth, n): the doubled directory of a table of distinct keys (key long).

    Slots of the same bucket point at it: ``bucket`` is the least key that its bits allow, shifted so that buckets sort as
    unsigned keys do, and ``bucket_depth`` the number of these bits. ``n`` keys are in the bucket. Rows of a smaller
    ``depth`` come from slots that needed no further doubling.
    """
    total = keys.count()
    depth = min(KEY_BITS, max(0, (max(total, 1) // capacity).bit_length() + SPARE_BITS))
    open_keys, above, done = keys.select("key"), 0, []
    while True:
        slots = open_keys.groupBy(_slot(F.col("key"), depth).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
        slots = store(slots, "directory-slots")
        # Every slot's buckets at all depths since the last doubling; the first that is not overfull is its bucket.
        levels = slots.withColumn("d", F.explode(F.sequence(F.lit(above), F.lit(depth))))
        levels = levels.withColumn("prefix", F.expr(f"shiftrightunsigned(slot, {depth} - d)") if depth else F.col("slot"))
        sizes = levels.groupBy("d", "prefix").agg(F.sum("n").alias("held")).filter(F.col("held") <= capacity)
        fits = levels.join(sizes, ["d", "prefix"]).groupBy("slot").agg(F.min(F.struct("d", "prefix", "held")).alias("b"))
        found = slots.join(fits, "slot", "left")
        low = F.expr(f"shiftleft(b.prefix, {KEY_BITS} - b.d)") if depth else F.lit(0).cast("long")
        low = F.when(F.col("b.d") == 0, F.lit(0).cast("long")).otherwise(low)
        settled = found.filter("b is not null") if depth < KEY_BITS else found
        done.append(
            settled.select(
                F.lit(depth).alias("depth"), "slot", F.coalesce(low, F.col("slot")).bitwiseXOR(F.lit(-(1 << 63))).alias("bucket"),
                F.coalesce("b.d", F.lit(depth)).alias("bucket_depth"), F.coalesce("b.held", "n").alias("n"),
            )
        )
        overfull = store(found.filter("b is null").select("slot"), "directory-overfull")
        if depth == KEY_BITS or overfull.isEmpty():
            break
        open_keys = store(open_keys.join(overfull, _slot(F.col("key"), depth) == F.col("slot"), "left_semi"), "directory-open")
        above, depth = depth + 1, min(KEY_BITS, depth + 8)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


@dataclass
class Index:
    """The files of an index: rows (doc_id, text, key, seal), directory, chains (bucket, key, place, text, seal, size, keep_id)."""

    spark: SparkSession
    path: str

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @property
    def rows(self) -> DataFrame:
        return self._read("rows")

    @property
    def directory(self) -> DataFrame:
        return self._read("directory")

    @property
    def chains(self) -> DataFrame:
        return self._read("chains")


def _bucketed(keys: DataFrame, slots: DataFrame, depths: list[int]) -> DataFrame:
    """``keys`` with their bucket: a look-up of the first bits in the directory, at each depth it has."""
    out = None
    for depth in depths:
        at = slots.filter(F.col("depth") == depth).select("slot", "bucket")
        found = keys.join(at, _slot(F.col("key"), depth) == F.col("slot")).drop("slot")
        out = found if out is None else out.unionByName(found)
    return out


def build_index(
    documents: DataFrame, path: str | None = None, key: Callable[[Column], Column] = F.xxhash64, capacity: int = CAPACITY,
) -> Index:
    """Writes the index of ``documents`` (doc_id, text; other columns are left out) to ``path``, or a new shared folder.

    ``key`` gives the 64-bit key of a normalised text; any function of it does, a poor one makes longer chains.
    """
    spark = documents.sparkSession
    index = Index(spark, path or shared_path(spark, "exact-index"))
    text = documents.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("text"))
    text.withColumns({"key": key(F.col("text")).cast("long"), "seal": F.sha2("text", 256)}).write.parquet(f"{index.path}/rows")
    keys = store(index.rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "index-keys")
    directory(keys, capacity).write.parquet(f"{index.path}/directory")
    slots = index.directory
    depths = sorted(r["depth"] for r in slots.select("depth").distinct().collect())  # at most ten
    shared = keys.filter("n > 1")
    several = _bucketed(shared, slots, depths) if depths else shared.withColumn("bucket", F.lit(0).cast("long"))
    several = store(several, "index-several")
    texts = join_counted(index.rows, several, ["key"], "n", "inner").groupBy("bucket", "key", "text").agg(
        F.min("seal").alias("seal"), F.count(F.lit(1)).alias("size"), F.max("doc_id").alias("keep_id")
    )
    chain = Window.partitionBy("bucket", "key").orderBy("text")
    owned = texts.repartitionByRange(shuffle_partitions(spark), "bucket")
    owned.withColumn("place", F.row_number().over(chain) - 1).write.parquet(f"{index.path}/chains")
    return index


def dedup(documents: DataFrame, **options) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``documents``.

    Texts are equal when identical after lower-casing A-Z. ``keep_id`` is the largest doc_id of the equal texts, and the
    row that has it is kept. Null texts are empty texts; all empty ones are equal. Rows that repeat both a doc_id and a text each
    get a row, and all of them are kept if their id is the largest. A null doc_id is less than any other; where all of
    a group's are null, ``keep_id`` is null and the rows are kept. An empty table gives no rows.
    """
    index = build_index(documents, **options)
    rows = index.rows.select("doc_id", "key", "seal")
    groups = index.chains.select("key", "seal", "size", "keep_id")
    found = join_counted(rows, groups, ["key", "seal"], "size")
    alone = F.col("size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.col("seal").alias("text_sha256"),
    )


def keep_one(documents: DataFrame, **options) -> DataFrame:
    """The rows of ``documents``, with all their columns, whose doc_id is the largest of their equal texts."""
    gone = dedup(documents, **options).filter("not kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_seal")).distinct()
    same = documents["doc_id"].cast("long").eqNullSafe(gone["_id"]) & (F.sha2(normalised(documents["text"]), 256) == gone["_seal"])
    return documents.join(gone, same, "left_anti")
