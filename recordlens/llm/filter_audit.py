"""What filters do to a corpus in every order, from sorted lists of the documents that fail them.

1. Every document's failures are decided in the JVM. Equal texts are told by their SHA-256 value, whole table at once.
2. Posting lists: by part and range of ids, the sorted ids that fail each filter, and those with a label of interest. A range
   holds a bounded number of documents, so a hot part has many ranges, and its lists are never in one task.
3. Each range's lists are merged: unions of every set of filters, and what each further filter adds to them. Sorted lists are
   merged by galloping: a stable merge sort of sorted runs skips ahead in doubling steps, and look-ups of
   ascending ids each start where the one before ended.
4. Only sizes leave a range. Their sums over the ranges give every order of the filters by look-up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlens.llm.common import join_counted, keyed, shuffle_partitions, store

# Documents of a range.
RANGE_IDS = 65_536
POSTING_SCHEMA = "part string, task int, range int, list string, n long, ids binary"
SIZE_SCHEMA = "part string, filter string, earlier int, n long, good long, toxic long"
ALL, GOOD, TOXIC = "all", "good", "toxic"


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """Failures that one text shows: A few words, B repeated words, C capitals, D signs of markup or code."""
    count = F.size(words)
    return {
        "A": count < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * count,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def split_words(text: Column) -> Column:
    """The maximal stretches without ASCII white space."""
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def flagged(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, key, A, B, C, D, E, good, toxic) of every row; E: an equal text has a smaller doc_id."""
    text = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("words", split_words(F.col("text")))
    # Sealed and decided in one scan; only narrow columns are stored.
    rows = store(
        text.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("seal"), *[c.alias(k) for k, c in text_filters(F.col("text"), F.col("words")).items()]),
        "audit-rows",
    )
    copies = rows.groupBy("seal").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    rows = join_counted(rows, store(copies, "audit-copies"), ["seal"], "copies")
    rows = rows.withColumn("E", F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False))).drop("seal", "least", "copies")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    columns = ("part", "A", "B", "C", "D", "E", "good", "toxic")
    found = rows.join(known, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    return keyed(store(found.select("doc_id", *columns), "audit-flags"), columns).withColumnRenamed("_key", "key").drop("doc_id")


def posting_lists(flags: DataFrame, filters: Sequence[str], range_ids: int = RANGE_IDS) -> DataFrame:
    """(part, task, range, list, n, ids) from (part, key, a boolean column per filter, good, toxic); stored.

    ``ids`` are the sorted keys of a list as 64-bit integers: those that fail a filter, those that are ``good`` or ``toxic``. The
    list ``all`` has a number and no ids. A range is told by (part, task, range); ranges of a part have disjoint ids.
    """
    lists = [*filters, GOOD, TOXIC]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        part, held = None, []

        def ended() -> Iterator[pa.RecordBatch]:
            nonlocal number, held
            if held:
                table = pa.Table.from_batches(held)
                keys = np.asarray(table["key"])
                ids = [keys[np.asarray(table[c])].astype("<i8") for c in lists]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * (len(lists) + 1), pa.string()), pa.array([task] * (len(lists) + 1), pa.int32()),
                     pa.array([number] * (len(lists) + 1), pa.int32()), pa.array([ALL, *lists]),
                     pa.array([len(keys), *map(len, ids)], pa.int64()), pa.array([b"", *(x.tobytes() for x in ids)], pa.binary())],
                    names=["part", "task", "range", "list", "n", "ids"],
                )
                number, held = number + 1, []

        for batch in batches:
            names = batch.column("part").dictionary_encode()
            codes = np.asarray(names.indices)
            edges = np.flatnonzero(np.diff(codes)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(codes)], strict=True):
                if lo == hi:
                    continue
                own = names.dictionary[int(codes[lo])].as_py()
                while lo < hi:
                    if own != part or sum(b.num_rows for b in held) >= range_ids:
                        yield from ended()
                        part = own
                    stop = min(hi, lo + range_ids - sum(b.num_rows for b in held))
                    held.append(batch.slice(lo, stop - lo))
                    lo = stop
        yield from ended()

    order = ["part", "key"]
    placed = flags.select(*order, *lists).repartitionByRange(shuffle_partitions(flags.sparkSession), *order).sortWithinPartitions(*order)
    return store(placed.mapInArrow(run, POSTING_SCHEMA), "postings")


def union(lists: Sequence[np.ndarray]) -> np.ndarray:
    """Sorted ids that are in any of the sorted lists, each once."""
    merged = np.sort(np.concatenate(lists), kind="stable")
    return merged[np.concatenate([[True], merged[1:] != merged[:-1]])] if len(merged) else merged


def within_list(ids: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each of the sorted ``ids`` is in the sorted ``other``."""
    if not len(other):
        return np.zeros(len(ids), bool)
    at = np.searchsorted(other, ids)
    return other[np.minimum(at, len(other) - 1)] == ids


def merge_sizes(postings: DataFrame, filters: Sequence[str]) -> DataFrame:
    """(part, filter, earlier, n, good, toxic): what a filter removes of a part after a set of others, summed over all ranges.

    ``earlier`` has bit i for ``filters[i]``. Filter ``all`` counts the documents. A group is one range, so it is bounded.
    """
    filters = list(filters)

    def run(table: pa.Table) -> pa.Table:
        lists = {k: np.frombuffer(ids, "<i8") for k, ids in zip(table["list"].to_pylist(), table["ids"].to_pylist(), strict=True)}
        total = dict(zip(table["list"].to_pylist(), table["n"].to_pylist(), strict=True))
        part = table["part"][0].as_py()
        rows = [(part, ALL, 0, total[ALL], total[GOOD], total[TOXIC])]
        unions = {0: np.zeros(0, np.int64)}
        for i in range(1, 1 << len(filters)):
            rest = i & (i - 1)
            unions[i] = union([unions[rest], lists[filters[(i ^ rest).bit_length() - 1]]])
        for k, name in enumerate(filters):
            for earlier, gone in unions.items():
                if not earlier >> k & 1:
                    removed = lists[name][~within_list(lists[name], gone)]
                    good, toxic = (int(within_list(removed, lists[x]).sum()) for x in (GOOD, TOXIC))
                    rows.append((part, name, earlier, len(removed), good, toxic))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 3), strict=True)],
                        names=["part", "filter", "earlier", "n", "good", "toxic"])

    sizes = postings.groupBy("part", "task", "range").applyInArrow(run, SIZE_SCHEMA)
    return sizes.groupBy("part", "filter", "earlier").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def orders(sizes: DataFrame, filters: Sequence[str]) -> DataFrame:
    """A row per part, order of the filters and step, from :func:`merge_sizes`; see :func:`audit_filters`."""
    filters = list(filters)
    m = len(filters)
    everything = (1 << m) - 1
    steps = [
        ("".join(p), s + 1, p[s], sum(1 << filters.index(x) for x in p[:s])) for p in permutations(filters) for s in range(m)
    ]
    spark = sizes.sparkSession
    table = spark.createDataFrame(steps, "filter_order string, step int, filter string, earlier int")  # m! * m rows, whatever the data
    sizes = store(sizes, "audit-sizes")
    own = sizes.filter(F.col("filter") != ALL)
    bit = F.element_at(F.create_map(*[F.lit(v) for i, f in enumerate(filters) for v in (f, 1 << i)]), F.col("filter"))
    # In how many orders exactly the set comes before the filter.
    before = F.bit_count("earlier")
    ways = F.element_at(F.array(*[F.lit(math.factorial(s) * math.factorial(m - 1 - s)) for s in range(m)]), before + 1)
    of_filter = own.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("earlier") == 0, F.col("n"))).alias("failing"),
        F.sum(F.when(F.col("earlier").bitwiseOR(bit) == everything, F.col("n"))).alias("unique_fails"),
        F.sum(F.col("n") * ways).alias("shapley"),
    )
    total = sizes.filter(F.col("filter") == ALL).select("part", F.col("n").alias("total"))
    # What filters 1..s leave: all less what each of them removed in its turn.
    placed = own.join(F.broadcast(table), ["filter", "earlier"])
    gone = placed.groupBy("part", "filter_order").agg(F.array_sort(F.collect_list(F.struct("step", "n"))).alias("turns"))
    return (
        placed.join(of_filter, ["part", "filter"]).join(total, "part").join(gone, ["part", "filter_order"])
        .select(
            "part", "filter_order", "step",
            (F.col("total") - F.aggregate(F.slice("turns", F.lit(1), F.col("step")), F.lit(0).cast("long"), lambda s, t: s + t["n"])).alias("kept"),
            F.col("n").alias("removed"), (F.col("failing") - F.col("n")).alias("redundant"), "unique_fails",
            F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley",
        )
    )


def audit(flags: DataFrame, filters: Sequence[str], range_ids: int = RANGE_IDS) -> DataFrame:
    """The audit of any filters: ``flags`` has part, a unique ``key``, a boolean column per filter that says it fails, good and toxic."""
    return orders(merge_sizes(posting_lists(flags, filters, range_ids), filters), filters)


def audit_filters(documents: DataFrame, labels: DataFrame, range_ids: int = RANGE_IDS) -> DataFrame:
    """A row per part (``source``), order of the filters A-E and step, counting documents of that part.

    ``kept`` after the step; ``removed`` by it; ``redundant``: fail its filter, but were removed before; ``unique_fails``: fail that
    filter only; ``good_lost`` and ``toxic_lost``: removed with a label quality = 1 or toxic = 1; ``shapley``: removed by the
    filter, summed over all orders. Null texts are empty, null sources the part ''. A null doc_id counts as its own
    document without labels; it is no smaller than any other. Repeated doc_ids are documents of their own, and none of them is
    smaller than the other. Of several labels of a document any one counts. Other columns are left out; without documents there are no rows.
    """
    return audit(flagged(documents, labels), "ABCDE", range_ids)
