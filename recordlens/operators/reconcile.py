"""Reconciling a list of official names with the names of entities."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlens.functions.ranking import top_per_group
from recordlens.functions.runtime import materialize, percent

# Accepted similarity, and the similarity of a name contained in the other.
THRESHOLD = 0.7
CONTAINED = 0.9

# Names without a partner, and candidates, that one task compares at a time.
BLOCK_NAMES, PART_NAMES = 256, 8_192

BEST = "official_name string, candidate_id long, candidate_name string, similarity double"


def similarity(official: str, candidate: str, floor: float = 0.0) -> float:
    """Ratcliff/Obershelp ratio, at least 0.9 if one name contains the other.

    Returns 0 when the result cannot exceed ``floor``, which spares most pairs the
    expensive part.
    """
    if not official or not candidate:
        return 0.0
    if official in candidate or candidate in official:
        return max(CONTAINED, SequenceMatcher(None, official, candidate).ratio())
    m = SequenceMatcher(None, official, candidate)
    if m.real_quick_ratio() <= floor or m.quick_ratio() <= floor:
        return 0.0
    return m.ratio()


def distinct_names(df: DataFrame, name: str, id_col: str | None = None) -> DataFrame:
    """(name, copies) or (name, id) with the smallest id; blank names are left out."""
    rows = df.select(F.trim(F.col(name)).alias("name"), *([F.col(id_col).alias("id")] if id_col else []))
    rows = rows.filter(F.col("name") != "")
    if id_col:
        return rows.groupBy("name").agg(F.min("id").cast("long").alias("id"))
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("copies"))


def exact_name_match(officials: DataFrame, candidates: DataFrame) -> DataFrame:
    """(official_name, candidate_id) for equal names; both sides are unique by name."""
    return (
        officials.select("name")
        .join(candidates, "name")
        .select(F.col("name").alias("official_name"), F.col("id").alias("candidate_id"))
    )


def fuzzy_best_match(
    officials: DataFrame, candidates: DataFrame, threshold: float = THRESHOLD, best_below: bool = True
) -> DataFrame:
    """The most similar candidate of every official name; smallest id on ties.

    ``officials`` (name) and ``candidates`` (name, id) are unique by name; both are stored once.
    Pairs from ``threshold`` on are found by blocking, whatever the length of the lists. With
    ``best_below``, names without such a partner get their best one by a top-1 join with all candidates (:func:`_best_of_all`);
    otherwise theirs is null.
    """
    names, others = materialize(officials.select("name")), materialize(candidates.select("name", "id"))
    best = _scored_blocks(names, others, threshold)
    if best_below:
        best = materialize(best)
        rest = materialize(names.join(best.select(F.col("official_name").alias("name")), "name", "left_anti"))
        best = best.unionByName(_best_of_all(rest, others))
    return names.select(F.col("name").alias("official_name")).join(best, "official_name", "left")


def best_match_per_name(pairs: DataFrame) -> DataFrame:
    """Of every official name's pairs the most similar one, the smallest candidate id on ties."""
    order = F.struct(F.col("similarity").alias("s"), (-F.col("candidate_id")).alias("i"))
    return (
        pairs.groupBy("official_name")
        .agg(F.max_by(F.struct("candidate_id", "candidate_name", "similarity"), order).alias("b"))
        .select("official_name", "b.*")
    )


def _pieces(n: int, most: int) -> int:
    return max(-(-n // most), 1)


def _best_of_all(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """The best candidate of each of ``names`` (name) among all ``candidates``: a top-1 join in blocks.

    Every block of names meets every part of the candidates in a group of bounded size. A name's candidates are taken by
    falling bound, twice the shared characters over the total length, until no bound reaches the best similarity
    so far; so few pairs are compared in full. The best per part becomes the best of all in one aggregate.
    """
    blocks, parts = _pieces(names.count(), BLOCK_NAMES), _pieces(candidates.count(), PART_NAMES)
    left = names.select("name", F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int").alias("block"))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = candidates.select("name", "id", F.pmod(F.xxhash64("name"), F.lit(parts)).cast("int").alias("part"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["block", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_best_in_part, BEST)
    return best_match_per_name(found)


def _characters(names: list[str], known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(alphabet, copies): how often each name has each character; characters beyond ``known`` are left out."""
    codes = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(names)), [len(x) for x in names])
    alphabet = np.unique(codes) if known is None else known
    at = np.minimum(np.searchsorted(alphabet, codes), max(len(alphabet) - 1, 0))
    ours = alphabet[at] == codes if len(alphabet) else np.zeros(len(codes), bool)
    copies = np.zeros((len(alphabet), len(names)), np.uint16)
    np.add.at(copies, (at[ours], owner[ours]), 1)
    return alphabet, copies


def _best_in_part(left: pa.Table, right: pa.Table) -> pa.Table:
    rows: list[tuple[str, int, str, float]] = []
    officials, others, ids = left["name"].to_pylist(), right["name"].to_pylist(), right["id"].to_pylist()
    if officials and others:
        alphabet, wanted = _characters(officials)
        _, copies = _characters(others, alphabet)
        lengths = np.array([len(x) for x in others], np.int64)
        for i, official in enumerate(officials):
            shared = np.zeros(len(others), np.int64)
            for c in np.flatnonzero(wanted[:, i]).tolist():
                shared += np.minimum(copies[c], wanted[c, i])
            bound = 2.0 * shared / (lengths + len(official))
            # A name within the other counts as CONTAINED at least.
            bound = np.where(shared == np.minimum(lengths, len(official)), np.maximum(bound, CONTAINED), bound)
            best: tuple[float, int, int] | None = None
            first = int(bound.argmax())
            if (s := similarity(official, others[first])) > 0:
                best = (s, ids[first], first)
            worth = np.flatnonzero(bound >= best[0] - 1e-9 if best else bound > 0)
            for k in worth[np.argsort(-bound[worth], kind="stable")].tolist():
                if best and bound[k] < best[0] - 1e-9:
                    break
                # A hair below the held value, so that an equal one is still computed.
                s = similarity(official, others[k], best[0] - 1e-9 if best else 0.0)
                if s > 0 and (best is None or (-s, ids[k]) < (-best[0], best[1])):
                    best = (s, ids[k], k)
            if best:
                rows.append((official, best[1], others[best[2]], best[0]))
    columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], [], []]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.float64()), strict=True)],
                    names=["official_name", "candidate_id", "candidate_name", "similarity"])


def shared_characters(a: Column, b: Column) -> Column:
    """Characters two names have in common, each as often as in the name that has fewer."""
    def copies(text: Column, ch: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, ch, F.lit("")))

    return F.aggregate(
        F.filter(F.array_distinct(F.split(a, "")), lambda ch: ch != ""), F.lit(0),
        lambda n, ch: n + F.least(copies(a, ch), copies(b, ch)),
    )


def scored_pairs(officials: DataFrame, candidates: DataFrame, threshold: float) -> DataFrame:
    """The blocked pairs that can reach ``threshold``: by shared characters, or as one holds the other."""
    a, b = F.col("official_name"), F.col("candidate_name")
    bound = 2.0 * shared_characters(a, b) / (F.length(a) + F.length(b))
    return candidate_pairs(officials, candidates, threshold).filter(
        (bound >= threshold - 1e-9) | a.contains(b) | b.contains(a)
    )


def _scored_blocks(officials: DataFrame, candidates: DataFrame, threshold: float) -> DataFrame:
    pairs = scored_pairs(officials, candidates, threshold)

    @F.pandas_udf("double")
    def score(official: pd.Series, candidate: pd.Series) -> pd.Series:
        floor = threshold - 1e-9
        return pd.Series(
            [similarity(a, b, floor) for a, b in zip(official, candidate)], dtype="float64"
        )

    scored = pairs.select(
        "official_name", "candidate_id", "candidate_name",
        score("official_name", "candidate_name").alias("similarity"),
    )
    return best_match_per_name(scored.filter(F.col("similarity") >= threshold))


def candidate_pairs(officials: DataFrame, candidates: DataFrame, threshold: float) -> DataFrame:
    """A superset of all pairs with a similarity of at least ``threshold``.

    The ratio cannot exceed twice the shared characters over the total length. So two
    similar names share a character among the rarest of each (prefix filter), and their
    lengths differ by a limited factor. Containment has its own rule: the container holds
    the rarest gram of the contained name.
    """
    a = officials.select(F.col("name").alias("official_name"))
    b = candidates.select(F.col("name").alias("candidate_name"), F.col("id").alias("candidate_id"))
    similar = _prefix_pairs(a, b, threshold)
    inside = _containment_pairs(a, "official_name", b, "candidate_name")
    around = _containment_pairs(b, "candidate_name", a, "official_name")
    columns = ["official_name", "candidate_name", "candidate_id"]
    return (
        similar.select(*columns)
        .unionByName(inside.select(*columns))
        .unionByName(around.select(*columns))
        .distinct()
    )


def _char_tokens(df: DataFrame, name: str) -> DataFrame:
    """One row per name and character token: the k-th copy of a character is its own token."""
    chars = df.select(*df.columns, F.explode(F.split(F.col(name), "")).alias("_ch")).filter(
        F.col("_ch") != ""
    )
    counted = chars.groupBy(*df.columns, "_ch").agg(F.count(F.lit(1)).alias("_m"))
    copies = F.transform(
        F.sequence(F.lit(1).cast("long"), F.col("_m")), lambda k: F.concat_ws(" ", "_ch", k.cast("string"))
    )
    return counted.select(*df.columns, F.explode(copies).alias("token"))


def _prefix_pairs(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    ratio = threshold / (2 - threshold)

    def prefix(df: DataFrame, name: str, freq: DataFrame) -> DataFrame:
        tokens = _char_tokens(df, name).join(freq, "token", "left")
        ranked = top_per_group(tokens, [name], ["freq", "token"], 1 << 30, "_r")
        n = F.length(name)
        kept = n - F.ceil(n * F.lit(ratio) - F.lit(1e-9)) + 1
        return ranked.filter(F.col("_r") <= kept).select(
            *df.columns, "token", F.floor(F.log(n) / F.log(F.lit(1 / ratio))).alias("_len")
        )

    all_tokens = _char_tokens(a, "official_name").select("token").unionByName(
        _char_tokens(b, "candidate_name").select("token")
    )
    freq = all_tokens.groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
    left = prefix(a, "official_name", freq).withColumn(
        "_len", F.explode(F.array(F.col("_len") - 1, F.col("_len"), F.col("_len") + 1))
    )
    right = prefix(b, "candidate_name", freq)
    la, lb = F.length("official_name"), F.length("candidate_name")
    return left.join(right, ["token", "_len"]).filter(
        (la >= lb * ratio - 1e-9) & (lb >= la * ratio - 1e-9)
    )


def _grams(name: Column, q: int) -> Column:
    n = F.length(name)
    places = F.when(n >= q, F.sequence(F.lit(1), n - q + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(name, i, F.lit(q))))


def _containment_pairs(inner: DataFrame, inner_name: str, outer: DataFrame, outer_name: str) -> DataFrame:
    """Pairs in which ``outer_name`` contains ``inner_name``."""
    outer_grams = outer.select(
        *outer.columns,
        F.explode(F.concat(*[_grams(F.col(outer_name), q) for q in (1, 2, 3)])).alias("gram"),
    )
    freq = outer_grams.groupBy("gram").agg(F.count(F.lit(1)).alias("freq"))
    q = F.least(F.length(inner_name), F.lit(3))
    own = (
        F.when(q == 1, _grams(F.col(inner_name), 1))
        .when(q == 2, _grams(F.col(inner_name), 2))
        .otherwise(_grams(F.col(inner_name), 3))
    )
    inner_grams = inner.select(*inner.columns, F.explode(own).alias("gram"))
    # A gram no outer name has cannot be contained in one.
    known = inner_grams.join(freq, "gram", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    rarest = top_per_group(known, [inner_name], ["freq", "gram"])
    return rarest.drop("freq").join(outer_grams, "gram").filter(
        F.col(outer_name).contains(F.col(inner_name))
    )


def membership_flags(df: DataFrame, id_col: str, sources: dict[str, DataFrame]) -> DataFrame:
    """A boolean per source: whether its ids hold the row's id; a null id is in none.

    Rows without an id stay out of the joins, where they would all meet in one task.
    """
    out = df.filter(F.col(id_col).isNotNull())
    for flag, ids in sources.items():
        marked = ids.select(F.col(ids.columns[0]).alias(id_col)).distinct().withColumn(flag, F.lit(True))
        out = out.join(marked, id_col, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    none = df.filter(F.col(id_col).isNull()).withColumns({flag: F.lit(False) for flag in sources})
    return out.select(*df.columns, *sources).unionByName(none)


def reconcile_names(
    officials: DataFrame, candidates: DataFrame, sources: dict[str, DataFrame],
    threshold: float = THRESHOLD, best_below: bool = True,
) -> DataFrame:
    """Every official name once: exact, fuzzy or none, with id, name, similarity and flags.

    ``officials`` (name, copies); a name without partner keeps its best candidate (see
    :func:`fuzzy_best_match` for ``best_below``) and has no id. Its flags are false.
    """
    exact = exact_name_match(officials, candidates).select(
        "official_name", "candidate_id",
        F.col("official_name").alias("candidate_name"),
        F.lit(1.0).alias("similarity"),
        F.lit("exact").alias("match_type"),
    )
    rest = officials.join(candidates.select("name"), "name", "left_anti")
    near = F.coalesce(F.col("similarity") >= threshold, F.lit(False))
    fuzzy = fuzzy_best_match(rest, candidates, threshold, best_below).select(
        "official_name",
        F.when(near, F.col("candidate_id")).alias("candidate_id"),
        "candidate_name",
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
        F.when(near, "fuzzy").otherwise("none").alias("match_type"),
    )
    found = membership_flags(exact.unionByName(fuzzy), "candidate_id", sources)
    copies = officials.select(F.col("name").alias("official_name"), "copies")
    return found.join(copies, "official_name")


def reconcile_stats(result: DataFrame, flags: list[str]) -> DataFrame:
    """One row: names per match type, rates in percent, matched names per source."""
    kind = F.col("match_type")
    matched = kind != "none"
    return result.agg(
        F.count(F.lit(1)).alias("official_names"),
        F.count_if(kind == "exact").alias("exact"),
        F.count_if(kind == "fuzzy").alias("fuzzy"),
        F.count_if(kind == "none").alias("unmatched"),
        percent(F.count_if(kind == "exact"), F.count(F.lit(1))).alias("exact_rate"),
        percent(F.count_if(matched), F.count(F.lit(1))).alias("total_rate"),
        *[F.count_if(matched & F.col(f)).alias(f) for f in flags],
    )


def merge_name_sources(first: DataFrame, second: DataFrame) -> DataFrame:
    """(id, name) of two sources; the second wins. Both are unique by id."""
    a = first.select("id", F.col("name").alias("_a"))
    b = second.select("id", F.col("name").alias("_b"))
    return a.join(b, "id", "full").select("id", F.coalesce("_b", "_a").alias("name"))
