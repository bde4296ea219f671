"""Term search over the text fields of several tables."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordlens.functions.ranking import large_groups, places_in_groups, top_per_group
from recordlens.functions.runtime import materialize, percent, spread_small
from recordlens.functions.scalars import clip_text
from recordlens.functions.terms import (
    EXACT_PATTERNS, EXACT_TEXTS, any_occurs, fold, java_pattern, occurs_sql, sql_text, with_folded,
)

Families = Mapping[str, Sequence[str]]

CELL = ("entity_id", "table_name", "field", "row_pos")
SNIPPET = 300
EXAMPLE = 200
DETAIL_LIMIT = 100_000
_MASK_BITS = 32


ONE_RECORD = ""


@dataclass(frozen=True)
class SearchTable:
    """``row_pos`` tells the records of an entity apart and orders them.

    ``ONE_RECORD`` says that no entity has a second one. Without it they are told apart, and put in a fixed but meaningless order, by a hash of the whole record;
    equal records then count as one. Keys that are no whole numbers name no entity, as do null keys.
    """

    name: str
    df: DataFrame
    key: str
    fields: tuple[str, ...]
    row_pos: str | None = None


def text_cells(tables: Sequence[SearchTable]) -> DataFrame:
    """(entity_id, table_name, field, row_pos, text) for every filled text field.

    Configured fields a table lacks are skipped, as are tables left without a field.
    """
    out = None
    for t in tables:
        fields = [f for f in t.fields if f in t.df.columns]
        if not fields:
            continue
        rows = t.df
        # Without a column for it, the record itself tells records apart: a hash of all its columns.
        pos = F.lit(0) if t.row_pos == ONE_RECORD else F.col(t.row_pos) if t.row_pos else F.xxhash64(*t.df.columns)
        ids = [
            F.col(t.key).try_cast("long").alias("entity_id"),
            F.lit(t.name).alias("table_name"),
            pos.cast("long").alias("row_pos"),
        ]
        if len(fields) == 1:
            cells = rows.select(*ids, F.lit(fields[0]).alias("field"), F.col(fields[0]).alias("text"))
        else:
            # An array of the fields, exploded: stays in generated code, unlike unpivot here.
            pairs = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields]
            cells = rows.select(*ids, F.inline(F.array(*pairs)))
        cells = cells.select(*CELL, "text").filter(
            F.col("entity_id").isNotNull() & F.col("text").isNotNull() & (F.col("text") != "")
        )
        cells = spread_small(cells, list(CELL))
        out = cells if out is None else out.unionByName(cells)
    if out is None:
        raise ValueError("no table has a searchable field")
    return out


def search_terms(cells: DataFrame, families: Families) -> DataFrame:
    """One row per cell and term that occurs in it, all families in one scan.

    Whole texts are searched; a hit carries the head of its text only, so that a text with
    many hits is not copied for each of them.
    """
    pairs = [(family, term) for family, terms in families.items() for term in terms]
    folded = with_folded(cells)
    words = [pairs[w : w + _MASK_BITS] for w in range(0, len(pairs), _MASK_BITS)]
    masks = [
        " | ".join(f"if({occurs_sql(term)}, {1 << bit}L, 0L)" for bit, (_, term) in enumerate(word))
        for word in words
    ]
    # One bit per term. A filter on the bits would be pushed below them and compute them
    # twice; a cell without hits has no array element and so gives no row.
    snippet = f"substring(text, 1, {SNIPPET}) AS snippet"
    marked = folded.selectExpr(*CELL, snippet, *[f"{m} AS _m{w}" for w, m in enumerate(masks)])
    arrays = []
    for w, word in enumerate(words):
        terms = ", ".join(
            f"named_struct('family', {sql_text(f)}, 'term', {sql_text(t)})" for f, t in word
        )
        arrays.append(
            f"if(_m{w} = 0, array_repeat(named_struct('family', '', 'term', ''), 0), "
            f"filter(array({terms}), (x, i) -> getbit(_m{w}, i) = 1))"
        )
    return marked.selectExpr(*CELL, "snippet", f"inline(concat({', '.join(arrays)}))")


def record_counts(tables: Sequence[SearchTable]) -> DataFrame:
    """Records per entity and table, whether or not anything was found in them."""
    out = None
    for t in tables:
        one = (
            t.df.groupBy(F.col(t.key).try_cast("long").alias("entity_id"))
            .agg(F.count(F.lit(1)).alias("record_count"))
            .withColumn("table_name", F.lit(t.name))
        )
        out = one if out is None else out.unionByName(one)
    return out


def search_rollup_table(hits: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Per family, entity and table: matches, fields and terms found, a first example.

    The sets are bounded by the number of configured fields and terms.
    """
    first = F.struct("row_pos", "field")
    out = hits.groupBy("family", "entity_id", "table_name").agg(
        F.count(F.lit(1)).alias("total_matches"),
        F.sort_array(F.collect_set("field")).alias("matched_fields"),
        F.sort_array(F.collect_set("term")).alias("terms"),
        F.min_by("snippet", first).alias("example"),
    )
    if counts is not None:
        out = out.join(counts, ["entity_id", "table_name"], "left")
    return out


def hit_records(hits: DataFrame, limit: int = DETAIL_LIMIT) -> DataFrame:
    """(family, entity_id, table_name, field, chunk, chunks, records): every record with a hit, nested per field.

    ``records`` are structs (row_pos, snippet, terms) in the order of ``row_pos``, ``limit`` of them per row;
    a field with more has further chunks. So a result with all its evidence can go to a JSON sink.
    """
    cell = ["family", "entity_id", "table_name", "field"]
    per_record = hits.groupBy(*cell, "row_pos").agg(
        F.min("snippet").alias("snippet"), F.sort_array(F.collect_set("term")).alias("terms")
    )
    place = F.row_number().over(W.partitionBy(*cell).orderBy("row_pos")) - 1
    nested = (
        per_record.withColumn("chunk", F.floor(place / limit).cast("int"))
        .groupBy(*cell, "chunk")
        .agg(F.sort_array(F.collect_list(F.struct("row_pos", "snippet", "terms"))).alias("records"))
    )
    return nested.select(*cell, "chunk", (F.max("chunk").over(W.partitionBy(*cell)) + 1).alias("chunks"), "records")


def search_rollup_entity(per_table: DataFrame) -> DataFrame:
    """Per family and entity: tables, matches and terms, with the per-table details nested.

    The details hold one element per configured table.
    """
    detail = F.struct("table_name", "total_matches", "matched_fields", "terms")
    return per_table.groupBy("family", "entity_id").agg(
        F.sort_array(F.collect_set("table_name")).alias("tables_found"),
        F.sum("total_matches").alias("total_matches"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"),
        F.sort_array(F.collect_list(detail)).alias("details"),
    )


def enrich_from_master(
    results: DataFrame, master: DataFrame, key: str, columns: Sequence[str]
) -> DataFrame:
    """Attach master columns to search results; absent text becomes ''.

    ``master`` has one row per key. The join strategy is left to the optimizer, which
    broadcasts the smaller side when its measured size allows it.
    """
    kept = [c for c in columns if c in master.columns]
    side = master.select(F.col(key).try_cast("long").alias("entity_id"), *kept)
    out = results.join(side, "entity_id", "left")
    return out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in kept})


_SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("pattern", T.StringType()),
            T.StructField("matched_text", T.StringType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
        ]
    )
)


def _spans_udf(patterns: Sequence[str]):
    """Places of all matches. SQL has no function for match offsets."""

    @F.pandas_udf(_SPANS)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled = [(p, re.compile(p, re.IGNORECASE)) for p in patterns]
        for texts in batches:
            yield pd.Series(
                [
                    [(p, m.group(), m.start(), m.end()) for p, rx in compiled for m in rx.finditer(t)]
                    for t in texts
                ],
                index=texts.index,
                dtype=object,
            )

    return spans


# Patterns that mean the same to Java and Python once \w is spelled out: characters, escaped signs, \w, classes of these, and *, + or ? after one.
_SHARED = re.compile(r"(?:(?:[^\\^$.|?*+()\[\]{}]|\\[.\-*+?()\[\]{}|^$]|\\w|\[(?:[^\\^&\[\]]|\\w)+\])[*+?]?)+")
# Matches whose places are added up together before they join those of the groups before; lists of any length cost little.
_PLACES_AT_ONCE = 64


def placed_in_sql(pattern: str) -> str | None:
    """The pattern for SQL functions if they find the same matches as Python's, none otherwise."""
    if _SHARED.fullmatch(pattern) is None or re.compile(pattern).match("") is not None:
        return None
    # A word character is a letter, a number or an underscore to Python; Java counts marks and leaves out fractions.
    inside, out = False, ""
    for part in re.findall(r"\\.|.", pattern, re.DOTALL):
        inside = part == "[" or inside and part != "]"
        out += (r"\p{L}\p{N}_" if inside else r"[\p{L}\p{N}_]") if part == r"\w" else part
    return java_pattern(out)


def _spans_sql(z: str) -> str:
    """Places of matches from ``z``, an array of (m: a match, b: the text before it since the last one), as running sums of lengths."""
    end = "s.at + length(e.b) + length(e.m)"
    spans = "array_repeat(named_struct('matched_text', '', 'start', 0, 'end', 0), 0)"
    group = (
        f"aggregate(slice({z}, g * {_PLACES_AT_ONCE} + 1, {_PLACES_AT_ONCE}), named_struct('at', a.at, 'out', {spans}), (s, e) -> named_struct("
        f"'at', {end}, 'out', array_append(s.out, named_struct('matched_text', e.m, 'start', s.at + length(e.b), 'end', {end}))))"
    )
    return (
        f"flatten(aggregate(sequence(0, (size({z}) - 1) div {_PLACES_AT_ONCE}), named_struct('at', 0, 'out', array_repeat({spans}, 0)), (a, g) -> "
        f"aggregate(array({group}), a, (x, y) -> named_struct('at', y.at, 'out', array_append(x.out, y.out)))).out)"
    )


def search_occurrences(cells: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """One row per match of every pattern: its text and place.

    Places come from the matches and the texts between them, in generated SQL functions. Only patterns that Java reads otherwise,
    such as look-around, word boundaries and patterns that match nothing, go to a Python worker, and only texts that they match.
    """
    ours = {p: sql for p in patterns if (sql := placed_in_sql(p)) is not None}
    others = [p for p in patterns if p not in ours]
    folded = with_folded(cells).withColumn("snippet", clip_text(F.col("text"), SNIPPET))
    parts = []
    if ours:
        gates = {p: test if (test := occurs_sql(p)).startswith("(") else f"rlike(text, {sql_text(sql)})" for p, sql in ours.items()}
        found = ", ".join(
            f"if({gates[p]}, named_struct('pattern', {sql_text(p)}, 'z', filter(transform(arrays_zip("
            f"regexp_extract_all(text, {sql_text(sql)}, 0), split(text, {sql_text(sql)}, -1)), "
            "e -> named_struct('m', e.`0`, 'b', e.`1`)), x -> x.m IS NOT NULL)), null)"
            for p, sql in ours.items()
        )
        # One row per text and pattern, so that its matches are found once.
        per_pattern = folded.filter(" OR ".join(gates.values())).selectExpr(*CELL, "snippet", f"inline(filter(array({found}), x -> x IS NOT NULL))")
        named = per_pattern.filter("size(z) > 0").selectExpr(*CELL, "snippet", "pattern", "z")
        parts.append(named.selectExpr(*CELL, "snippet", "pattern", f"inline({_spans_sql('z')})"))
    if others:
        parts.append(
            folded.filter(any_occurs(others))
            .select(*CELL, "snippet", _spans_udf(others)(F.col("text")).alias("_spans"))
            .select(*CELL, "snippet", F.inline("_spans"))
        )
    if not parts:
        raise ValueError("no patterns")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def occurrence_rollup(occurrences: DataFrame) -> DataFrame:
    """Matches, patterns and distinct matched texts per entity."""
    return occurrences.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("total_matches"),
        F.count_distinct("pattern").alias("patterns"),
        F.count_distinct("matched_text").alias("matched_texts"),
    )


def _family_flags(cells: DataFrame, families: Families) -> DataFrame:
    """Cells with one boolean per family."""
    folded = with_folded(cells)
    return folded.withColumns({f"in_{name}": any_occurs(p) for name, p in families.items()})


def compare_families(cells: DataFrame, families: Families, base: str) -> DataFrame:
    """One row: cells checked, entities per family, entities the base family misses, gain."""
    others = [f for f in families if f != base]
    flags = _family_flags(cells, families)
    # Only cells with a hit need their entity; all others become one row per task before the shuffle.
    hit = F.lit(False)
    for f in families:
        hit = hit | F.col(f"in_{f}")
    per_entity = flags.groupBy(F.when(hit, F.col("entity_id")).alias("entity_id")).agg(
        F.count(F.lit(1)).alias("cells"),
        *[F.bool_or(f"in_{f}").alias(f"in_{f}") for f in families],
    )
    by_base = F.col(f"in_{base}")
    missed = F.lit(False)
    union = by_base
    for f in others:
        missed = missed | (F.col(f"in_{f}") & ~by_base)
        union = union | F.col(f"in_{f}")
    one = per_entity.agg(
        F.sum("cells").alias("cells_checked"),
        *[F.count_if(f"in_{f}").alias(f"{f}_entities") for f in families],
        *[F.count_if(F.col(f"in_{f}") & ~by_base).alias(f"missed_by_{f}") for f in others],
        F.count_if(missed).alias("missed_total"),
        F.count_if(union).alias("potential_total"),
    )
    return one.withColumn(
        "gain_pct",
        F.coalesce(percent(F.col("missed_total"), F.col(f"{base}_entities")), F.lit(0.0)),
    )


def compare_counts(df: DataFrame, old: str, new: str) -> DataFrame:
    """Absolute, percent and ratio gain of one count over another."""
    gain = F.col(new) - F.col(old)
    return df.withColumns(
        {
            "gain_absolute": gain,
            "gain_percent": F.coalesce(percent(gain, F.col(old)), F.lit(0.0)),
            "gain_ratio": F.when(F.col(old) != 0, F.col(new).cast("double") / F.col(old)),
        }
    )


def family_frequencies(hits: DataFrame) -> DataFrame:
    """Cells hit per family, table and pattern, with totals per family over each."""
    return (
        hits.groupBy("family", "table_name", "term")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupingSets(
            [["family", "table_name"], ["family", "term"], ["family"]], "family", "table_name", "term"
        )
        .agg(F.sum("_n").alias("hits"))
    )


def missed_examples(
    hits: DataFrame, base: str, entities: int = 10, per_entity: int = 3
) -> DataFrame:
    """Examples of entities that only the other families find: first ids, first hits."""
    by_base = hits.filter(F.col("family") == base).select("entity_id").distinct()
    missed = hits.filter(F.col("family") != base).join(by_base, "entity_id", "left_anti")
    chosen = top_per_group(
        missed.select("family", "entity_id").distinct(), ["family"], ["entity_id"], entities
    )
    # At most ``entities`` ids per family.
    shown = missed.join(F.broadcast(chosen), ["family", "entity_id"], "left_semi")
    first = top_per_group(
        shown, ["family", "entity_id"], ["table_name", "row_pos", "field", "term"], per_entity, "n"
    )
    return first.select(
        "family", "entity_id", "n", "table_name", "field", "term",
        clip_text(F.col("snippet"), EXAMPLE).alias("text"),
    )


def _exact_hits(pattern: str) -> Column:
    """Matches of a strict pattern whose text is one of the exact forms."""
    found = F.regexp_extract_all("text", F.lit(java_pattern(pattern)), 0)
    return F.filter(found, lambda x: F.upper(x).isin(*EXACT_TEXTS))


def strict_cells(cells: DataFrame) -> DataFrame:
    """Cells some strict pattern matches; the substring test spares the others the patterns."""
    folded = fold(F.col("text"))
    candidate = F.lit(False)
    for t in EXACT_TEXTS:
        candidate = candidate | folded.contains(t.lower())
    any_match = F.lit(False)
    for p in EXACT_PATTERNS:
        any_match = any_match | F.col("text").rlike(java_pattern(p))
    return cells.filter(candidate).filter(any_match)


def strict_matches(cells: DataFrame) -> DataFrame:
    """One row per match and strict pattern.

    An occurrence that two patterns match gives two rows, which is how matches are counted.
    """
    arrays = F.flatten(
        F.array(
            *[
                F.transform(_exact_hits(p), _numbered(i)) for i, p in enumerate(EXACT_PATTERNS)
            ]
        )
    )
    return strict_cells(cells).select(
        *CELL, F.posexplode(arrays).alias("hit_no", "_hit")
    ).select(*CELL, "hit_no", "_hit.*")


def _numbered(pattern_no: int):
    return lambda x: F.struct(F.lit(pattern_no).alias("pattern_no"), x.alias("matched_text"))


def strict_match_counts(cells: DataFrame) -> DataFrame:
    """Matches per strict pattern, and matches that no earlier pattern already gave.

    The second count takes, per cell, the largest count of any pattern over the same script.
    """
    sizes = {f"n{i}": F.size(_exact_hits(p)) for i, p in enumerate(EXACT_PATTERNS)}
    counted = strict_cells(cells).select("entity_id", "table_name", *[c.alias(n) for n, c in sizes.items()])
    return counted.groupBy("table_name").agg(
        *[F.sum(n).alias(f"pattern_{i}") for i, n in enumerate(sizes)],
        F.sum(F.greatest("n0", "n2") + F.greatest("n1", "n3")).alias("distinct_places"),
    )


def strict_entities(cells: DataFrame) -> DataFrame:
    """Entities with a strict match, and per table the records with one."""
    return (
        strict_cells(cells)
        .groupBy("entity_id", "table_name")
        .agg(F.count_distinct("row_pos").alias("records"))
    )


def strict_table_summary(entities: DataFrame) -> DataFrame:
    return entities.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("entities"), F.sum("records").alias("records")
    )


def match_detail(
    matches: DataFrame, table_order: Sequence[str], limit: int = DETAIL_LIMIT
) -> DataFrame:
    """(entity_id, chunk, chunks, match_detail, match_count): ``table.field: text`` strings joined by ' | '.

    ``limit`` matches per row, in order of table, record, field and place; an entity with more has
    further chunks, which go on where the one before ends. Such entities' matches are spread by place.
    """
    rank = F.array_position(F.array(*[F.lit(t) for t in table_order]), F.col("table_name"))
    line = F.concat(F.col("table_name"), F.lit("."), F.col("field"), F.lit(": "), F.col("matched_text"))
    # Found once, as they are counted first.
    rows = materialize(matches.select("entity_id", rank.alias("_table"), "row_pos", "field", "hit_no", "matched_text", line.alias("_line")))
    hot = materialize(large_groups(rows, ["entity_id"], limit))
    spread = not hot.isEmpty()
    placed = places_in_groups(
        rows, ["entity_id"], ["_table", "row_pos", "field", "hit_no", "matched_text"], hot if spread else None, "_place"
    )
    ordered = F.sort_array(F.collect_list(F.struct("_place", "_line")))
    chunks = (
        placed.withColumn("chunk", F.floor(F.col("_place") / limit).cast("int"))
        .groupBy("entity_id", "chunk")
        .agg(
            F.array_join(F.transform(ordered, lambda x: x["_line"]), " | ").alias("match_detail"),
            F.count(F.lit(1)).alias("match_count"),
        )
    )
    total = F.coalesce("rows", "match_count") if spread else F.col("match_count")
    return (chunks.join(hot, "entity_id", "left") if spread else chunks).select(
        "entity_id", "chunk", F.ceil(total / limit).cast("int").alias("chunks"), "match_detail", "match_count"
    )


def family_summary(per_entity: DataFrame, total_entities: Column) -> DataFrame:
    """Entities per family and their share of all entities."""
    return (
        per_entity.groupBy("family")
        .agg(F.count_distinct("entity_id").alias("entities"))
        .withColumn("pct", percent(F.col("entities"), total_entities))
    )


def family_by_group(enriched: DataFrame, group: str, k: int = 20) -> DataFrame:
    """The ``k`` groups with most entities, per family."""
    counts = enriched.groupBy("family", group).agg(F.count_distinct("entity_id").alias("entities"))
    return top_per_group(counts, ["family"], [F.desc("entities"), F.col(group)], k, "rank")


def term_frequency(hits: DataFrame, k: int = 30) -> DataFrame:
    """The ``k`` terms found in most entities, per family."""
    counts = hits.groupBy("family", "term").agg(F.count_distinct("entity_id").alias("entities"))
    return top_per_group(counts, ["family"], [F.desc("entities"), F.col("term")], k, "rank")


def table_distribution(hits: DataFrame) -> DataFrame:
    return hits.groupBy("family", "table_name").agg(
        F.count_distinct("entity_id").alias("entities")
    )


def matched_text_frequency(occurrences: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` matched texts found in most entities."""
    counts = occurrences.groupBy("matched_text").agg(F.count_distinct("entity_id").alias("entities"))
    return counts.orderBy(F.desc("entities"), "matched_text").limit(k)
