"""The operators applied to their whole tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlens.llm import (
    decontaminate, exact_dedup, filter_audit, fingerprint, hard_negatives, html_text, language, packing, pii, quality, simhash, stages, suffix_dedup, token_files,
)
from recordlens.llm.tokens import tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str):
    def register(f):
        QUERIES[name] = f
        return f

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query("op9_simhash_near_dedup")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


@query("op1_suffix_array_dedup")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.dedup_substrings(table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op3_token_files")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = token_files.round_trip(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)
    return found.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


@query("op7_mixture_packing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    found = packing.pack_documents(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=1)
    return found.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "queue"
    )


@query("op5_benchmark_decontamination")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def joined_spans(spans: str) -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


@query("op8_pii")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_pii(table(spark, folder, "documents")).withColumn("_base", F.filter("spans", lambda s: s["base"]))
    def of_kind(kind: str) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")

    counts = {f"n_{k}": of_kind(k) for k in pii.KINDS}
    return found.select(
        "doc_id", *[c.alias(n) for n, c in counts.items()],
        F.sha2(joined_spans("_base"), 256).alias("base_sha256"), joined_spans("spans").alias("spans"),
        (F.size("spans") - F.size("_base")).cast("long").alias("n_added"),
    )


@query("op2_document_fingerprints")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    found = fingerprint.fingerprint_documents(table(spark, folder, "documents"))
    return found.withColumnRenamed("edited_text_sha256", "edited_sha256")


@query("op4_language_id")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = language.identify_pages(table(spark, folder, "pages"), table(spark, folder, "documents"))
    return found.drop("posterior")


@query("op6_html_extraction")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_pages(table(spark, folder, "pages"))


@query("op10_quality_classifier")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_documents(table(spark, folder, "documents"))


@query("op11_hard_negative_mining")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    id_, label = F.col("vec_id"), F.col("label")
    rows = table(spark, folder, "embeddings").withColumn("label", F.when(id_ % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


ORACLES["op11_hard_negative_mining"] = """
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scores AS (
    SELECT a.vec_id AS anchor_id, a.label AS own, r.vec_id AS vec_id, r.label AS label,
        CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * r.v[i])) AS BIGINT) AS score
    FROM rows a JOIN rows r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), positives AS (
    SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM scores WHERE label = own
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
    s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND s.label <> p.own
    AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""


@query("op12_exact_dedup")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, folder, "documents"))


ORACLES["op12_exact_dedup"] = """
WITH n AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
    doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""


@query("op13_filter_interaction_audit")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, folder, "documents"), table(spark, folder, "labels"))


ORACLES["op13_filter_interaction_audit"] = """
WITH texts AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
        list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
    FROM documents
), flags AS (
    SELECT part, [
            len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
            100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t), regexp_matches(t, '[#$%&*|]'),
            min(doc_id) OVER (PARTITION BY t) < doc_id
        ] AS fails, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
    FROM texts LEFT JOIN labels USING (doc_id)
), orders AS (
    SELECT a || b || c || d || e AS filter_order, [a, b, c, d, e] AS letters
    FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS a), (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS b),
        (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c), (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS d),
        (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS e)
    WHERE len(list_distinct([a, b, c, d, e])) = 5
), patterns AS (
    SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM flags GROUP BY part, fails
), turns AS (
    SELECT part, filter_order, letters, fails, n, good, toxic,
        list_position(list_transform(letters, lambda x: fails[ascii(x) - 64]), true) AS gone
    FROM patterns, orders
), counted AS (
    SELECT part, filter_order, step, letters[step] AS letter,
        CAST(sum(CASE WHEN coalesce(gone, 9) > step THEN n ELSE 0 END) AS BIGINT) AS kept,
        CAST(sum(CASE WHEN gone = step THEN n ELSE 0 END) AS BIGINT) AS removed,
        CAST(sum(CASE WHEN fails[ascii(letters[step]) - 64] AND gone < step THEN n ELSE 0 END) AS BIGINT) AS redundant,
        CAST(sum(CASE WHEN gone = step AND len(list_filter(fails, lambda x: x)) = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
        CAST(sum(CASE WHEN gone = step THEN good ELSE 0 END) AS BIGINT) AS good_lost,
        CAST(sum(CASE WHEN gone = step THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
    FROM turns, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)
    GROUP BY part, filter_order, letters, step
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM counted
"""


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return stages.run(spark, folder)


if stages.ORACLE_SQL is not None:
    ORACLES["pipeline"] = stages.ORACLE_SQL
