"""Language of web pages by fusing evidence: text, declared markup language, address, and host.

* Text: naive Bayes over hashed byte n-grams, counted over all documents of known language.
* Markup: what pages declare (the ``lang`` attribute, or a meta element), as P(declared | language).
* Address: the language sign in the url (first short part of the path), as P(sign | language), and the suffix (last label of the
  host) as the widest level of the host's prior.
* Host: P(language | host), drawn towards its domain, that towards its suffix, and that towards all pages.

The last three are grouped aggregations of the text posteriors of all pages. A page's own posterior is taken out of all
sums that it meets, so its text is not counted twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.llm.common import BASE, Block, block_of, mix, store, text_slices
from recordlens.llm.html_text import main_text

FEATURES = 4_096
# Languages a model may have.
MOST_LANGUAGES = 200
# n-grams of a text count as at most so many independent ones.
EFFECTIVE = 60.0
# Pages that the level above stands for, and what is added to each count of a channel.
PRIOR_PAGES = 5.0
SMOOTHING = 0.5

LANG_ATTRIBUTE = re.compile(r"<html\b[^>]*?\s(?:xml:)?lang\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", re.IGNORECASE)
META = re.compile(r"<meta\b(?=[^>]*(?:content-language|og:locale))[^>]*?content\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", re.IGNORECASE)
URL = re.compile(r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^?#]*)", re.IGNORECASE)
PATH_SIGN = re.compile(r"^/([a-z]{2})(?:[-_][a-z]{2})?(?:/|$)", re.IGNORECASE)


def grams(block: Block, size: int = FEATURES) -> np.ndarray:
    """A row per text: counts of hashed byte pairs and triples; upper case ASCII counts as lower."""
    n = len(block.starts) - 1
    data = block.data.astype(np.uint64)
    data = np.where((data >= 65) & (data < 91), data + np.uint64(32), data)
    owner = np.repeat(np.arange(n), block.sizes())
    out = np.zeros(n * size, np.int64)
    for k in (2, 3):
        if len(data) < k:
            continue
        value = np.full(len(data) - k + 1, k, np.uint64)
        for j in range(k):
            value = (value << np.uint64(8)) | data[j : len(data) - k + 1 + j]
        same = owner[k - 1 :] == owner[: len(owner) - k + 1]
        slot = (mix(value * np.uint64(BASE)) % np.uint64(size)).astype(np.int64)
        out += np.bincount(owner[: len(slot)][same] * size + slot[same], minlength=n * size)
    return out.reshape(n, size)


def train(documents: DataFrame, size: int = FEATURES) -> tuple[list[str], np.ndarray]:
    """(languages, log P(n-gram | language)) from all ``documents`` (text, lang) whose language is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in text_slices(batch):
                coded = part.column("lang").dictionary_encode()
                names = coded.dictionary.to_pylist()
                which = np.asarray(coded.indices)
                counts = grams(block_of(part.column("text")), size)
                for i, name in enumerate(names):
                    total[name] = total.get(name, 0) + counts[which == i].sum(axis=0)
        for name, row in total.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(row[at])], names=["lang", "gram", "n"]
            )

    known = documents.select(F.col("text").cast("string"), F.lower(F.trim(F.col("lang").cast("string"))).alias("lang"))
    known = known.filter("lang is not null and lang <> '' and text is not null and text <> ''")
    counted = (
        known.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    # A table of FEATURES rows for each of a bounded number of languages.
    rows = counted.limit(size * MOST_LANGUAGES + 1).collect()
    languages = sorted({r["lang"] for r in rows})
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    number = {x: i for i, x in enumerate(languages)}
    total = np.full((len(languages), size), SMOOTHING)
    for r in rows:
        total[number[r["lang"]], r["gram"]] += r["n"]
    return languages, np.log(total / total.sum(axis=1, keepdims=True)) if languages else total


def text_posteriors(texts: pa.Array, log: np.ndarray) -> np.ndarray:
    """log P(text | language), up to a constant, from an effective number of n-grams."""
    counts = grams(block_of(texts), log.shape[1])
    n = counts.sum(axis=1, keepdims=True)
    return np.where(n > 0, counts @ log.T * (np.minimum(n, EFFECTIVE) / np.maximum(n, 1)), 0.0)


def address(url: str | None) -> tuple[str | None, str | None, str | None, str | None]:
    """(host, domain, last label, sign in the path) of a url, each null if it has none."""
    m = URL.match(url or "")
    if not m:
        return None, None, None, None
    host = m[1].lower().strip(".")
    if not host:
        return None, None, None, None
    labels = host.split(".")
    named = not labels[-1].isdigit()
    # Names under a public second level, such as co.uk, keep three labels.
    keep = 3 if len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in ("co", "com", "ac", "gov", "org", "net", "edu") else 2
    path = PATH_SIGN.match(m[2] or "")
    return host, ".".join(labels[-keep:]) if named else host, labels[-1] if named else None, path[1].lower() if path else None


def declared_language(html: str | None) -> str | None:
    head = html or ""
    m = LANG_ATTRIBUTE.search(head) or META.search(head)
    return m[1].lower() if m else None


def evidence(pages: DataFrame, log: np.ndarray) -> DataFrame:
    """Per page its host, signs, and what its text says (``text``: log-likelihoods by language)."""
    schema = (
        "page_id long, host string, domain string, label string, path string, declared string, text array<double>, letters long"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "html"):
                html = part.column("html").to_pylist()
                texts = [main_text(h) for h in html]
                found = [address(u) for u in part.column("url").to_pylist()]
                likely = text_posteriors(pa.array(texts, pa.string()), log)
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), *[pa.array([f[k] for f in found], pa.string()) for k in range(4)],
                     pa.array([declared_language(h) for h in html], pa.string()), pa.array(likely.tolist(), pa.list_(pa.float64())),
                     pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "host", "domain", "label", "path", "declared", "text", "letters"],
                )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, schema)


def _softmax(column: str, k: int):
    """The posterior of log-likelihoods, as k columns p0.. that add up to 1."""
    most = F.array_max(column)
    parts = [F.exp(F.col(column)[i] - most) for i in range(k)]
    total = sum(parts[1:], parts[0])
    return {f"p{i}": parts[i] / total for i in range(k)}


# Evidence beside the text that each language shows in its own measure, and the levels of the prior from wide to narrow.
CHANNELS = ("declared", "path")
LEVELS = ("label", "domain", "host")


def identify_pages(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """(page_id, lang, probability, text_lang, declared, host, posterior) of every row of ``pages`` (page_id, url, html).

    Languages are those of ``documents`` (text, lang); of equally likely ones the first by name. ``posterior`` has the
    probability of each, by name. Null or empty pages are judged by address and host, and if these are missing too, by how
    common the languages are; ``text_lang`` is then null. Rows that repeat a page_id, or have none, each keep their row; other
    columns are left out. Without any document of known language, and for an empty table, there are no rows.
    """
    spark = pages.sparkSession
    languages, log = train(documents)
    k = len(languages)
    out_schema = (
        "page_id long, lang string, probability double, text_lang string, declared string, host string, posterior map<string,double>"
    )
    if not k:
        return spark.createDataFrame([], out_schema)
    seen = store(evidence(pages, log), "evidence").withColumns(_softmax("text", k))
    seen = seen.withColumn("heard", (F.col("letters") > 0).cast("double"))
    p = [f"p{i}" for i in range(k)]
    said = [(F.col(c) * F.col("heard")).alias(c) for c in p]

    def sums(by: str) -> DataFrame:
        return seen.filter(F.col(by).isNotNull()).select(by, *said).groupBy(by).agg(*[F.sum(c).alias(f"{by}_{c}") for c in p])

    total = seen.agg(*[F.coalesce(F.sum(F.col(c) * F.col("heard")), F.lit(0.0)).alias(c) for c in p]).first()
    every = np.array([total[c] for c in p]) + SMOOTHING
    base = every / every.sum()

    # P(value | language) of a channel: per value the share of each language's other pages that show it, smoothed. The last label of
    # the host is a level of the prior and no channel, so it counts once.
    own = {c: F.coalesce(F.col(c) * F.col("heard"), F.lit(0.0)) for c in p}
    out = seen
    for channel in CHANNELS:
        per = sums(channel)
        values = per.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(f"{channel}_{c}"), F.lit(0.0)).alias(c) for c in p]).first()
        out = out.join(per, channel, "left")
        shown = F.col(channel).isNotNull()
        for i, c in enumerate(p):
            others = F.greatest(F.coalesce(F.col(f"{channel}_{c}"), F.lit(0.0)) - own[c], F.lit(0.0))
            every_other = F.greatest(F.lit(float(values[c])) - own[c], F.lit(0.0))
            ratio = F.log((others + F.lit(SMOOTHING)) / (every_other + F.lit(SMOOTHING * max(values["n"], 1))))
            out = out.withColumn(f"{channel}_l{i}", F.when(shown, ratio).otherwise(F.lit(0.0)))
    for level in LEVELS:
        out = out.join(sums(level), level, "left")

    # From all pages to the host, each level's counts without the page's own.
    prior = [F.lit(float(b)) for b in base]
    for level in LEVELS:
        others = [F.greatest(F.coalesce(F.col(f"{level}_{c}"), F.lit(0.0)) - own[c], F.lit(0.0)) for c in p]
        n = sum(others[1:], others[0])
        names = [f"{level}_q{i}" for i in range(k)]
        out = out.withColumns({a: (o + F.lit(PRIOR_PAGES) * q) / (n + F.lit(PRIOR_PAGES)) for a, o, q in zip(names, others, prior, strict=True)})
        prior = [F.col(a) for a in names]

    def channel_log(i: int):
        return sum((F.col(f"{c}_l{i}") for c in CHANNELS[1:]), F.col(f"{CHANNELS[0]}_l{i}"))

    fused = F.array(*[F.col("text")[i] * F.col("heard") + channel_log(i) + F.log(prior[i]) for i in range(k)])
    out = out.withColumn("fused", fused).withColumns({f"f{i}": c for i, c in enumerate(_softmax("fused", k).values())})
    names = F.array(*[F.lit(x) for x in languages])
    final = F.array(*[F.round(F.col(f"f{i}"), 6) for i in range(k)])
    return out.withColumn("final", final).select(
        "page_id",
        F.element_at(names, F.array_position("final", F.array_max("final")).cast("int")).alias("lang"),
        F.array_max("final").alias("probability"),
        F.when(F.col("letters") > 0, F.element_at(names, F.array_position("text", F.array_max("text")).cast("int"))).alias("text_lang"),
        "declared", "host", F.map_from_arrays(names, "final").alias("posterior"),
    )
