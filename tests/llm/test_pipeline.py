"""The pipeline against what its operators say of each stage's own input."""

import collections

import pytest

import __spark_entry__
import corpus_pipeline
from recordlens.llm import decontaminate, pii, quality, stages as pipeline_stages
from recordlens.llm.common import store
from tests.llm.test_near_copies import groups

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        docs = store(f(spark, docs, FOLDER), name)
        out.append(docs)
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "pii", "mixture_packing",
    ]
    for d in stages[1:-1]:
        assert d.schema.simpleString() == stages[0].schema.simpleString()


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_decisions_take_effect(spark, stages):
    docs, good, single, clean, redacted, packed = stages
    scores = {r["doc_id"]: r["keep"] for r in quality.score_documents(docs).collect()}
    assert ids(good) == {d for d, k in scores.items() if k}
    # Brute force: the exact similarity of all pairs of the stage's input.
    assert ids(single) == set(groups([(r["doc_id"], r["text"]) for r in good.collect()]).values())
    found = decontaminate.find_items(single, spark.read.parquet(f"{FOLDER}/benchmark.parquet"))
    assert ids(clean) == ids(single) - ids(found)
    spans = {r["doc_id"]: r["spans"] for r in pii.find_pii(clean).collect()}
    before = {r["doc_id"]: r["text"] for r in clean.collect()}
    for r in redacted.collect():
        assert r["n_chars"] == len(r["text"]) or r["text"] == before[r["doc_id"]]
        assert (r["text"] == before[r["doc_id"]]) == (not spans[r["doc_id"]])
        assert all(s["value"] not in r["text"] for s in spans[r["doc_id"]])
    tokens = collections.Counter()
    for r in packed.select("doc_id", "length", "doc_tokens").collect():
        tokens[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert {d for d, _ in tokens} == ids(redacted) and all(n == v for (_, n), v in tokens.items())


def test_exact_copies_and_planted_passages_go(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first()["text"]
    base = max(texts, key=len)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(100, base, "en", "s", 0), (101, base.replace("the", "th", 1), "en", "s", 0), (102, texts[3] + " " + item + " end", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = ids(pipeline_stages.near_dedup(spark, docs, FOLDER))
    assert not kept & {100, 101}
    assert 102 not in ids(pipeline_stages.decontamination(spark, docs, FOLDER))


def test_every_operator_has_a_query():
    names = [n for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()


def test_empty_documents(spark):
    empty = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, empty, FOLDER).count() == 0
