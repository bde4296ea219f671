import numpy as np
import pyarrow as pa

from recordlens.llm.common import block_of
from recordlens.llm import language
from recordlens.llm.language import address, declared_language, grams, identify_pages, train

WORDS = {
    "en": "the of and with from that what this have", "fr": "le les des que avec pour dans être une",
    "de": "der die und mit nicht auch für eine schön", "es": "el los que con para una como señor año",
}


def page(lang, n, text=None, url="http://a.example.com/x"):
    rng = np.random.default_rng(n)
    words = " ".join(rng.choice(WORDS[text or lang].split(), 30)) if text != "" else ""
    attr = f' lang="{lang}"' if lang else ""
    return (n, url, f"<html{attr}><body><article><p>{words}</p></article></body></html>", "x")


def docs(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(WORDS[x].split(), 60)), x) for i in range(80) for x in WORDS]
    rows += [(999, None, "en"), (998, "text", None), (997, "", "fr")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_parts():
    assert address("https://u@News.Example.co.uk:80/fr-ca/x?y#z") == ("news.example.co.uk", "example.co.uk", "uk", "fr")
    assert address("http://10.0.0.1/x") == ("10.0.0.1", "10.0.0.1", None, None)
    assert address(None) == address("mailto:x") == address("") == (None,) * 4
    assert declared_language("<html class=a lang=DE-at>") == "de" and declared_language(None) is None
    assert declared_language('<html><meta http-equiv="content-language" content="fr">') == "fr"
    counts = grams(block_of(pa.array(["ab", "", "ABC", None])))
    assert counts.sum(axis=1).tolist() == [1, 0, 3, 0] and (counts[0] <= counts[2]).all()


def test_text_wins_over_a_wrong_declaration_and_priors_decide_the_rest(spark):
    rows = [page(x, i * 4 + j, url=f"http://{x}{i % 3}.example.{x}/{x}/p") for i in range(30) for j, x in enumerate(WORDS)]
    rows.append(page("en", 500, text="fr"))
    rows.append(page("de", 501, text="", url="http://de0.example.de/other"))  # no text: markup, suffix and host
    rows.append((502, "http://fr1.example.fr/z", None, "x"))  # host only
    rows.append((None, None, None, "x"))
    rows.append((502, "http://fr1.example.fr/z", "", "x"))
    cols = "page_id long, url string, html string, lang string"
    got = identify_pages(spark.createDataFrame(rows, cols), docs(spark)).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    for i in range(30):
        for j, x in enumerate(WORDS):
            assert by[i * 4 + j]["lang"] == x
    assert by[500]["lang"] == "fr" and by[500]["declared"] == "en"
    assert by[501]["lang"] == "de" and by[501]["text_lang"] is None
    assert by[502]["lang"] == "fr" and by[None]["lang"] in WORDS
    assert all(abs(sum(r["posterior"].values()) - 1) < 1e-5 for r in got)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert identify_pages(none, docs(spark)).count() == 0
    assert identify_pages(spark.createDataFrame([page("en", 1)], "page_id long, url string, html string, lang string"), docs(spark).limit(0)).count() == 0


def test_held_out_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    languages, log = train(d.filter("doc_id % 2 = 0"))
    rest = d.filter("doc_id % 2 = 1").collect()
    from recordlens.llm.language import text_posteriors

    best = text_posteriors(pa.array([r["text"] for r in rest]), log).argmax(axis=1)
    assert np.mean([languages[b] == r["lang"] for b, r in zip(best, rest)]) > 0.97


def test_fusion_equals_a_plain_computation(spark):
    rng = np.random.default_rng(8)
    rows = []
    for n in range(90):
        x = list(WORDS)[n % 4]
        host = ["a.x.fr", "b.x.fr", "y.fr", "z.com", "w.z.com", None][n % 6]
        url = None if host is None else f"http://{host}/" + ("fr/p" if n % 5 == 0 else "")
        text = "" if n % 7 == 0 else None
        declared = x if n % 3 else None if n % 2 else "de"
        rows.append((n, url, page(declared, n, text=x if text is None else "")[2]))
    rows += [(200, None, None), (201, "http://new.host.xyz/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    languages, log = train(docs(spark))
    seen = {r["page_id"]: r for r in language.evidence(pages, log).collect()}
    k, S = len(languages), language.SMOOTHING

    def softmax(v):
        e = np.exp(np.array(v) - max(v))
        return e / e.sum()

    said = {i: softmax(r["text"]) * (r["letters"] > 0) for i, r in seen.items()}
    every = sum(said.values()) + S
    for r in identify_pages(pages, docs(spark)).collect():
        i, own = r["page_id"], seen[r["page_id"]]
        score = np.log(softmax(own["text"])) * (own["letters"] > 0)
        for c in ("declared", "path"):
            if own[c] is not None:
                showing = [j for j in seen if seen[j][c] is not None]
                same = sum((said[j] for j in showing if seen[j][c] == own[c] and j != i), np.zeros(k))
                others = sum((said[j] for j in showing if j != i), np.zeros(k))
                score = score + np.log((same + S) / (others + S * len({seen[j][c] for j in showing})))
        prior = every / every.sum()
        for level in ("label", "domain", "host"):
            same = sum((said[j] for j in seen if own[level] is not None and seen[j][level] == own[level] and j != i), np.zeros(k))
            prior = (same + language.PRIOR_PAGES * prior) / (same.sum() + language.PRIOR_PAGES)
        want = softmax(score + np.log(prior))
        assert np.allclose([r["posterior"][x] for x in languages], want, atol=2e-6), i


def test_the_suffix_counts_once(spark):
    """6 French and 4 English pages under .fr among many English ones: a page without text gets about the share of .fr."""
    rows = [page("", n, text="fr" if n < 6 else "en", url=f"http://h{n}.s{n}.fr/") for n in range(10)]
    rows += [page("", 100 + n, text="en", url=f"http://h{n}.s{n}.com/") for n in range(30)]
    rows = [(i, u, h) for i, u, h, _ in rows] + [(999, "http://new.one.fr/", "")]
    got = {r["page_id"]: r for r in identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), docs(spark)).collect()}
    assert 0.35 < got[999]["posterior"]["fr"] < 0.65


def test_a_very_long_page(spark):
    long = "le les des que avec pour dans " * 120_000
    got = identify_pages(spark.createDataFrame([(1, "http://x.fr/", f"<p>{long}</p>")], "page_id long, url string, html string"), docs(spark)).first()
    assert got["lang"] == "fr" and got["probability"] > 0.9
