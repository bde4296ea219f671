"""Quality of documents by a weak-label model and a hashed linear scorer.

1. Heuristic labellers look at every whole document and vote to keep it, to reject it, or not at all.
2. Votes are counted by pattern over all documents, of which there are at most 3 to the number of labellers.
   Expectation-maximisation on these counts estimates how often each labeller votes how for good and for bad documents,
   and so the probability that a document with a pattern is bad.
3. On a bounded sample, these probabilities train a linear scorer over hashed features.
4. The scorer decides about every document.

This is done for two traits, each with its own labellers, model and scorer: poor writing, and abuse of people. A document
goes if either scorer rejects it; well written abuse has nothing in common with junk, so one model can't see both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.llm.common import BASE, Block, RangeHash, block_of, freed, mix, plain_words, space_words, text_slices

# Documents that train the scorer, at most.
TRAINED_ON = 8_192
FEATURES = 2_048
STEPS = 200

# ---------------------------------------------------------------------------------------------
# Classes of bytes, and function words of the languages at hand.
PLAIN_MARKS = b".,;:'\"!?-()"
FUNCTION_WORDS = (
    "the of and to in a is that for on with as at by it was are be or an from der die und das in den von zu mit sich des auf "
    "für ist im dem nicht ein eine als auch es an la le de les et des en un une du que qui dans pour est sur pas el los las "
    "y del se por con una su al lo como"
)
# Insults, by what they are, and words that wish people harm.
INSULTING_NOUNS = (
    "idiot idiots moron morons imbecile imbeciles cretin cretins scum scumbag scumbags loser losers clown clowns fool fools trash "
    "garbage vermin parasite parasites pig pigs rat rats coward cowards dumbass jackass asshole assholes bastard bastards bitch "
    "bitches freak freaks filth halfwit dimwit nitwit dunce simpleton lowlife degenerate degenerates subhuman "
    "idioten dummkopf trottel abschaum versager arschloch schwachkopf "
    "idiote idiots crétin abruti connard connasse salaud imbécile ordure "
    "idiota idiotas imbécil escoria cabrón gilipollas basura"
)
INSULTING_ADJECTIVES = (
    "stupid worthless pathetic disgusting dumb idiotic moronic brainless useless filthy vile despicable contemptible repulsive "
    "revolting loathsome disgraceful ugly braindead spineless wretched "
    "dumm wertlos erbärmlich widerlich ekelhaft "
    "stupide minable dégoûtant pathétique "
    "estúpido estúpida patético asqueroso"
)
HARMFUL_WISHES = "hate hates kill die hang rot drown burn suffer exterminate hasse verrecke stirb crève hais muere odio"
SYMBOL, UPPER, LOWER, DIGIT, SPACE, MARK = range(6)
KIND = np.full(256, SYMBOL, np.uint8)
KIND[128:] = LOWER
KIND[[9, 10, 11, 12, 13, 32]] = SPACE
KIND[np.frombuffer(PLAIN_MARKS, np.uint8)] = MARK
KIND[48:58], KIND[65:91], KIND[97:123] = DIGIT, UPPER, LOWER
# Letters, digits and bytes beyond ASCII become one sign each; marks and symbols stay what they are.
SHAPE = np.arange(256, dtype=np.uint64)
SHAPE[65:91], SHAPE[97:123], SHAPE[48:58], SHAPE[128:] = 65, 97, 48, 97
SMALL = np.arange(256, dtype=np.uint8)
SMALL[65:91] += 32

# Measures, and per measure: number of what it needs, reject if beyond, keep if within (in order low to high).
MEASURES = ("symbols", "capitals", "bars", "repeats", "distinct", "cries", "word_length", "function_words", "lines")


@dataclass(frozen=True)
class Labeller:
    """Votes on one measure: reject from ``reject`` on, keep up to ``keep``; ``needs`` is the least number of words or lines."""

    measure: str
    reject: float
    keep: float
    needs: int = 0
    falling: bool = False

    def vote(self, value: np.ndarray, size: np.ndarray) -> np.ndarray:
        """2 reject, 1 keep, 0 no vote."""
        sign = -1 if self.falling else 1
        out = np.where(sign * value >= sign * self.reject, 2, np.where(sign * value <= sign * self.keep, 1, 0))
        return np.where(size >= self.needs, out, 0)


LABELLERS = (
    Labeller("symbols", 0.05, 0.02, 5),  # share of bytes that are neither letters, digits, space nor plain marks
    Labeller("capitals", 0.5, 0.2, 5),  # share of letters
    Labeller("bars", 0.2, 0.0, 5),  # per word
    Labeller("repeats", 0.3, 0.1, 10),  # share of words equal to the one before
    Labeller("distinct", 0.3, 0.45, 50, falling=True),  # distinct words per word
    Labeller("cries", 0.5, 0.1, 5),  # exclamation marks per word
    Labeller("word_length", 7.0, 6.0, 20),  # mean bytes
    Labeller("function_words", 0.02, 0.08, 50, falling=True),  # share of words
    Labeller("lines", 0.5, 0.9, 4, falling=True),  # distinct lines per line
)
# One insult alone may be a quotation, so its labeller is silent; that of the share hears it in short texts only.
ABUSE_MEASURES = ("nouns", "adjectives", "insults", "insult_share", "wishes")
ABUSE_LABELLERS = (
    Labeller("nouns", 2, 0),  # distinct insulting nouns
    Labeller("adjectives", 2, 0),  # distinct insulting adjectives
    Labeller("insults", 3, 0),  # all of them, with repeats
    Labeller("insult_share", 0.01, 0.0005, 5),  # share of words
    Labeller("wishes", 3, 0),  # harmful wishes in texts that also insult
)


def _word_hashes(words: str) -> np.ndarray:
    raw = [w.encode() for w in dict.fromkeys(words.split())]
    block = Block(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in raw])]))
    return np.sort(RangeHash(block.data).of(block.starts[:-1], block.starts[1:]))


_FUNCTION = _word_hashes(FUNCTION_WORDS)


def _distinct(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, owner))
    o, x = owner[order], h[order]
    new = np.concatenate([[True], (o[1:] != o[:-1]) | (x[1:] != x[:-1])]) if len(o) else np.zeros(0, bool)
    return np.bincount(o[new], minlength=n)


def measures(block: Block) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Every measure by document, the numbers of words, and of lines."""
    n = len(block.starts) - 1
    owner = np.repeat(np.arange(n), block.sizes())
    kinds = np.bincount(owner * 6 + KIND[block.data], minlength=6 * n).reshape(n, 6)
    bars = np.bincount(owner[block.data == 124], minlength=n)
    cries = np.bincount(owner[block.data == 33], minlength=n)
    hashes = RangeHash(block.data)
    starts, ends = space_words(block)
    doc = np.searchsorted(block.starts, starts, side="right") - 1
    h = hashes.of(starts, ends)
    words = np.bincount(doc, minlength=n)
    again = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1])) + 1
    known = _FUNCTION[np.minimum(np.searchsorted(_FUNCTION, h), len(_FUNCTION) - 1)] == h
    # Lines, without empty ones.
    feed = block.data == 10
    edge = np.concatenate([np.flatnonzero(feed), block.starts[1:]])
    first = np.concatenate([np.flatnonzero(feed) + 1, block.starts[:-1]])
    first, edge = np.sort(first), np.sort(edge)
    filled = edge > first
    first, edge = first[filled], edge[filled]
    line_of = np.searchsorted(block.starts, first, side="right") - 1
    lines = np.bincount(line_of, minlength=n)
    w, letters = np.maximum(words, 1), np.maximum(kinds[:, UPPER] + kinds[:, LOWER], 1)
    return {
        "symbols": kinds[:, SYMBOL] / np.maximum(block.sizes(), 1),
        "capitals": kinds[:, UPPER] / letters,
        "bars": bars / w,
        "repeats": np.bincount(doc[again], minlength=n) / w,
        "distinct": _distinct(doc, h, n) / w,
        "cries": cries / w,
        "word_length": np.bincount(doc, weights=ends - starts, minlength=n) / w,
        "function_words": np.bincount(doc[known], minlength=n) / w,
        "lines": _distinct(line_of, hashes.of(first, edge), n) / np.maximum(lines, 1),
    }, words, lines


_NOUNS, _ADJECTIVES, _WISHES = _word_hashes(INSULTING_NOUNS), _word_hashes(INSULTING_ADJECTIVES), _word_hashes(HARMFUL_WISHES)


def _listed(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _small_words(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every word of letters and digits, A-Z in lower case."""
    small = Block(SMALL[block.data], block.starts)
    starts, ends = plain_words(small)
    return np.searchsorted(small.starts, starts, side="right") - 1, RangeHash(small.data).of(starts, ends)


def _abuse(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    noun, adjective, wish = (_listed(h, known) for known in (_NOUNS, _ADJECTIVES, _WISHES))
    words = np.bincount(doc, minlength=n)
    insults = np.bincount(doc[noun | adjective], minlength=n)
    return {
        "nouns": _distinct(doc[noun], h[noun], n),
        "adjectives": _distinct(doc[adjective], h[adjective], n),
        "insults": insults,
        "insult_share": insults / np.maximum(words, 1),
        "wishes": np.where(insults > 0, np.bincount(doc[wish], minlength=n), 0),
    }, words


def abuse_measures(block: Block) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Every measure of abuse by document, and the numbers of words twice, in the form of :func:`measures`."""
    found, words = _abuse(*_small_words(block), len(block.starts) - 1)
    return found, words, words


def abuse_features(block: Block, size: int = FEATURES) -> np.ndarray:
    """A row per document: logarithmic counts of hashed words, scaled, and of its measures of abuse in steps."""
    n = len(block.starts) - 1
    doc, h = _small_words(block)
    slot = (mix(h * np.uint64(BASE)) % np.uint64(size)).astype(np.int64)
    counts = np.bincount(doc * size + slot, minlength=n * size).reshape(n, size)
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    out = np.log1p(counts * (100.0 / total)).astype(np.float32)
    found, _ = _abuse(doc, h, n)
    row = np.arange(n)
    for k, name in enumerate(ABUSE_MEASURES):
        step = np.minimum(np.ceil(found[name] * (200 if name == "insult_share" else 1)), 4).astype(np.uint64)
        place = mix((step + np.uint64(1000 * (k + 101))) * np.uint64(BASE)) % np.uint64(size)
        out[row, place.astype(np.int64)] += 3.0
    return out


def votes(block: Block, labellers: tuple[Labeller, ...] = LABELLERS, measure: Callable = measures) -> np.ndarray:
    """The pattern of every document's votes, base 3, the first labeller in the lowest place."""
    found, words, lines = measure(block)
    out = np.zeros(len(words), np.int64)
    for k, lab in enumerate(labellers):
        out += lab.vote(found[lab.measure], lines if lab.measure == "lines" else words) * 3**k
    return out


def features(block: Block, size: int = FEATURES) -> np.ndarray:
    """A row per document: logarithmic counts of hashed three-byte shapes, scaled, and of its measures in steps."""
    n = len(block.starts) - 1
    owner = np.repeat(np.arange(n), block.sizes())
    shape = SHAPE[block.data]
    out = np.zeros((n, size), np.float32)
    if len(shape) > 2:
        tri = (shape[:-2] << np.uint64(16)) | (shape[1:-1] << np.uint64(8)) | shape[2:]
        inside = owner[2:] == owner[:-2]
        slot = (mix(tri * np.uint64(BASE)) % np.uint64(size)).astype(np.int64)
        counts = np.bincount(owner[2:][inside] * size + slot[inside], minlength=n * size).reshape(n, size)
        total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
        out = np.log1p(counts * (1000.0 / total)).astype(np.float32)
    found, words, _ = measures(block)
    row = np.arange(n)
    for k, name in enumerate(MEASURES):
        step = np.minimum(found[name] * (2 if name == "word_length" else 20), 40).astype(np.uint64)
        slot = mix((step + np.uint64(1000 * (k + 1))) * np.uint64(BASE)) % np.uint64(size)
        out[row, slot.astype(np.int64)] += 3.0
    return out


@dataclass(frozen=True)
class Trait:
    """What makes a document go: the labellers that vote on it, their measures, and the scorer's features."""

    labellers: tuple[Labeller, ...]
    measure: Callable[[Block], tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]]
    features: Callable[[Block, int], np.ndarray]

    def votes(self, block: Block) -> np.ndarray:
        return votes(block, self.labellers, self.measure)


POOR = Trait(LABELLERS, measures, features)
ABUSIVE = Trait(ABUSE_LABELLERS, abuse_measures, abuse_features)


# ---------------------------------------------------------------------------------------------


@dataclass
class WeakModel:
    """P(bad), and per labeller P(vote | good or bad); votes 0 none, 1 keep, 2 reject."""

    bad: float
    given: np.ndarray  # labeller, class (0 good, 1 bad), vote

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(bad) by pattern; labellers that don't vote say nothing."""
        log = np.tile(np.log([1 - self.bad, self.bad]), (len(patterns), 1))
        for k in range(len(self.given)):
            v = patterns // 3**k % 3
            seen = v > 0
            # What a vote says, given that there is one.
            p = self.given[k, :, 1:] / self.given[k, :, 1:].sum(axis=1, keepdims=True)
            log[seen] += np.log(p[:, v[seen] - 1]).T
        odds = log[:, 1] - log[:, 0]
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    def accuracies(self) -> np.ndarray:
        """Per labeller the share of its votes that are right."""
        good, bad = self.given[:, 0] * (1 - self.bad), self.given[:, 1] * self.bad
        return (good[:, 1] + bad[:, 2]) / (good[:, 1:].sum(axis=1) + bad[:, 1:].sum(axis=1))


def fit_weak_labels(patterns: np.ndarray, counts: np.ndarray, labellers: int, rounds: int = 200) -> WeakModel:
    """Expectation-maximisation over counted patterns. It starts from each reject being right with 0.7, apart from the others."""
    v = patterns[:, None] // 3 ** np.arange(labellers)[None, :] % 3
    q = 1 - 0.3 ** (v == 2).sum(axis=1)
    total = max(counts.sum(), 1)
    model = WeakModel(0.5, np.full((labellers, 2, 3), 1 / 3))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - q), counts * q])
        given = np.empty((labellers, 2, 3))
        for k in range(labellers):
            for c in range(2):
                given[k, c] = np.bincount(v[:, k], weights=weight[c], minlength=3) + 1.0
        given /= given.sum(axis=2, keepdims=True)
        model = WeakModel(float(np.clip(weight[1].sum() / total, 1e-6, 0.5)), given)
        now = model.posterior(patterns)
        if np.abs(now - q).max(initial=0) < 1e-9:
            break
        q = now
    return model


def fit_scorer(x: np.ndarray, target: np.ndarray, steps: int = STEPS, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic scorer, the last one the constant; accelerated gradient steps on all rows."""
    if not len(x):
        return np.zeros(x.shape[1] + 1)
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    rate = 4.0 / (float((x.astype(np.float64) ** 2).sum(axis=1).mean()) + decay)
    w = np.zeros(x.shape[1])
    ahead = w
    for i in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead.astype(np.float32), -30, 30)))
        slope = x.T @ (p - target).astype(np.float32) / len(x) + decay * ahead
        new = ahead - rate * slope
        ahead = new + (i / (i + 3)) * (new - w)
        w = new
    return w


def _sampled(patterns: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows by the least hash of id and text, the same in every run."""
    n = max(patterns.count(), 1)
    share = min(1.0, 1.2 * most / n)  # few beyond the bound are sorted
    near = patterns if share >= 1 else patterns.filter(F.shiftrightunsigned("pick", 32) <= int(share * (1 << 32)) + (1 << 16))
    return near.orderBy("pick", "doc_id").limit(most)


def fit(documents: DataFrame, most: int = TRAINED_ON, size: int = FEATURES, trait: Trait = POOR) -> tuple[WeakModel, np.ndarray]:
    """The weak-label model of a trait over all ``documents`` (doc_id, text), and the scorer's weights from at most ``most`` of them."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                yield pa.RecordBatch.from_arrays([pa.array(trait.votes(block_of(part.column("text"))))], names=["pattern"])

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    # At most 3 ** labellers rows come to the driver.
    counted = rows.select("text").mapInArrow(vote, "pattern long").groupBy("pattern").count().collect()
    patterns = np.array(sorted(r["pattern"] for r in counted), np.int64)
    by = {r["pattern"]: r["count"] for r in counted}
    model = fit_weak_labels(patterns, np.array([by[p] for p in patterns.tolist()], np.float64), len(trait.labellers))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                block = block_of(part.column("text"))
                x = trait.features(block, size)
                for i, p in enumerate(trait.votes(block).tolist()):
                    at = np.flatnonzero(x[i])
                    yield pa.RecordBatch.from_arrays(
                        [part.column("pick").slice(i, 1), pa.array([p]), pa.array([at.astype(np.int32).tobytes()], pa.binary()),
                         pa.array([x[i, at].tobytes()], pa.binary())],
                        names=["pick", "pattern", "at", "value"],
                    )

    picked = _sampled(rows.withColumn("pick", F.xxhash64("doc_id", "text")), most)
    sample = picked.select("pick", "text").mapInArrow(describe, "pick long, pattern long, at binary, value binary").collect()
    sample.sort(key=lambda r: (r["pick"], r["pattern"]))
    x = np.zeros((len(sample), size), np.float32)
    for i, r in enumerate(sample):
        x[i, np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["value"], np.float32)
    return model, fit_scorer(x, model.posterior(np.array([r["pattern"] for r in sample], np.int64)))


def _score(block: Block, trait: Trait, model: WeakModel, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weak, score): P(bad) by the votes and by the scorer."""
    x = trait.features(block, len(weights) - 1)
    z = (x.astype(np.float64) * weights[:-1]).sum(axis=1) + weights[-1]
    return np.round(model.posterior(trait.votes(block)), 6), np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 6)


def score_documents(documents: DataFrame, most: int = TRAINED_ON, reject_from: float = 0.5) -> DataFrame:
    """(doc_id, weak, score, abuse_weak, abuse_score, keep) of every row of ``documents`` (doc_id, text).

    ``weak`` is the probability of a badly written document by the labellers' votes, ``score`` that of the trained scorer,
    to 6 places; ``abuse_weak`` and ``abuse_score`` are those of one that abuses people. ``keep`` is false where a score
    is ``reject_from`` or more. A null text is empty; labellers that need more words than a text has don't vote. Rows that
    repeat a doc_id, or have none, each keep their row; other columns are left out. An empty table gives no rows. Whole
    texts are looked at.
    """
    poor, abusive = fit(documents, most), fit(documents, most, trait=ABUSIVE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                block = block_of(part.column("text"))
                weak, score = _score(block, POOR, *poor)
                abuse_weak, abuse = _score(block, ABUSIVE, *abusive)
                keep = (score < reject_from) & (abuse < reject_from)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *map(pa.array, (weak, score, abuse_weak, abuse, keep))],
                    names=["doc_id", "weak", "score", "abuse_weak", "abuse_score", "keep"],
                )

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, weak double, score double, abuse_weak double, abuse_score double, keep boolean")


def keep_good(documents: DataFrame, most: int = TRAINED_ON, reject_from: float = 0.5) -> DataFrame:
    """The rows of ``documents`` that :func:`score_documents` keeps, all columns as they are."""
    poor, abusive = fit(documents, most), fit(documents, most, trait=ABUSIVE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                block = block_of(part.column("text"))
                (_, score), (_, abuse) = _score(block, POOR, *poor), _score(block, ABUSIVE, *abusive)
                yield part.filter(pa.array((score < reject_from) & (abuse < reject_from)))

    return documents.mapInArrow(freed(run), documents.schema)
