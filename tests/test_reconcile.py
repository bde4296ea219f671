import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from recordlens.operators import reconcile as M


def brute(official, candidates):
    best = None
    for cid, name in sorted(candidates):
        s = SequenceMatcher(None, official, name).ratio()
        if official in name or name in official:
            s = max(s, 0.9)
        if s > 0 and (best is None or s > best[0]):
            best = (s, cid)
    return best


@pytest.fixture(scope="module")
def lists():
    rng = random.Random(5)
    words = ["医療", "研究", "AI", "支援", "事業", "推進", "データ", "基盤", "整備", "活用", "alpha", "beta"]
    cands = sorted({"".join(rng.sample(words, rng.randint(1, 5))) for _ in range(150)})
    offs = set()
    for c in rng.sample(cands, 60):
        kind = rng.randint(0, 4)
        if kind == 0 and len(c) > 2:
            i = rng.randrange(len(c))
            offs.add(c[:i] + c[i + 1:])
        elif kind == 1:
            offs.add(c + "（補足説明の長い長い括弧書き）")
        elif kind == 2:
            offs.add("".join(rng.sample(c, len(c))))
        elif kind == 3:
            offs.add(c[1:] or "x")
        else:
            offs.add("".join(rng.sample("abcdefgh", 6)))
    offs |= {"A", "医"}
    return sorted(offs), list(enumerate(cands))


def frames(spark, lists):
    offs, cands = lists
    return (
        spark.createDataFrame([(o,) for o in offs], "name string"),
        spark.createDataFrame([(n, i) for i, n in cands], "name string, id long").repartition(3),
    )


@pytest.mark.parametrize("block, part", [(256, 8_192), (3, 7)])
def test_best_match_equals_brute_force(spark, lists, monkeypatch, block, part):
    """The same result however the names below the threshold are cut into blocks."""
    offs, cands = lists
    monkeypatch.setattr(M, "BLOCK_NAMES", block)
    monkeypatch.setattr(M, "PART_NAMES", part)
    got = {r["official_name"]: r for r in M.fuzzy_best_match(*frames(spark, lists)).collect()}
    assert sorted(got) == offs
    for o in offs:
        want = brute(o, cands)
        if want is None:
            assert got[o]["similarity"] is None
        else:
            assert (got[o]["similarity"], got[o]["candidate_id"]) == pytest.approx(want), o


def test_blocked_equals_brute_force_from_the_threshold_on(spark, lists):
    offs, cands = lists
    got = {r["official_name"]: r for r in M.fuzzy_best_match(*frames(spark, lists), best_below=False).collect()}
    assert M.scored_pairs(
        *frames(spark, lists), M.THRESHOLD
    ).count() < 0.1 * len(offs) * len(cands)
    assert sorted(got) == offs
    above = 0
    for o in offs:
        want = brute(o, cands)
        if want and want[0] >= M.THRESHOLD:
            above += 1
            assert (got[o]["similarity"], got[o]["candidate_id"]) == pytest.approx(want), o
        else:
            assert got[o]["similarity"] is None, o
    assert above > 20


def test_labels_and_flags(spark):
    officials = M.distinct_names(
        spark.createDataFrame([("同じ名前",), ("同じ名前",), (" 空白 ",), ("計画X",), ("zzz",), ("",), (None,)], "n string"), "n"
    )
    cands = M.distinct_names(
        spark.createDataFrame([(3, "同じ名前"), (2, "同じ名前"), (5, "計画X（補足）"), (6, "空 白")], "i long, n string"), "n", "i"
    )
    ids = spark.createDataFrame([(2,), (6,)], "i long")
    got = {r["official_name"]: r for r in M.reconcile_names(officials, cands, {"seen": ids}).collect()}
    assert {k: (r["match_type"], r["candidate_id"], r["seen"]) for k, r in got.items()} == {
        "同じ名前": ("exact", 2, True), "計画X": ("fuzzy", 5, False), "空白": ("fuzzy", 6, True), "zzz": ("none", None, False),
    }
    assert got["同じ名前"]["copies"] == 2 and got["計画X"]["similarity"] == 0.9
    stats = M.reconcile_stats(M.reconcile_names(officials, cands, {"seen": ids}), ["seen"]).first()
    assert (stats["exact"], stats["fuzzy"], stats["unmatched"], stats["seen"]) == (1, 2, 1, 2)
    assert stats["total_rate"] == 75.0


def test_best_of_all_alone(spark, lists):
    """Ties, containment, characters beyond the basic plane, and a plan that does not grow with the list."""
    offs, cands = lists
    offs = [*offs, "𠮷野家", "aab", "ba", "zzz" * 90]
    cands = [*cands, (900, "𠮷"), (901, "ab"), (902, "ba x"), (903, "ab y"), (-5, "xab")]
    left, right = frames(spark, (offs, cands))
    got = {r["official_name"]: (r["similarity"], r["candidate_id"]) for r in M._best_of_all(left, right).collect()}
    assert got == {o: pytest.approx(w) for o in offs if (w := brute(o, cands)) is not None}
    assert M._best_of_all(left.limit(0), right).count() == 0 and M._best_of_all(left, right.limit(0)).count() == 0
    plans = []
    for n in (10, 3_000):
        many = spark.range(n).select(F.concat(F.lit("name "), F.col("id").cast("string")).alias("name"))
        plans.append(len(M._best_of_all(many, right)._jdf.queryExecution().optimizedPlan().toString().splitlines()))
    assert plans[0] == plans[1]
