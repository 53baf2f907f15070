import random

import pytest
from pyspark.sql import functions as F

from brute import SCORES, lcs
from muster.functions import similarity as sim
from muster.operators import cluster, fuzzy_join
from muster.functions import text as tx

WORDS = ["bank", "nordea", "citra", "blue", "ring", "north", "star", "aé", "x", "of", "ltd", "group", "va", "union"]


def names(seed, n, words=WORDS):
    rnd = random.Random(seed)

    def typo(w):
        r, i = rnd.random(), rnd.randrange(len(w) + 1)
        if r < 0.15 and len(w) > 2:
            return w[: i - 1] + w[i:] if i else w[1:]
        return w[:i] + rnd.choice("abcxyz") + w[i:] if r < 0.3 else w

    return list(dict.fromkeys(" ".join(typo(rnd.choice(words)) for _ in range(rnd.choice([1, 1, 2, 2, 3, 4]))) for _ in range(n)))


def test_scores_match_plain_forms(spark):
    a, b = names(1, 60), names(2, 60)
    rows = list(zip(a, b)) + [("", ""), ("", "a"), ("a", ""), ("ab c" * 40 + "x", "a bc" * 37), ("z" * 62 + "abc", "z" * 63)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(
        "a", "b", sim.lcs_length("a", "b").alias("lcs"), sim.ratio("a", "b").alias("ratio"), sim.token_sort_ratio("a", "b").alias("token_sort"),
        sim.token_set_ratio("a", "b").alias("token_set"), sim.partial_ratio("a", "b").alias("partial"),
    ).collect()
    for r in got:
        assert r["lcs"] == lcs(r["a"], r["b"])
        for name, fn in SCORES.items():
            assert r[name] == pytest.approx(fn(r["a"], r["b"]), abs=1e-9), (name, r)


def test_native_scores_use_no_python(spark):
    df = spark.createDataFrame([("a", "b")], "a string, b string").select(sim.token_set_ratio("a", "b"), sim.partial_ratio("a", "b"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("scorer,threshold", [("token_set", 88), ("token_set", 60), ("ratio", 88), ("token_sort", 70), ("partial", 85)])
def test_best_match_equals_full_comparison(spark, scorer, threshold):
    left, right = names(11, 60), names(12, 60)
    left.append("bank group of the very long named international credit union holding company of zenith north star")
    right.append("bank group of the very long named international credit union holding company of zenith north sta")
    expected = {}
    for a in left:
        best = max(range(len(right)), key=lambda i: (SCORES[scorer](a, right[i]), -i))
        if SCORES[scorer](a, right[best]) >= threshold:
            expected[a] = (right[best], best)
    got = fuzzy_join.best_match(
        spark.createDataFrame([(a,) for a in left], "key string"),
        spark.createDataFrame([(b, i) for i, b in enumerate(right)], "key string, pos bigint"), scorer, threshold,
    )
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert {r["key"]: (r["match"], r["pos"]) for r in got.collect()} == expected


@pytest.mark.parametrize("scorer", ["token_set", "ratio", "token_sort", "partial"])
def test_best_match_at_any_score(spark, scorer):
    left, right = names(21, 25) + ["qqq", "q x", "", "zz 99 nord"], names(22, 40) + [""]
    got = fuzzy_join.best_match_any(
        spark.createDataFrame([(a,) for a in left], "key string"),
        spark.createDataFrame([(b, i) for i, b in enumerate(right)], "key string, pos bigint"), scorer,
    )
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    score = SCORES[scorer]
    expected = {a: max(((score(a, b), -i, b) for i, b in enumerate(right) if b)) for a in left if a}
    assert {r["key"]: (pytest.approx(r["score"]), -r["pos"], r["match"]) for r in got.collect()} == expected


def test_best_match_at_any_score_without_right_keys(spark):
    left, none = spark.createDataFrame([("a",)], "key string"), spark.createDataFrame([], "key string, pos bigint")
    assert fuzzy_join.best_match_any(left, none).collect() == []
    assert fuzzy_join.best_match_any(none.select("key"), left.selectExpr("key", "1L pos")).collect() == []


def test_bounds_leave_few_pairs(spark):
    left, right = names(51, 700, [f"{a}{b}" for a in WORDS for b in WORDS]), names(52, 700, [f"{a}{b}" for a in WORDS for b in WORDS])
    keys = spark.createDataFrame([(0, a, 0, 0.62, 0) for a in left] + [(1, a, i, None, None) for i, a in enumerate(right)],
                                 "side int, key string, pos bigint, t double, band int")
    found = {(r.lkey, r.rkey) for r in fuzzy_join._loose_pairs(keys, "ratio", [0.6]).collect()}
    wanted = {(a, b) for a in left for b in right if SCORES["ratio"](a, b) >= 62}
    assert wanted <= found and len(found) < 0.35 * len(left) * len(right)


def test_a_feature_that_all_keys_hold_is_dealt_to_a_grid(spark, monkeypatch):
    monkeypatch.setattr(fuzzy_join, "SHARE", 500)
    one = spark.range(2000).selectExpr("0 band", "concat('k', id) key", "cast(5 + id % 30 as int) n", "0.8D t", "'f' f", "4000L df")
    side = lambda p: one.select("band", "f", "df", *[F.col(c).alias(p + c) for c in ("key", "n", "t")])
    met = fuzzy_join._meet(side("l"), side("r"))
    # 8 rows and columns: no cell has more than its share of either side.
    cells = met.groupBy("across", "down").agg(F.countDistinct("lkey").alias("l"), F.countDistinct("rkey").alias("r")).collect()
    assert len(cells) == 64 and max(max(c.l, c.r) for c in cells) <= 500
    assert met.count() == 4_000_000 and met.groupBy("lkey").count().agg(F.max("count")).first()[0] == 2000
    near = fuzzy_join._meet(side("l"), side("r"), by_length=True)
    close = "2 * least(ln, rn) >= 0.8 * (ln + rn)"
    assert near.count() < 0.75 * met.count()
    assert near.filter(close).count() == met.filter(close).count()


def test_a_token_that_all_keys_hold_meets_its_single_key(spark):
    many = spark.range(3000).selectExpr("concat('bank w', id) key", "id + 1 pos").unionAll(spark.createDataFrame([("bank", 0)], "key string, pos bigint"))
    pairs = fuzzy_join.similar_pairs(many.filter("pos < 40"), "token_set", 100).collect()
    assert {(r.lkey, r.rkey) for r in pairs} == {("bank", f"bank w{i}") for i in range(39)}
    best = fuzzy_join.best_match(many.select("key"), many.filter("pos = 0"), "token_set", 100)
    assert best.count() == 3001


def test_pairs_and_merge_follow_the_last_pair(spark):
    words = [w for w in WORDS if w.isascii()]
    raw = sorted(names(31, 70, words), key=lambda s: (s.lower(), s))
    df = spark.createDataFrame([(n,) for n in raw], "name string")
    cores = cluster.by_core(cluster.ordered_names(df, "name"))
    ordered = [r["core"] for r in cores.orderBy("place").collect()]
    score, expected = SCORES["token_set"], {}
    for i, a in enumerate(ordered):
        for b in ordered[i + 1:]:
            if a and b and score(a, b) >= 80:
                expected[a] = expected[b] = min(a, b, key=len)
    got = {r["core"]: r["standard"] for r in cluster.merged_cores(cores, 80).collect()}
    assert got == {k: " ".join(w.capitalize() for w in v.split()) for k, v in expected.items()}
    pairs = {(r["lkey"], r["rkey"]) for r in fuzzy_join.similar_pairs(cluster.core_keys(cores), "token_set", 80).collect()}
    assert pairs == {(a, b) for i, a in enumerate(ordered) for b in ordered[i + 1:] if a and b and score(a, b) >= 80}
