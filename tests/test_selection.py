import random

import pytest
from pyspark.sql import functions as F

from muster.operators import dedupe, select, skew
from muster.operators.position import shuffled, sorted_by, with_position


def greedy(owners, n):
    held, out = [owners.count(i) for i in range(n)], {}
    want = [len(owners) // n + (1 if i < len(owners) % n else 0) for i in range(n)]
    for i, o in enumerate(owners):
        if o is None:
            o = max(range(n), key=lambda m: (want[m] - held[m], -m))
            held[o] += 1
        out[i] = o
    return out


@pytest.mark.parametrize("seed", range(5))
def test_allocation_equals_greedy_loop(spark, seed):
    rnd = random.Random(seed)
    n, size = rnd.randint(1, 6), rnd.randint(1, 50)
    owners = [rnd.choice([None] * rnd.randint(1, 4) + list(range(n))) for _ in range(size)]
    df = spark.createDataFrame(list(enumerate(owners)), "row_id bigint, owner int")
    assert {r["row_id"]: r["member_idx"] for r in select.allocate(df, n).collect()} == greedy(owners, n)


def test_positions_and_even_split(spark):
    rnd = random.Random(4)
    ids = sorted(rnd.sample(range(-(2 ** 45), 2 ** 45), 53))
    df = spark.createDataFrame([(i,) for i in ids], "row_id bigint")
    assert [r["row_id"] for r in with_position(df).orderBy("position").collect()] == ids
    parts = select.split_even(df, 7).groupBy("part").count().orderBy("part").collect()
    assert [r["count"] for r in parts] == [8, 8, 8, 8, 7, 7, 7]
    order = [r["row_id"] for r in shuffled(df).orderBy("position").collect()]
    assert sorted(order) == ids and order != ids


def literal_quota(rows, n_max, n_min):
    """Choice for one company, one step at a time; rows are (score, bucket, id)."""
    rows = sorted(rows, key=lambda r: (-r[0], r[2]))
    if len(rows) <= n_min:
        return {r[2] for r in rows}
    chosen, left = [], list(rows)
    for bucket, quota in select.bucket_quotas(n_max).items():
        take = [r for r in left if r[1] == bucket][:quota]
        chosen += take
        left = [r for r in left if r not in take]
    chosen += left[: max(n_max - len(chosen), 0)]
    return {r[2] for r in chosen[:n_max]}


def test_quota_choice_equals_literal_steps(spark):
    rnd = random.Random(9)
    rows, expected, rid = [], set(), 0
    for company in range(12):
        group = []
        for _ in range(rnd.randint(1, 45)):
            group.append((float(rnd.randint(0, 9)), rnd.choices(["leadership", "manager", "specialist"], [1, 2, 6])[0], rid))
            rid += 1
        expected |= literal_quota(group, 20, 12)
        rows += [(i, f"c{company}", b, s) for s, b, i in group]
    df = spark.createDataFrame(rows, "row_id bigint, company string, bucket string, score double")
    got = select.select_with_quotas(df, "company", "bucket", "score", 20, 12)
    assert {r["row_id"] for r in got.collect()} == expected
    assert select.bucket_quotas(200) == {"leadership": 70, "manager": 80, "specialist": 50}


def test_top_rows_are_cut_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id AS row_id", "concat('c', id % 1) AS company", "id % 7 AS score")
    top = select.top_per_company(df, "company", "score")
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert [r["row_id"] for r in top.orderBy("rank").collect()] == [6, 13, 20, 27, 34]


def test_lookup_join_with_one_dominant_key(spark):
    df = spark.range(3000).selectExpr("id AS row_id", "if(id % 3 = 0, concat('k', id), 'hot') AS k")
    table = spark.createDataFrame([("hot", 1), ("k3", 2)], "k string, v int")
    out = skew.lookup_join(df, table, "k")
    assert out.count() == 3000
    assert out.groupBy("v").count().orderBy(F.asc_nulls_first("v")).collect()[1]["count"] == 2000


def test_many_frequent_keys_are_cut_in_proportion(spark):
    # 200 frequent keys with 100 rows each, one with 5,000, and 5,000 single ones.
    df = spark.range(30_000).selectExpr("id AS row_id", "case when id < 20000 then concat('h', id % 200) when id < 25000 then 'top' else concat('k', id) end AS k")
    counts = skew.key_counts(df, "k")
    shares = {r["k"]: r["_shares"] for r in skew.key_shares(counts, "k", 1000).collect()}
    assert len(shares) == 201 and {shares[k] for k in shares if k != "top"} == {4} and shares["top"] == 167
    table = df.select("k").distinct().withColumn("v", F.concat(F.lit("v"), "k"))
    out = skew.lookup_join(df, table, "k", counts=counts, parts=1000)
    assert out.filter("v = concat('v', k)").count() == out.count() == 30_000
    # The rows as the join deals them out: no task has more than twice the median.
    left = df.join(F.broadcast(skew.key_shares(counts, "k", 1000)), "k", "left")
    dealt = left.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("row_id"), F.col("_shares")), F.lit(0))).repartition(16, "k", "_salt")
    sizes = sorted(r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == 16 and sizes[-1] <= 2 * sizes[8]


def test_allocation_has_no_window_over_all_rows(spark):
    df = spark.createDataFrame([(1, None), (2, 0)], "row_id bigint, owner int")
    plan = with_position(df)._jdf.queryExecution().executedPlan().toString()
    # The one unpartitioned window runs over bucket counts, not over rows.
    assert "row_number() windowspecdefinition(_bucket" in plan


def test_keep_first_and_keyless_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "row_id bigint, k string")
    assert sorted(r["row_id"] for r in dedupe.keep_first(df, ["k"]).collect()) == [1, 3]
    assert sorted(r["row_id"] for r in dedupe.keep_first(df, ["k"], keep_keyless=True).collect()) == [1, 3, 4]


def test_names_are_cycled():
    assert select.cycled_names(["a", " b "], 5) == ["a", "b", "a", "b", "a"]
    assert select.cycled_names([], 2) == ["Unassigned", "Unassigned"]


def test_sort_directions_and_nulls(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), (None, 3), ("a", 2), ("a", None)], "k string, v int")
    assert sorted_by(df, k=True, v=False).collect() == [("a", 2), ("a", 1), ("a", None), ("b", 1), (None, 3)]


def test_quotas_treat_padded_names_as_one_company(spark):
    df = spark.createDataFrame([(1, "Acme", "x", 2.0), (2, "Acme ", "x", 1.0)], "row_id long, company string, bucket string, score double")
    got = select.select_with_quotas(df, "company", "bucket", "score", 1, 0)
    assert [r.row_id for r in got.collect()] == [1] and got.columns == [*df.columns, "rank"]


def test_rows_beyond_the_top_are_all_others(spark):
    df = spark.range(900).selectExpr("id row_id", "if(id % 3 = 0, 'hot', concat('c', id % 50)) company", "if(id % 11 = 0, null, id % 7) score")
    top = select.top_per_company(df, "company", "score").select("row_id")
    rest = select.beyond_top(df, "company", "score")
    assert rest.columns == df.columns
    assert sorted(r[0] for r in rest.select("row_id").union(top).collect()) == list(range(900))


def test_owners_are_looked_up_once(spark):
    df = spark.range(100).selectExpr("id row_id", "concat('https://linkedin.com/in/p', id % 40) url")
    links = spark.range(10).selectExpr("concat('https://linkedin.com/in/p', id) url", "cast(id % 3 as int) member_idx")
    out = select.allocate(select.owners_of(df, links), 4)
    plan = out._jdf.queryExecution().analyzed().toString()
    # What is left of the lookup is a stored table; nothing joins on URLs any more.
    assert "_url" not in plan and "_shares" not in plan
    assert out.groupBy("member_idx").count().agg(F.min("count"), F.max("count")).first()[:] == (25, 25)
