"""The target cascade and the segments: rows of the results, and work that follows the input."""

import collections

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from muster.functions import classify as cl
from muster.operators import match, skew

TARGETS = [(1, "Nordea Bank"), (2, "NORDEA bank"), (3, "Citra Capitol Markets"), (4, "Nobody"), (5, None), (6, ""), (7, "Nordea Bank"), (8, "Silent Trust")]
CONTACTS = [(1, "Nordea Bank", "Other"), (2, "Nordea Bank", "nordea bank"), (3, "Citra Capital Markets", None), (3, "Nordea Bank", "Zed"),
            (4, None, "Citra Capital Markets"), (None, "Nordea Bank", None), (9, "Silent Trust", None)]
PEOPLE = [(1, "a"), (2, "a"), (3, "b"), (3, "c"), (4, None), (None, "z"), (9, None)]


def tables(spark):
    return (spark.createDataFrame(TARGETS, "target_id long, target string"), spark.createDataFrame(CONTACTS, "row_id long, company string, employer string"),
            spark.createDataFrame(PEOPLE, "row_id long, email string"))


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_contacts_meet_their_rows_before_their_targets(spark):
    targets, contacts, people = tables(spark)
    plain = match.match_targets(targets, contacts, ["company", "employer"], "target")
    want = plain.join(people, "row_id", "left")
    got = match.match_targets(targets, contacts, ["company", "employer"], "target", people=people)
    rows = lambda df: collections.Counter(tuple(r) for r in df.select("target_id", "target", "match_type", "source", "raw", "row_id", "email").collect())
    assert rows(got) == rows(want) and sum(rows(got).values()) > 10
    assert {r[0] for r in rows(got)} == {1, 2, 3, 7, 8}


def test_row_back_joins_no_expanded_rows(spark, sf_dir):
    joins = [line for line in optimized(entry.queries()["join_row_back"](spark, sf_dir)).splitlines() if " Join " in f" {line.strip(' :+-')} "]
    assert "_salt" in joins[0]


def test_people_are_told_apart_once_per_key(spark):
    targets, contacts, people = tables(spark)
    pairs = match.match_targets(targets, contacts, ["company", "employer"], "target").join(people, "row_id", "left")
    want = {tuple(r) for r in pairs.groupBy("target").agg(F.countDistinct("email")).collect()}
    got = match.match_people(targets, contacts, ["company", "employer"], people, ["email"], "target")
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert ("Silent Trust", 0) in want and ("Nordea Bank", 3) in want


def test_counts_need_no_pairs_of_targets_and_contacts(spark, sf_dir):
    for name in ("join_no_match", "join_counts_back"):
        assert "_salt" not in optimized(entry.queries()[name](spark, sf_dir))


def test_segments_are_found_by_many_tasks(spark):
    df = spark.range(400).selectExpr("id AS row_id", "'IT Manager' AS title", "'Head' AS seniority", "'Acme' AS company").coalesce(1)
    out = cl.with_segment(df, "title", "seniority", "company")
    per_task = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(r["count"] for r in per_task) < 200
    assert out.filter("segment = 'Technology'").count() == 400


def test_the_sort_by_rank_reads_finished_rows(spark, sf_dir):
    plan = optimized(entry.queries()["srt_business_rank"](spark, sf_dir))
    assert "Sort" in plan and "rlike" not in plan.lower()


@pytest.mark.parametrize("name", ["join_exact_then_fuzzy", "join_row_back"])
def test_rows_of_many_targets_take_few_bytes(spark, tmp_path, name):
    spark.range(1500).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(60000).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    entry.queries()[name](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    n, size = out.count(), sum(f.stat().st_size for f in tmp_path.glob("out/*.parquet"))
    assert n > 3_000_000 and out.select("target_id", "row_id", "source").distinct().count() == n
    # A plain join takes more than a byte and a half.
    assert size < 0.6 * n


@pytest.mark.parametrize("parts", [None, 1, 1000])
def test_pairs_of_rows_meet_once_whatever_the_cells(spark, tmp_path, parts):
    left = [("hot", i % 90, f"l{i % 40}") for i in range(300)] + [("one", 1, None), ("none", 2, "x"), (None, 3, "y")]
    right = [("hot", i % 50, f"r{i % 7}") for i in range(200)] + [("one", i, "z") for i in range(9000)] + [(None, 5, "w")]
    for side, rows in (("l", left), ("r", right)):
        df = spark.createDataFrame(rows, f"k string, {side}id long, {side} string").repartition(3)
        df.withColumn("at", F.monotonically_increasing_id()).write.parquet(f"{tmp_path}/{side}")
    a, b = (spark.read.parquet(f"{tmp_path}/{side}") for side in "lr")
    counts = a.groupBy("k").agg(F.count("*").alias("n")).join(b.groupBy("k").agg(F.count("*").alias("m")), "k")
    cols = ["k", "lid", "l", "rid", "r"]
    got = skew.pair_join(a, b, "k", counts, "at", parts).select(cols)
    want = a.join(b, "k").select(cols)
    assert got.count() == want.count() == 300 * 200 + 9000
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_cells_hold_bounded_parts_of_both_sides(spark):
    counts = [("hot", 400_000, 30_000), ("wide", 1, 10_000_000), ("long", 10_000_000, 1), ("few", 5, 5)]
    parts, total = 4800, sum(n * m for _, n, m in counts)
    grid = {r["k"]: r for r in skew.pair_grid(spark.createDataFrame(counts, "k string, n long, m long"), "k", parts).collect()}
    assert set(grid) == {"hot", "wide", "long"}
    for k, n, m in counts[:3]:
        across, down, slots = grid[k]["_across"], grid[k]["_down"], grid[k]["_slots"]
        assert n * m / (across * down) <= max(total / parts, 1) and n / across <= skew.CELL_ROWS
        assert slots % down == 0 and m / slots <= skew.GATHERED
        # The square root of the cells, not the cells, is what rows are copied by.
        assert n * down + m * across <= 2.2 * (n * m * (across * down)) ** 0.5 + 2 * (n + m) + m * n / skew.CELL_ROWS
