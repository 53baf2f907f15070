"""Literal truth tables of the classifiers."""

import random
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from muster.functions import classify as cl
from muster.functions import text as tx
from muster.operators import report


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in df.select("i", fn("v").alias("x")).orderBy("i").collect()]


def test_segments(spark):
    rows = [
        ("Director of Risk Analytics", None, "Acme Bank", "Risk"),
        ("IAM Lead", None, "Acme Bank", "Compliance"),
        ("SVP Digital Product", None, "Acme Bank", "Innovation"),
        ("SVP Digital Product", None, "Acme Credit Union", "Unassigned"),
        ("Mobile Banking Manager", None, "North Star FCU", "Digital Banking"),
        ("IT Business Analyst", None, "Acme", "Technology"),
        ("Business Analyst", None, "Acme", "Data"),
        ("Head of AI", None, "Acme", "AI"),
        ("AML Manager", None, "Acme", "Compliance"),
        ("Operations Manager", None, "Acme", "Unassigned"),
        ("IT Operations Manager", None, "Acme", "Technology"),
        ("Cloud/Infrastructure", None, "Acme", "Technology"),
        ("Incubation Lead", None, "Acme", "Innovation"),
        ("Teller", "  DIRECTOR ", "Acme", "Others (most senior)"),
        ("Teller", None, "Acme", "Unassigned"),
        (None, None, None, "Unassigned"),
        ("  ", "Head", None, "Others (most senior)"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, title string, seniority string, company string, want string")
    for r in cl.with_segment(df, "title", "seniority", "company").collect():
        assert r["segment"] == r["want"], r


def test_expansion_appends_in_order(spark):
    got = column(spark, ["AI & ML-Lead", "OFAC", "machine learnin", "Teller", None], tx.expand_title)
    assert got == [
        "ai   ml lead  artificial intelligence  machine learning", "ofac  sanctions ofac", "machine learnin machine learning", "teller", "",
    ]


def test_org_and_company_types(spark):
    names = ["North Star FCU", "Teachers CU", "Acme Federal Credit Union", "Cube Bank", "  ", None, ""]
    assert column(spark, names, cl.org_type) == ["Credit Union"] * 3 + ["Bank"] * 4
    assert column(spark, names, lambda c: cl.company_type(c, "Unknown"))[3:] == ["Bank", "Bank", "Unknown", "Unknown"]


def test_geography(spark):
    places = ["Charlotte, NC", "Raleigh NC", "North Carolina", "Richmond, VA", "Nevada", "USA", "Paris", None, "NYC", "West Virginia", "Tennesee", "Gorgia"]
    assert column(spark, places, cl.geo_bucket) == [
        "Charlotte", "North Carolina (not inc Charlotte)", "North Carolina (not inc Charlotte)", "Virginia", "US", "US", "US", "US", "New York", "Virginia", "US", "US",
    ]
    # A two-letter code matches inside words: "Nevada" holds "va".
    assert column(spark, places, cl.geo_fuzzy) == [
        "North Carolina", "North Carolina", "North Carolina", "Virginia", "Virginia", "Other States", "Other States", "Other States",
        "Other States", "Virginia", "Tennessee", "Georgia",
    ]
    assert column(spark, ["Nevada"], lambda c: cl.geo_fuzzy(c, whole_codes=True)) == ["Other States"]
    assert column(spark, places, lambda c: cl.is_nc(c)) == [True, True, True] + [False] * 9
    multi = column(spark, ["VA", "va.", "South Carolina and Georgia", "Virgina", None, "Ohio"], cl.geo_multi)
    assert multi == [["Virginia"], ["Virginia"], ["Georgia", "South Carolina"], ["Virginia"], [], []]


def test_seniority(spark):
    titles = ["Global Lead Strategy", "Chief Data Officer", "Managing Director", "MDX", "SVP", "Data Analyst", None, "co-founder"]
    assert column(spark, titles, lambda c: cl.title_seniority(c)["label"]) == [
        "Global Lead", "C-Suite", "Managing Director", "Unknown", "SVP", "Analyst", "Unknown", "C-Suite",
    ]
    raw = ["C-Suite", "vp", "Chair/Board Member", "head of x", "ENTRY_LEVEL", "Wizard ", None, "Non-Senior Banker"]
    assert column(spark, raw, cl.canonical_seniority) == [
        "C-Suite", "Vice President", "Chair/Board Member", "Head", "Entry-Level", "Wizard", "Unknown", "Non-Senior Banker",
    ]
    assert column(spark, ["Chief Risk Officer", "Loan Officer", "Executive Director", "  ", None, "Trainee"], cl.inferred_seniority) == [
        "C-Suite", "Non-Senior Banker", "Leadership", None, None, "Entry-Level",
    ]


def test_name_repair(spark):
    rows = [
        ("ana.reed@x.com", "Ana", "Reed, CPA", "Ana", "Reed", "matched_email_orientation"),
        ("ana.reed@x.com", "Reed", "Ana", "Ana", "Reed", "swapped_based_on_email"),
        ("ana.reed@x.com", "Ana", "McReed", "Ana", "McReed", "lastname_trimmed_to_core"),
        ("ana.reed@x.com", "Ana", "Xu", "Ana", "Reed", "lastname_overwritten_from_email"),
        ("ana.reed@x.com", "Diana", "Reed", "Diana", "Reed", "firstname_trimmed_to_core"),
        ("ana.reed@x.com", "Q", "Reed", "Ana", "Reed", "firstname_overwritten_from_email"),
        ("ana.reed@x.com", "Q", "Z", "Q", "Z", "original_cleaned"),
        ("areed@x.com", "Ana", "Reed, PhD", "Ana", "Reed", "original_cleaned"),
        (None, None, "  ", "", "", "original_cleaned"),
    ]
    df = spark.createDataFrame(rows, "email string, f string, l string, wf string, wl string, rule string")
    for r in df.withColumn("v", cl.fixed_name("email", "f", "l")).collect():
        assert (r["v"]["first"], r["v"]["last"], r["v"]["rule"]) == (r["wf"], r["wl"], r["rule"]), r


def test_company_names(spark):
    raw = ["The Blue-Ring (UK) Limited", "Acme & Sons, Inc.", "Citra Bank (Texas)", "The Bank Group", "HSBC plc", None, "Café Bank"]
    assert column(spark, raw, tx.company_core) == ["blue-ring", "acme and sons", "citra bank", "bank", "hsbc", "", "caf bank"]
    assert column(spark, raw, tx.proposed_name)[4:6] == ["HSBC", None]
    assert column(spark, raw, tx.brand_core) == ["the blue ring", "acme sons", "citra", "the", "hsbc", "", "café"]
    # A decomposed accent counts as a separator.
    assert column(spark, raw, tx.match_key) == ["blue ring uk", "acme sons", "citra texas", "", "hsbc", "", "cafe"]
    assert column(spark, [" a & b c "], tx.light_company) == ["a and b c"]


def test_unicode_forms(spark):
    values = ["Ａcme Ｌtd", "ﬁnance", "Café", "plain"]
    assert column(spark, values, tx.nfkc_lower) == [" ".join(unicodedata.normalize("NFKC", v).lower().split()) for v in values]
    assert column(spark, values, tx.nfkd_lower) == [" ".join(unicodedata.normalize("NFKD", v).lower().split()) for v in values]


def test_unicode_forms_equal_the_standard_library(spark):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    marks = [c for c in points if unicodedata.combining(chr(c))]
    draw = random.Random(7)
    texts = [chr(c) for c in points]
    texts += ["".join(map(chr, draw.choices(points, k=6))) for _ in range(5000)]
    # Marks in any order, behind letters that take them and Hangul that composes.
    texts += [draw.choice("aeoÅ한\u1100") + "".join(map(chr, draw.choices(marks, k=5))) + "\u1161\u11a8" for _ in range(5000)]
    df = spark.createDataFrame([(t,) for t in [*texts, "", None]], "t string")
    for form in ("NFC", "NFD", "NFKC", "NFKD"):
        out = df.select("t", tx.unicode_form("t", form).alias("o"))
        assert [r for r in out.collect() if r.o != (None if r.t is None else unicodedata.normalize(form, r.t))] == []
    with pytest.raises(ValueError):
        tx.unicode_form("t", "NFX")


def test_normalised_keys_need_no_python_workers(spark, capsys):
    df = spark.createDataFrame([("Café ＡＢ", "ﬁnance")], "a string, b string").cache()
    df.select(tx.nfkc_lower("a"), tx.nfkd_lower("b"), tx.match_key("a")).explain()
    assert "Python" not in capsys.readouterr().out.split("Scan")[0]


@pytest.mark.parametrize("buckets", [1, 7, 1 << 16])
def test_top_values_equal_a_full_count(spark, buckets):
    draw = random.Random(3)
    skewed = [str(int(draw.paretovariate(0.7))) for _ in range(8000)] + [None] * 90
    cases = [skewed, [str(i % 50) for i in range(500)], ["a", "b", "b", ""], []]
    for rows in cases:
        df = spark.createDataFrame([(v,) for v in rows], "v string")
        counts = Counter("(blank)" if v is None else v for v in rows)
        want = sorted(counts.items(), key=lambda e: (-e[1], e[0]))[:20]
        assert [tuple(r) for r in report.top_values(df, "v", 20, buckets=buckets).collect()] == want


def test_top_values_group_few_of_many_distinct_values(spark):
    rare = spark.range(200_000).select(F.concat(F.lit("rare "), "id").alias("value"))
    often = spark.range(60_000).select(F.concat(F.lit("often "), F.col("id") % 30).alias("value"))
    named = rare.union(often).withColumn("bucket", F.pmod(F.xxhash64("value"), F.lit(1 << 12)).cast("int"))
    kept = report.heavy_buckets(named, 20)
    assert named.join(kept, "bucket", "left_semi").distinct().count() < 200_000 / 50


def test_phrase_counting_equals_counting_one_by_one(spark):
    import re

    phrases = ["it operations", "operations", "it", "it support", "support manager", "network and it"]
    texts = ["it operations it-support manager", "network and it operations operations", "it it it", ""]
    want = [sum(len(re.findall(tx.phrase_pattern(p), t)) for p in phrases) for t in texts]
    assert column(spark, texts, lambda c: tx.phrase_count(c, phrases)) == want


def test_urls_and_tokens(spark):
    assert column(spark, ["https://X.com/in/A/?q=1", " https://x.com/a// ", None], tx.profile_url) == ["https://x.com/in/a", "https://x.com/a", ""]
    assert column(spark, ["a.b_c1@x", "none", None], lambda c: F.array_join(tx.email_tokens(c), "|")) == ["a|b|c", "", ""]


def test_sheets_without_name_columns_keep_their_names(spark):
    df = spark.createDataFrame([("a.b@c.d", "b", "x")], "`E Mail` string, `First_Name` string, `a.b` string")
    out = cl.with_fixed_names(df)
    assert out.columns == ["E Mail", "First_Name", "a.b", "firstname_fixed", "lastname_fixed", "name_fix_rule"]
    assert out.collect()[0][3:] == ("b", "", "missing_required_columns")
    whole = cl.with_fixed_names(df.withColumnRenamed("a.b", "LAST NAME").withColumnRenamed("E Mail", "email"))
    assert whole.collect()[0][3:] == ("b", "x", "original_cleaned")
