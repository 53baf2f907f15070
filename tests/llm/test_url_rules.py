"""URL rules against plain Python."""

import re

import pytest

from muster.llm import url_rules
from muster.llm.queries import URL_RULES

URLS = [
    "http://example.org/es/1", "https://www.EXAMPLE.org/en/12", "http://example.org/en/2", "http://org/", "http://org", "http://borg/x",
    "ftp://a.b.example.com/fr/x?y=/de/", "http://x.com/de/#fr", "http://x.com/DE/", "http://x.net/a", None, "", "no scheme", "://", "http://",
    "http:///fr/", "http://example.org?x=/es/", "http://example.org#/es/", "http://a..org/x", "http://.org/x", "http://example.org./es/",
    "http://u@example.org:80/es/", "http://org/" + "é" * 5000, "http://" + "a." * 3000 + "com/de/", "mailto:x://com/fr/y://org/", "http://example.org/en/1",
    "http://example.org/en/\n1",
]


def expected(url, rules, default="allow"):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = found.groups() if found else ("", "")
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p or "") and h]
    best = max(fits) if fits else (0, 0, 0, None, default)
    return host, path, best[3], best[4]


def key(row):
    return tuple((x is not None, x) for x in row)


RULES = [*URL_RULES, ("net", "", "block"), ("x.net", "/a", "allow"), ("x.net", "/a", "block"), ("b.example.com", "/fr/", "block")]


@pytest.mark.parametrize("rules", [URL_RULES, RULES, []])
@pytest.mark.parametrize("limit", [url_rules.BROADCAST_BYTES, 0])
def test_every_url_gets_its_longest_rule(spark, rules, limit):
    rows = [(k // 2, u, "clash", 1) for k, u in enumerate(URLS * 2)] + [(None, URLS[0], "clash", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, place int").repartition(3)
    out = url_rules.judge(pages, url_rules.rules_of(spark, rules), broadcast_bytes=limit)
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    want = [(i, u, *expected(u, rules)) for i, u, *_ in rows]
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)


def test_rules_without_host_or_verdict_are_left_out(spark):
    rules = spark.createDataFrame([(None, "/", "block"), ("", "/", "block"), ("com", "/", None), ("ORG", None, "block")], url_rules.RULE)
    pages = spark.createDataFrame([(1, "http://a.com/"), (2, "http://a.org")], "page_id long, url string")
    assert sorted((r.page_id, r.rule, r.verdict) for r in url_rules.judge(pages, rules).collect()) == [(1, None, "allow"), (2, "org", "block")]


def test_allowed_rows_keep_all_columns(spark):
    pages = spark.createDataFrame([(k, u, f"v{k}", f"w{k}") for k, u in enumerate(URLS)], "place long, url string, verdict string, `a.b` string")
    kept = url_rules.keep_allowed(pages, url_rules.rules_of(spark, URL_RULES))
    assert kept.columns == pages.columns
    assert sorted(r[0] for r in kept.collect()) == [k for k, u in enumerate(URLS) if expected(u, URL_RULES)[3] == "allow"]


def test_no_rows(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge(pages, url_rules.rules_of(spark, URL_RULES)).collect() == []


def test_one_url_on_most_rows(spark):
    pages = spark.range(20_000).selectExpr("id page_id", "if(id % 10 < 8, 'http://example.org/es/1', concat('http://h', id, '.com/de/')) url")
    out = url_rules.judge(pages, url_rules.rules_of(spark, URL_RULES), broadcast_bytes=0)
    assert {(r.rule, r.verdict): r["count"] for r in out.groupBy("rule", "verdict").count().collect()} == {
        ("example.org/es/", "block"): 16_000, ("com/de/", "block"): 4_000}
