"""URL rules and trees."""

import re

import pytest
from pyspark.sql import functions as F

from pitpanel.llm import urls
from pitpanel.llm.registered import QUERIES, URL_RULES


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in URL_RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


def test_query_follows_the_rules(spark, sf):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()}
    rows = QUERIES["op8_url_filter"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        host, path, rule, verdict = plain(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.p_block >= 0.5 else "allow"))


def test_odd_urls(spark):
    odd = [None, "", "no scheme", "://", "http://", "http://COM", "http://Com/", "https://a.Example.com/en/x?y#z", "http://wwww.example.com/en/", "http://www.example.com/en/",
           "http://x.www.example.com/en/", "http://net/es/", "http://a.net?/es/", "http://a.net#/fr/", "http://ÀÉ.com/ü", "a://b://c/d", "http://x.net/en/es/", "http://a\nb.com/c\nd?e"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(odd)], "page_id int, url string")
    rule, verdict = urls.fitting_rule(urls.host_of(F.col("url")), urls.path_of(F.col("url")), URL_RULES)
    for r in df.select("page_id", urls.host_of(F.col("url")).alias("h"), urls.path_of(F.col("url")).alias("p"), rule.alias("r"), verdict.alias("v")).collect():
        assert (r.h, r.p, r.r, r.v) == plain(odd[r.page_id]), odd[r.page_id]


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.range(400).select(
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("http://pills-"), F.col("id"), F.lit("x9x8x7.biz/p?a=1&b=2&c=3"))).otherwise(
            F.concat(F.lit("https://news"), F.col("id"), F.lit(".org/world/story"))).alias("url"),
        F.when(F.col("id") % 2 == 0, "block").otherwise("allow").alias("verdict"))


def test_trees_learn_the_wording(spark, labelled):
    model = urls.fit(labelled, "url", "verdict")
    new = spark.createDataFrame([(1, "http://pills-777x1x2x3.biz/q?z=1&y=2&x=3", "h"), (2, "https://newsday.org/world/tale", "h"), (3, None, "h")], "page_id int, url string, host string")
    p = {r.page_id: r.p_block for r in model.judge(new, ["page_id"], "url").collect()}
    assert p[1] > 0.5 > p[2] and 0 <= p[3] <= 1


def test_one_verdict_or_no_rows(spark, labelled):
    only = urls.fit(labelled.filter("verdict = 'block'"), "url", "verdict")
    none = urls.fit(labelled.limit(0), "url", "verdict")
    df = spark.createDataFrame([(1, "http://a.b/")] * 2, "page_id int, url string")
    assert [r.p_block for r in only.judge(df, ["page_id"], "url").collect()] == [1.0, 1.0]
    assert [r.p_block for r in none.judge(df, ["page_id"], "url").collect()] == [0.0, 0.0]
    assert none.judge(df.limit(0), ["page_id"], "url").collect() == []
