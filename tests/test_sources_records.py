"""Sitemaps (S2-S4), fetched-page routing (S1), record operators."""

from pyspark.sql import functions as F

from sitelens.operators import records as RQ
from sitelens.sources import pages as P
from sitelens.sources import sitemaps as SM

SITEMAP = ('<?xml version="1.0"?><urlset xmlns:image="x"><url><loc> https://a.com/p1 </loc>'
           '<image:image><image:loc>https://a.com/i.png</image:loc></image:image></url>'
           '<url><loc>https://a.com/q?x=1&amp;y=2</loc></url><url><loc>https://b.com/z</loc></url></urlset>')


def test_sitemap_locs_same_host_and_broken(spark):
    df = spark.createDataFrame([("a.com", "https://a.com/", "https://a.com/sitemap.xml", SITEMAP),
                                ("c.com", "https://c.com/", "https://c.com/sitemap.xml", SITEMAP[:80])],
                               "site string, base_url string, sitemap_url string, xml string")
    got = SM.sitemap_urls(df).orderBy("site", "pos").collect()
    assert [(r["site"], r["url"]) for r in got] == [("a.com", "https://a.com/p1"), ("a.com", "https://a.com/i.png"),
                                                    ("a.com", "https://a.com/q?x=1&y=2")]


def test_discovery_precedence(spark):
    starts = spark.createDataFrame([("a", "https://a.com/"), ("b", "https://b.com/")], "site string, url string")
    sm = spark.createDataFrame([("a", "https://a.com/x", 0, "https://a.com/x1"), ("a", "https://a.com/x", 1, "https://a.com/")],
                               "site string, sitemap_url string, pos int, url string")
    ix = spark.createDataFrame([("b", 0, 0, "https://b.com/i1")], "site string, ipos int, pos int, url string")
    links = spark.createDataFrame([("a", 0, "https://a.com/l1"), ("b", 0, "https://b.com/l1")], "site string, pos int, url string")
    out = {(r["site"], r["url"]): r["src"] for r in SM.discover_urls(starts, sm, ix, links).collect()}
    assert out == {("a", "https://a.com/"): 0, ("a", "https://a.com/x1"): 1, ("b", "https://b.com/"): 0,
                   ("b", "https://b.com/i1"): 2}


def test_read_fetched_pages_routing(spark):
    rows = [("https://a.com/1", "<title>T</title><article>hi</article>", 200, "text/html"),
            ("https://a.com/2", "plain body", 200, "text/plain; charset=utf-8"),
            ("https://a.com/3", "<p>x</p>", 404, "text/html"),
            ("https://a.com/4", "<article>z</article>", None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, body string, status int, content_type string")
    got = {r["url"]: r for r in P.read_fetched_pages(df).collect()}
    assert {r["ord"] for r in got.values()} == {0, 1, 3}
    assert set(got) == {"https://a.com/1", "https://a.com/2", "https://a.com/4"}
    assert got["https://a.com/1"]["title"] == "T" and got["https://a.com/2"]["content"] == "plain body"
    assert got["https://a.com/2"]["title"] is None and got["https://a.com/4"]["content"] == "z"


def test_dedupe_urls_and_merge_pages(spark):
    df = spark.createDataFrame([(2, "https://a.com/x/"), (1, "https://a.com/x#f"), (3, "https://a.com/y")],
                               "ord long, url string")
    assert sorted(r["ord"] for r in RQ.dedupe_urls(df).collect()) == [1, 3]
    prev = spark.createDataFrame([("p", "a", "A1"), ("p", "b", "B1")], "package string, slug string, title string")
    full = spark.createDataFrame([("p", "a", "A2")], "package string, slug string, title string")
    got = {r["slug"]: r["title"] for r in RQ.merge_pages(prev, full).collect()}
    assert got == {"a": "A2", "b": "B1"}


def test_unique_slugs_and_upsert(spark):
    jobs = spark.createDataFrame([("Acme Docs!", "x@a.com", 1), ("acme docs", "x@a.com", 2), ("ACME-docs", "y@b.com", 3)],
                                 "name string, email string, created_at long")
    slugs = [r["slug"] for r in RQ.unique_slugs(jobs).orderBy("created_at").collect()]
    assert slugs[0] == slugs[1] == "acme-docs" and slugs[2].startswith("acme-docs-") and len(slugs[2]) == 16
    target = spark.createDataFrame([("a", "old", "keep")], "slug string, title string, status string")
    seeds = spark.createDataFrame([("a", "new"), ("b", "fresh")], "slug string, title string")
    got = {r["slug"]: (r["title"], r["status"]) for r in RQ.upsert_by_slug(target, seeds, ["title"]).collect()}
    assert got == {"a": ("new", "keep"), "b": ("fresh", None)}


def test_list_queries_borderline_inclusive(spark):
    df = spark.createDataFrame([(1, i, f"q{i}", c, True) for i, c in enumerate([0.39, 0.4, 0.5, 0.6, 0.61])],
                               "analysis_id long, line int, query_text string, confidence double, passed boolean")
    got = RQ.list_queries(df, status="borderline").orderBy("position").collect()
    assert [r["confidence"] for r in got] == [0.4, 0.5, 0.6] and [r["position"] for r in got] == [1, 2, 3]
