"""Sitemap texts against the standard library's XML parser."""

import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from sitelens.sources.sitemaps import loc_values

NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:image="http://www.google.com/schemas/sitemap-image/1.1"'
GOOD = [
    f'<?xml version="1.0" encoding="UTF-8"?>\n<urlset {NS}><url><loc> https://a/1 </loc><image:image><image:loc>https://a/i.png</image:loc></image:image></url><url><loc>https://a/2?x=1&amp;y=&#50;</loc></url></urlset>\n',
    f"<sitemapindex {NS}><sitemap><loc><![CDATA[https://a/s.xml?a=1&b=2]]></loc><lastmod>x</lastmod></sitemap></sitemapindex><!-- end -->\n<?done?>",
    "  <s:urlset xmlns:s='u'><s:url><s:loc\n a='>' b=\"2\">https://a/3</s:loc ></s:url></s:urlset >",
    "<u><!-- <loc>no</loc> --><loc>https://a/4<!-- in --></loc><x><![CDATA[<loc>no</loc>]]></x><?p <loc>no</loc>?></u>",
    "<u><loc/><loc></loc><geoloc>https://a/5</geoloc><location>no</location><LOC>no</LOC></u>",
    "<u><loc>https://a/&#x36;<b>child</b>tail</loc><deep><er><loc>\n https://a/7\t</loc></er></deep></u>",
    "<!DOCTYPE u><u><loc>https://a/8</loc></u>", "<loc>https://a/root</loc>", "<u/>", "<!-- only --><u a='1'/>", "<ü><loc>https://a/é</loc></ü>",
]
BAD = ["", " ", "not xml", "<u><loc>x</loc>", "<u><loc>x</u></loc>", "<u>a & b<loc>x</loc></u>", "<u><loc>x</loc></u>trailing", "<u><loc>x</loc></u><v></v>",
       "lead<u><loc>x</loc></u>", "<u a=b><loc>x</loc></u>", "<u a='1' a='2'><loc>x</loc></u>", "<u>&nosuch;<loc>x</loc></u>", "<!DOCTYPE html><html><body><loc>x</body></html>",
       "\n<?xml version='1.0'?><u><loc>x</loc></u>", "<u>\x00<loc>x</loc></u>", "<u/><u/>", "<u><loc>x</loc></u", None]


def by_the_library(xml):
    try:
        root = ET.fromstring(xml)
    except (ET.ParseError, TypeError, ValueError):
        return []
    return [(e.text or "").strip() for e in root.iter() if e.tag.endswith("loc")]


def test_locs_as_the_library_reads_them(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(GOOD + BAD)], "i int, x string")
    got = {r.i: r.urls for r in df.select("i", loc_values(F.col("x")).alias("urls")).collect()}
    for i, x in enumerate(GOOD + BAD):
        assert [u for u in got[i] if u] == [u for u in by_the_library(x) if u], x
    assert all(by_the_library(x) for x in GOOD[:8]) and not any(map(by_the_library, BAD))


def test_a_large_sitemap(spark):
    xml = "<urlset>" + "".join(f"<url><loc>https://a/{i}</loc></url>" for i in range(50_000)) + "</urlset>"
    df = spark.createDataFrame([(xml,), (xml[:-4],)], "x string")
    assert [r.n for r in df.select(F.size(loc_values(F.col("x"))).alias("n")).collect()] == [50_000, 0]
