"""Sitemaps and URL discovery (S2-S4) over already-fetched documents.

Spark's XML parser decides what is well formed: ``from_xml`` in permissive mode
puts what it can't parse into the corrupt-record column (``xpath`` would fail the
job), and a broken sitemap simply yields no URLs.  It stops at the end of the
root element, so that nothing but white space and comments follows it is looked
up in the text.  Every element of a good document whose local name ends in
``loc`` (``loc``, ``image:loc``, at any depth) contributes its own text, from
character data and CDATA sections; comments, processing instructions and the
insides of CDATA sections hold no elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..functions.entities import unescape_text

MISC = r"<!--[\s\S]*?-->|<\?[\s\S]*?\?>"
CDATA = r"<!\[CDATA\[[\s\S]*?\]\]>"
LOC = r"<(?:[\w.\-]+:)?[\w.\-]*loc(?:\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*)?(?<!/)>"
PIECES = rf"(?U)(?:{MISC}|{CDATA}|{LOC}(?:[^<]++|{CDATA}|{MISC})*+)"
ROOT = r"(?U)^(?:\s|<\?[\s\S]*?\?>|<!--[\s\S]*?-->|<![A-Za-z][^>\[]*(?:\[[^\]]*\]\s*)?>)*<([^\s/>]+)"
CORRUPT = "corrupt_record"


def well_formed(xml: Column) -> Column:
    parsed = F.from_xml(xml, f"{CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    end = F.regexp_replace(xml, rf"(?:\s|{MISC})+$", "")
    root = F.regexp_extract(xml, ROOT, 1)
    closed = F.regexp_replace(F.regexp_extract(end, r"</([^>]*)>$", 1), r"\s+$", "") == root
    alone = end.endswith("/>") & (F.size(F.regexp_extract_all(end, F.lit(rf"{MISC}|<[^!?]"), F.lit(0))) - F.size(F.regexp_extract_all(end, F.lit(MISC), F.lit(0))) == 1)
    return F.coalesce(parsed[CORRUPT].isNull() & (root != "") & (closed | alone), F.lit(False))


def _own_text(piece: Column) -> Column:
    parts = F.regexp_extract_all(F.regexp_replace(piece, rf"(?U)^{LOC}", ""), F.lit(rf"{MISC}|{CDATA}|[^<]+"), F.lit(0))
    plain = lambda x: (F.when(x.startswith("<![CDATA["), F.substring(x, F.lit(10), F.length(x) - 12)).when(x.startswith("<"), "")
                       .otherwise(unescape_text(x)))
    return F.regexp_replace(F.array_join(F.transform(parts, plain), ""), r"^(?U)\s+|(?U)\s+$", "")


def loc_values(xml: Column) -> Column:
    """All ``*loc`` element texts of a well-formed document, in document order; [] otherwise."""
    pieces = F.filter(F.regexp_extract_all(T.nz(xml), F.lit(PIECES), F.lit(0)), lambda x: ~x.startswith("<!") & ~x.startswith("<?"))
    return F.when(well_formed(T.nz(xml)), F.transform(pieces, _own_text)).otherwise(F.array().cast("array<string>"))


def sitemap_urls(sitemaps: DataFrame, base_col: str = "base_url") -> DataFrame:
    """(site, base_url, sitemap_url, xml) → (site, pos, url) for same-host locs (duplicates kept)."""
    ex = sitemaps.select("site", base_col, F.col("sitemap_url"),
                         F.posexplode_outer(loc_values(F.col("xml"))).alias("pos", "url")).where("pos IS NOT NULL")
    return ex.where(U.same_host(F.col("url"), F.col(base_col))).select("site", "sitemap_url", "pos", "url")


def sitemap_index_urls(index: DataFrame, sitemaps: DataFrame, base_col: str = "base_url") -> DataFrame:
    """S3: index locs → fetched child sitemaps (joined on URL) → same-host page locs."""
    children = index.select("site", base_col, F.posexplode_outer(loc_values(F.col("xml"))).alias("ipos", "sitemap_url")) \
        .where("ipos IS NOT NULL")
    fetched = sitemaps.select("sitemap_url", F.col("xml").alias("child_xml"))
    j = children.join(fetched, "sitemap_url")
    ex = j.select("site", base_col, "ipos", "sitemap_url",
                  F.posexplode_outer(loc_values(F.col("child_xml"))).alias("pos", "url")).where("pos IS NOT NULL")
    return ex.where(U.same_host(F.col("url"), F.col(base_col))).select("site", "ipos", "pos", "url")


def start_page_links(start_pages: DataFrame, limit: int | None = None) -> DataFrame:
    """S4 fallback: same-host, crawlable links of the start page, in page order (the first ``limit`` where a bound is given)."""
    numbered = F.transform(F.col("link_refs"), lambda l, i: F.struct(i.alias("pos"), l["href"].alias("href")))
    links = F.filter(numbered, lambda l: U.same_host(l["href"], F.col("url")) & U.valid_path(l["href"]))
    links = links if limit is None else F.slice(links, 1, limit)
    return start_pages.select("site", F.explode_outer(links).alias("l")).where("l IS NOT NULL").select("site", "l.pos", F.col("l.href").alias("url"))


def discover_urls(starts: DataFrame, from_sitemap: DataFrame, from_index: DataFrame,
                  from_links: DataFrame) -> DataFrame:
    """Per site, the first non-empty source among sitemap → index → start-page
    links; the start URL is put first when missing; one row per URL at its first
    position.  Output (site, url, src, grp, pos); order by (site, grp, pos)."""
    def tag(df, src, grp):
        return df.select("site", "url", F.lit(src).alias("src"),
                         F.struct(grp.alias("grp"), F.col("pos").cast("long").alias("pos")).alias("k"))
    tagged = (tag(from_sitemap, 1, F.lit(0).cast("long"))
              .unionByName(tag(from_index, 2, F.col("ipos").cast("long")))
              .unionByName(tag(from_links, 3, F.lit(0).cast("long"))))
    chosen = tagged.groupBy("site").agg(F.min("src").alias("src"))
    picked = tagged.join(chosen, ["site", "src"])
    start = starts.select("site", "url", F.lit(0).alias("src"),
                          F.struct(F.lit(-1).cast("long").alias("grp"), F.lit(-1).cast("long").alias("pos")).alias("k"))
    first = picked.unionByName(start).groupBy("site", "url").agg(F.min(F.struct("k", "src")).alias("m"))
    return first.select("site", "url", F.col("m.src").alias("src"), F.col("m.k.grp").alias("grp"),
                        F.col("m.k.pos").alias("pos"))
