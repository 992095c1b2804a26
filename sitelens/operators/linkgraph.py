"""Link graph: edges, breadth-first reachability and the crawl frontier.

Breadth-first order without a queue: a page discovered at depth ``d`` gets
the path of link positions that led to it (``[p1, …, pd]``); first-in
first-out visiting order is then ``(depth, path)`` in lexicographic order,
and a page reached from several parents keeps its smallest path, which is
the first time a FIFO crawl would have queued it.

A round works on what its frontier touches.  The link table is bucketed by
(site, url) once, so a wide round shuffles the frontier to it and not the
links; the few pages of a narrow round (a long chain) are looked up by their
keys, by which each bucket is sorted.  Visited pages are kept in written runs
that are merged when one has caught up with the one before, so there are at
most some log(pages) of them and a page is rewritten as often.  A site with a
third of the pages is spread over many buckets; where links meet the one start
URL of their site, starts are copied to ``SALTS`` parts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import delete, scratch_path, stored

SALTS = 32
#: Rows of a frontier that are looked up by literal keys (8 bytes each).
FEW_KEYS = 500


def ordered_links(pages: DataFrame) -> DataFrame:
    """(site, src, pos, dst): the page's links in document order, normalized.

    Uses ``link_refs`` (all links of the page with text) when present, else ``links``.
    """
    col = "link_refs" if "link_refs" in pages.columns else "links"
    href = F.col("l.href") if col == "link_refs" else F.col("l")
    ex = pages.select("site", U.normalize_url("url").alias("src"), F.posexplode_outer(col).alias("pos", "l")) \
        .where("pos IS NOT NULL")
    return ex.select("site", "src", "pos", U.normalize_url(href).alias("dst")).where(F.col("dst").isNotNull())


def link_edges(pages: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """G1: distinct (site, src, dst), same host as the source, inside the scope.

    ``start`` (site, url) restricts targets to the start URL's path prefix;
    without it the scope is the whole host.
    """
    links = ordered_links(pages)
    same = links.where(U.same_host("dst", "src"))
    if start is not None:
        same = _in_scope(same, start)
    return same.select("site", "src", "dst").distinct()


def _in_scope(links: DataFrame, starts: DataFrame) -> DataFrame:
    """Links whose target is in the scope of their site's start; a big site's links stay spread."""
    salted = starts.select(F.col("site").alias("_site"), F.col("url").alias("_start"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_part"))
    part = F.pmod(F.xxhash64("src"), F.lit(SALTS)).cast("int")
    joined = links.withColumn("_salt", part).join(salted, (F.col("site") == F.col("_site")) & (F.col("_salt") == F.col("_part")))
    return joined.where(U.in_scope("dst", "_start")).select(*links.columns)


def default_starts(pages: DataFrame) -> DataFrame:
    """Start URL per site: the page with the smallest ``ord`` (partial-aggregated min, no window)."""
    first = pages.groupBy("site").agg(F.min(F.struct("ord", "url")).alias("m"))
    return first.select("site", F.col("m.url").alias("url"))


def reachable(pages: DataFrame, starts: DataFrame | None = None, min_chars: int = 50) -> DataFrame:
    """Pages reachable from the start URL of each site, in breadth-first order.

    Output (site, url, depth, path): only fetched pages whose stripped content
    is longer than ``min_chars`` are returned; shorter pages and unfetched
    URLs are visited (their links followed or not) but not returned.  Order
    by (site, depth, path) for the crawl order.  Rounds go on until one finds
    nothing new, at any depth.
    """
    starts = starts if starts is not None else default_starts(pages)
    starts = starts.select("site", U.normalize_url("url").alias("url"))
    fetched = pages.select("site", U.normalize_url("url").alias("url"),
                           (F.length(F.regexp_replace(F.coalesce("content", F.lit("")), r"^(?U)\s+|(?U)\s+$", ""))
                            > min_chars).alias("substantial")).groupBy("site", "url").agg(F.max("substantial").alias("substantial"))
    fetched = stored(fetched, "fetched")
    links = _in_scope(ordered_links(pages), starts).groupBy("site", "src", "dst").agg(F.min("pos").alias("pos"))
    links = links.withColumnRenamed("src", "url").join(fetched.select("site", "url"), ["site", "url"])  # only fetched pages expand
    with Bucketed(links, "links") as table:
        visited = Runs()
        frontier = stored(starts.select(_key().alias("key"), "site", "url", F.lit(0).alias("depth"), F.array().cast("array<int>").alias("path")), "reached")
        depth = 0
        while True:
            keys = _few_keys(frontier)
            if keys == []:
                break
            visited.add(frontier)
            depth += 1
            found = stored(next_round(frontier, table.rows, keys), "found")
            frontier = stored(visited.without(found, _few_keys(found)).withColumn("depth", F.lit(depth)).select("key", "site", "url", "depth", "path"), "reached")
    return visited.rows().join(fetched.where("substantial").select("site", "url"), ["site", "url"]).select("site", "url", "depth", "path")


def _key() -> Column:
    return F.xxhash64("site", "url")


def _few_keys(rows: DataFrame) -> list[int] | None:
    """The distinct keys of at most ``FEW_KEYS`` rows; None for more."""
    keys = [r.key for r in rows.select("key").distinct().limit(FEW_KEYS + 1).collect()]
    return keys if len(keys) <= FEW_KEYS else None


def next_round(frontier: DataFrame, links: DataFrame, keys: list[int] | None) -> DataFrame:
    """key, site, url, path of what the frontier links to, each page by its smallest path."""
    if keys is None:
        found = links.join(frontier.select("site", "url", "path").hint("shuffle_hash"), ["site", "url"])
    else:
        found = links.where(F.col("key").isin(keys)).join(F.broadcast(frontier.select("site", "url", "path")), ["site", "url"])
    found = found.select("site", F.col("dst").alias("url"), F.concat("path", F.array(F.col("pos").cast("int"))).alias("path"))
    return found.groupBy("site", "url").agg(F.min("path").alias("path")).select(_key().alias("key"), "site", "url", "path")


class Bucketed:
    """A table bucketed by (site, url), each bucket sorted by key; dropped at the end of the block."""

    def __init__(self, rows: DataFrame, name: str):
        self.spark, self.name = rows.sparkSession, f"sitelens_{name}_{uuid.uuid4().hex}"
        self.path = scratch_path(self.spark, name)
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        (rows.withColumn("key", _key()).repartition(buckets, "site", "url").write.bucketBy(buckets, "site", "url").sortBy("key")
         .option("path", self.path).saveAsTable(self.name))
        self.rows = self.spark.table(self.name)

    def __enter__(self) -> Bucketed:
        return self

    def __exit__(self, *_) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        delete(self.spark, self.path)


class Runs:
    """Visited pages as written tables, each more than twice as large as the next."""

    def __init__(self):
        self.runs: list[tuple[int, DataFrame]] = []

    def add(self, rows: DataFrame) -> None:
        size, merged = rows.count(), [rows]
        while self.runs and self.runs[-1][0] <= 2 * size:
            more, run = self.runs.pop()
            size += more
            merged.append(run)
        if len(merged) > 1:
            whole = merged[0]
            for run in merged[1:]:
                whole = whole.unionByName(run)
            rows = stored(whole.sortWithinPartitions("key"), "visited")
        self.runs.append((size, rows))

    def rows(self) -> DataFrame:
        whole = self.runs[0][1]
        for _, run in self.runs[1:]:
            whole = whole.unionByName(run)
        return whole

    def without(self, found: DataFrame, keys: list[int] | None) -> DataFrame:
        """The rows of ``found`` that are not visited."""
        known = self.rows() if keys is None else self.rows().where(F.col("key").isin(keys))
        return found.join(known.select("site", "url"), ["site", "url"], "left_anti")


def crawl_rank(reached: DataFrame) -> DataFrame:
    """Dense crawl position per site (1-based) from (depth, path).

    This is a per-site sort; use it for reports on bounded sites, and the
    (depth, path) order key for whole-corpus work.
    """
    w = Window.partitionBy("site").orderBy("depth", "path")
    return reached.withColumn("rank", F.row_number().over(w))


def frontier(pages: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """In-scope link targets that are not fetched pages (site, url)."""
    starts = starts if starts is not None else default_starts(pages)
    edges = link_edges(pages, starts)
    known = pages.select("site", U.normalize_url("url").alias("url"))
    return edges.select("site", F.col("dst").alias("url")).distinct().join(known, ["site", "url"], "left_anti")
