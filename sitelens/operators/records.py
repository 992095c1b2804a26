"""Record queries over the application tables.

These are the filtered / joined / paginated reads that the original serves
one request at a time.  Here every operator works on whole tables; listing
operators rank inside their partition key (org, analysis) so one call answers
every user at once.  ``row_number() <= k`` filters let Spark cut each key to
k rows map-side (WindowGroupLimit) before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..functions import urls as U
from ..versions import State
from .ranking import paged, ranked

BORDERLINE = (0.4, 0.6)
# FIXED VALUES - job states from which a run may be started again, promotion codes and prices
RETRYABLE = ["failed", "submitted", "crawling", "generating"]
FREE_CODES, DISCOUNT_CODES = ["FREE100"], ["AGENT2025", "LAUNCH2025", "BETA2025"]
FREE_PRICE, DISCOUNT_PRICE = 0, 1


# --- F: listings --------------------------------------------------------------

def list_sites(sites: DataFrame) -> DataFrame:
    """sites per organization, newest (largest id) first, with position (an organization may hold any share)."""
    return ranked(sites, "organization_id", [F.col("id").desc()])


def search_sites(sites: DataFrame, text: str) -> DataFrame:
    """case-insensitive substring of name or url."""
    t = text.lower()
    return sites.where(F.lower(T.nz("name")).contains(t) | F.lower(T.nz("url")).contains(t))


def list_analyses(analyses: DataFrame, sites: DataFrame, site_id=None, status: str | None = None,
                  limit: int = 20, offset: int = 0) -> DataFrame:
    """Analyses of each organization's sites, newest first, paginated per organization."""
    a = analyses
    if site_id is not None:
        a = a.where(F.col("site_id") == site_id)
    if status is not None:
        a = a.where(F.col("status") == status)
    owned = a.join(sites.select(F.col("id").alias("site_id"), "organization_id"), "site_id")
    return paged(owned, "organization_id", [F.col("created_at").desc(), F.col("id").desc()], offset, limit)


def filter_queries(results: DataFrame, category: str | None = None, difficulty: str | None = None,
                   status: str | None = None) -> DataFrame:
    """F4 filters: pass / fail / borderline (confidence between .4 and .6 inclusive)."""
    r = results
    if category is not None:
        r = r.where(F.col("category") == category)
    if difficulty is not None:
        r = r.where(F.col("difficulty") == difficulty)
    if status == "pass":
        r = r.where(F.col("passed"))
    elif status == "fail":
        r = r.where(~F.col("passed"))
    elif status == "borderline":
        r = r.where(F.col("confidence").between(*BORDERLINE))
    return r


def list_queries(results: DataFrame, page: int = 1, limit: int = 50, **filters) -> DataFrame:
    """filtered query results, paginated per analysis (order: line, query text)."""
    r = filter_queries(results, **filters)
    return paged(r, "analysis_id", [F.col("line"), F.col("query_text")], (page - 1) * limit, limit)


def export_query_results(results: DataFrame, category: str | None = None, status: str | None = None) -> DataFrame:
    """The six exported fields (only pass / fail filters) plus the per-analysis count."""
    r = filter_queries(results, category=category, status=status if status in ("pass", "fail") else None)
    counts = r.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("count"))
    data = r.select("analysis_id", F.concat_ws("-", F.col("analysis_id").cast("string"), F.col("line").cast("string")).alias("id"),
                    "query_text", "category", "difficulty", "passed", "confidence")
    return data.join(counts, "analysis_id").withColumn("format", F.lit("json"))


def write_export(results: DataFrame, path: str) -> None:
    """S8 sink: JSON lines (format, count and the six fields on every row),
    range-partitioned and sorted by analysis (files follow the data, not the number of analyses)."""
    export_query_results(results).repartitionByRange("analysis_id", "id").sortWithinPartitions("analysis_id", "id").write.mode("overwrite").json(path)


def list_recommendations(recs: DataFrame, category: str | None = None, impact: str | None = None,
                         status: str | None = None) -> DataFrame:
    """recommendations filtered, ordered by priority within the site."""
    r = recs
    for col, v in (("category", category), ("impact", impact), ("implementation_status", status)):
        if v is not None:
            r = r.where(F.col(col) == v)
    return ranked(r, "site_id", [F.col("priority"), F.col("id")])


def public_gallery(assessments: DataFrame, seeds: DataFrame | None = None, limit: int = 24) -> DataFrame:
    """Paid and complete assessments, newest ``limit``; seed rows first."""
    paid = assessments.where((F.col("payment_status") == "paid") & (F.col("optimization_status") == "complete"))
    top = paid.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)
    rows = top.select("id", "site_name", "score", "grade", F.coalesce(F.size("optimization_docs"), F.lit(0)).alias("page_count"),
                      "created_at", F.lit(1).alias("src"))
    if seeds is not None:
        rows = seeds.select("id", "site_name", "score", "grade", "page_count", "created_at",
                            F.lit(0).alias("src")).unionByName(rows)
    return rows


def ready_packages(packages: DataFrame, states=("preview_ready", "full_ready")) -> DataFrame:
    """packages in a ready state, page_count = size(page_map); order by (created_at, id) for oldest first."""
    return packages.where(F.col("status").isin(*states)).select(
        "*", F.coalesce(F.size("page_map"), F.lit(0)).alias("page_count"))


def viewer_index(assessments: DataFrame, rewrites: DataFrame) -> DataFrame:
    """F8: rewritten docs of paid and complete assessments (semi-join by site)."""
    ok = assessments.where((F.col("payment_status") == "paid") & (F.col("optimization_status") == "complete"))
    return rewrites.join(ok.select("site"), "site", "left_semi")


def viewer_page(index: DataFrame) -> DataFrame:
    """F8: the first document (crawl order) per (site, file_name)."""
    w = Window.partitionBy("site", "file_name").orderBy("ord")
    return index.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def entitled_pages(packages: DataFrame) -> DataFrame:
    """paid & full → full pages, else preview pages; full-tier pages without payment are locked."""
    paid_full = (F.col("payment_status") == "paid") & F.col("full_pages").isNotNull()
    pages = F.when(paid_full, F.col("full_pages")).otherwise(F.col("preview_pages"))
    ex = packages.select("slug", "payment_status", F.explode_outer(F.map_entries(pages)).alias("e"))
    return ex.select("slug", F.col("e.key").alias("page_slug"), F.col("e.value.title").alias("title"),
                     F.col("e.value.tier").alias("tier"),
                     ((F.col("e.value.tier") == "full") & (F.col("payment_status") != "paid")).alias("locked"))


def retryable_assessments(assessments: DataFrame) -> DataFrame:
    """paid assessments whose optimization failed or never ran."""
    return assessments.where((F.col("payment_status") == "paid")
                             & (F.col("optimization_status").isNull() | (F.col("optimization_status") == "failed")))


def ready_agent_pages(agent_pages: DataFrame, states=("full_ready", "draft_ready")) -> DataFrame:
    """agent pages that are ready, numbered oldest first."""
    ready = agent_pages.where(F.col("status").isin(*states)).withColumn("_all", F.lit(0))
    return ranked(ready, "_all", [F.col("created_at"), F.col("id")]).select("position", "product_name", "slug", "status", "payment_status")


def retry(jobs: DataFrame, requests: DataFrame, with_planning: bool = False) -> DataFrame:
    """a request (slug, email, docs_url) by a job's owner sets a retryable job back to
    'submitted', clears its error and takes the new docs URL; all other jobs stay as they are."""
    r = requests.groupBy(F.col("slug").alias("r_slug"), F.col("email").alias("r_email")).agg(F.min("docs_url").alias("r_url"))
    j = jobs.join(r, (F.col("slug") == F.col("r_slug")) & (F.col("email") == F.col("r_email")), "left")
    states = RETRYABLE + (["planning"] if with_planning else [])
    again = F.col("r_slug").isNotNull() & F.col("status").isin(*states)
    new = {"status": F.lit("submitted"), "error_message": F.lit(None).cast("string"), "docs_url": F.col("r_url")}
    return j.select(*(F.when(again, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns), again.alias("retried"))


def retryable_jobs(jobs: DataFrame, with_planning: bool = False) -> DataFrame:
    """agent-page / package jobs in a retryable state (packages also 'planning')."""
    states = RETRYABLE + (["planning"] if with_planning else [])
    return jobs.where(F.col("status").isin(*states))


def cascade_delete(deleted_sites: DataFrame, analyses: DataFrame, recs: DataFrame, results: DataFrame):
    """Remove a site's analyses and recommendations, and the analyses' results."""
    keep_a = analyses.join(deleted_sites.select(F.col("id").alias("site_id")), "site_id", "left_anti")
    keep_r = recs.join(deleted_sites.select(F.col("id").alias("site_id")), "site_id", "left_anti")
    gone = analyses.join(deleted_sites.select(F.col("id").alias("site_id")), "site_id", "left_semi")
    keep_q = results.join(gone.select(F.col("id").alias("analysis_id")), "analysis_id", "left_anti")
    return keep_a, keep_r, keep_q


def org_query_results(results: DataFrame, analyses: DataFrame, sites: DataFrame, orgs: DataFrame) -> DataFrame:
    """Query → analysis → site → organization (3-way inner equi-join)."""
    a = analyses.select(F.col("id").alias("analysis_id"), "site_id")
    s = sites.select(F.col("id").alias("site_id"), "organization_id")
    o = orgs.select(F.col("id").alias("organization_id"), F.col("name").alias("organization"))
    return results.join(a, "analysis_id").join(s, "site_id").join(o, "organization_id")


def user_organizations(users: DataFrame, orgs: DataFrame) -> DataFrame:
    """User → organization lookup (left join)."""
    o = orgs.select(F.col("id").alias("organization_id"), F.col("name").alias("organization"),
                                    "tier")
    return users.join(o, "organization_id", "left")


# --- U: merges and dedupes ------------------------------------------------------

def dedupe_urls(df: DataFrame, url_col: str = "url") -> DataFrame:
    """One row per normalized URL (first by ``ord`` when present)."""
    d = df.withColumn("_norm", U.normalize_url(url_col)).where(F.col("_norm").isNotNull())
    order = F.struct(*(["ord"] if "ord" in df.columns else []), url_col)
    return d.groupBy("_norm").agg(F.min_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def merge_pages(preview: DataFrame, full: DataFrame, key: str = "slug") -> DataFrame:
    """Union of preview and full pages; the full version wins on the same key."""
    both = preview.withColumn("_prio", F.lit(1)).unionByName(full.withColumn("_prio", F.lit(0)))
    w = Window.partitionBy("package", key).orderBy("_prio")
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_prio")


# FIXED VALUES — pages every package must have, in insertion order
MANDATORY_PAGES = [("overview", "Overview", "overview"), ("agents", "For AI Agents", "agents"),
                   ("getting-started", "Getting Started", "getting-started")]


def ensure_mandatory_pages(page_map: DataFrame) -> DataFrame:
    """U4: add missing mandatory page types at the front (each inserted at 0 → reversed order)."""
    req = F.array(*[F.struct(F.lit(t).alias("page_type"), F.lit(title).alias("title"), F.lit(slug).alias("slug"),
                             F.lit(-i).alias("ord")) for i, (t, title, slug) in enumerate(MANDATORY_PAGES)])
    have = page_map.select("package", "page_type").distinct()
    # every package × the three mandatory types, by exploding a constant array (no join)
    wanted = page_map.select("package").distinct().select("package", F.explode(req).alias("r")).select("package", "r.*")
    missing = wanted.join(have, ["package", "page_type"], "left_anti")
    # a later mandatory page is inserted before an earlier one: ord = -position
    missing = missing.select("package", "page_type", "title", "slug", F.lit("preview").alias("tier"),
                             (F.col("ord") - len(MANDATORY_PAGES)).alias("ord"))
    return page_map.select("package", "page_type", "title", "slug", "tier", "ord").unionByName(missing)


def ordered_distinct_links(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Links of each page (the first ``limit`` where a bound is given), first occurrence per
    link text wins; empty, '#' and javascript: hrefs become UNRESOLVED.  Array functions of one row."""
    links = F.col("link_refs") if limit is None else F.slice("link_refs", 1, limit)
    named = F.filter(F.transform(links, lambda l, i: F.struct(i.alias("pos"), F.trim(l["text"]).alias("text"), F.trim(l["href"]).alias("href"))),
                     lambda l: l["text"] != "")
    # the smallest position per text: sorted by (text, pos), an entry stays if the one before has another text
    rows = pages.select("site", "ord", F.inline_outer(F.array(F.struct(F.array_sort(F.transform(
        named, lambda l: F.struct(l["text"].alias("text"), l["pos"].alias("pos"), l["href"].alias("href")))).alias("l")))))
    first = F.filter("l", lambda x, k: (k == 0) | (F.col("l")[F.greatest(k - 1, F.lit(0))]["text"] != x["text"]))
    ex = rows.select("site", "ord", F.explode_outer(first).alias("x")).where("x IS NOT NULL").select("site", "ord", "x.pos", "x.text", "x.href")
    bad = (F.col("href") == "") | (F.col("href") == "#") | F.col("href").startswith("javascript:")
    return ex.select("site", "ord", "pos", "text", F.when(bad, "UNRESOLVED").otherwise(F.col("href")).alias("target"))


def upsert_by_slug(target: DataFrame, seeds: DataFrame, content_cols: list[str]) -> DataFrame:
    """Insert new slugs, refresh ``content_cols`` of existing ones, keep other columns."""
    t = target.alias("t")
    s = seeds.alias("s")
    j = t.join(s, F.col("t.slug") == F.col("s.slug"), "full_outer")
    cols = [F.coalesce(F.col("t.slug"), F.col("s.slug")).alias("slug")]
    for c in target.columns:
        if c == "slug":
            continue
        if c in content_cols and c in seeds.columns:
            cols.append(F.when(F.col("s.slug").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
        elif c in seeds.columns:
            cols.append(F.coalesce(F.col(f"t.{c}"), F.col(f"s.{c}")).alias(c))
        else:
            cols.append(F.col(f"t.{c}").alias(c))
    return j.select(*cols)


class SlugTable:
    """S11 on a stored table: rows by slug in hash buckets; a batch of seeds reads and rewrites the buckets that it touches.

    A batch is visible as a whole or not at all (see ``versions``), and applying
    it twice gives the same table.  Seeds of one batch that share a slug must be
    resolved by the caller, as for ``upsert_by_slug``.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.state, self.spark, self.buckets = State(spark, root), spark, buckets

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64("slug"), F.lit(buckets)).cast("int").cast("string")

    def rows(self) -> DataFrame:
        now = self._now()
        return self.state.read(now, "rows", self._schema(now))

    def touched(self, seeds: DataFrame) -> list[str]:
        """Names of the buckets that seeds fall into (at most as many as there are buckets)."""
        return sorted(r.b for r in seeds.select(self._bucket(self._now()["buckets"]).alias("b")).distinct().collect())

    def _now(self) -> dict:
        now = self.state.current()
        if now is None:
            raise ValueError(f"no table at {self.state.root} yet")
        return now

    @staticmethod
    def _schema(now: dict) -> StructType:
        return StructType.fromJson(now["schema"])

    def create(self, rows: DataFrame) -> None:
        version = (self.state.current() or {"version": 0})["version"] + 1
        self.state.delete(f"data/v{version:012d}")
        self.state.write(rows, version, "rows", self._bucket(self.buckets))
        names = [n[7:] for n in self.state._names(f"data/v{version:012d}/rows") if n.startswith("bucket=")]
        self.state.commit({"version": version, "buckets": self.buckets, "schema": rows.schema.jsonValue(), "tables": {"rows": dict.fromkeys(names, version)}})
        self.state.clean()

    def merge(self, seeds: DataFrame, content_cols: list[str]) -> None:
        now = self._now()
        names = self.touched(seeds)
        if not names:
            return
        version = now["version"] + 1
        self.state.delete(f"data/v{version:012d}")
        merged = upsert_by_slug(self.state.read(now, "rows", self._schema(now), set(names)), seeds, content_cols)
        self.state.write(merged, version, "rows", self._bucket(now["buckets"]))
        self.state.commit(now | {"version": version, "tables": {"rows": now["tables"]["rows"] | dict.fromkeys(names, version)}})
        self.state.clean()


def unique_slugs(jobs: DataFrame) -> DataFrame:
    """Same slug + same email reuses the slug; another email gets a
    deterministic suffix (first 6 hex chars of the e-mail's SHA-256)."""
    base = T.slugify("name")
    first = jobs.withColumn("_slug", base).groupBy("_slug").agg(F.min(F.struct("created_at", "email")).alias("_f"))
    j = jobs.withColumn("_slug", base).join(first, "_slug")
    owner = F.col("_f.email") == F.col("email")
    return j.select(*[c for c in jobs.columns if c != "slug"], F.when(owner, F.col("_slug"))
                    .otherwise(F.concat(F.col("_slug"), F.lit("-"), F.substring(F.sha2(F.col("email"), 256), 1, 6)))
                    .alias("slug"))


def prices(assessments: DataFrame, list_price: int = 84, code_col: str = "promo_code") -> DataFrame:
    """Price after a promotion code (free, 1, or null and ``valid`` false for an unknown one) or the list price."""
    code = F.upper(F.col(code_col))
    known = code.isin(*FREE_CODES, *DISCOUNT_CODES)
    price = F.when(code.isNull(), list_price).when(code.isin(*FREE_CODES), FREE_PRICE).when(code.isin(*DISCOUNT_CODES), DISCOUNT_PRICE)
    return assessments.select("*", price.cast("int").alias("price_eur"), (code.isNull() | known).alias("valid"))


def org_recommendations(recs: DataFrame, sites: DataFrame, orgs: DataFrame) -> DataFrame:
    """Recommendation, its site and the site's organization (inner joins: others have no reader)."""
    s = sites.select(F.col("id").alias("site_id"), "organization_id", F.col("name").alias("site_name"))
    o = orgs.select(F.col("id").alias("organization_id"), F.col("name").alias("organization"))
    return recs.join(s, "site_id").join(o, "organization_id")
