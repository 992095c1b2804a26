"""Query scorer (A8), heuristic page quality signals (A9), recommendations (A10).

A8 is a single ``groupBy(key).agg`` of sums and counts (partial aggregation,
one shuffle); the component and grade formulas are narrow projections of the
aggregate.  Means are rounded to 9 decimals before the bucketing / rounding
steps so that the summation order chosen by the engine cannot move a score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T

# FIXED VALUES — latency buckets (mean latency ms → component value)
LATENCY_BUCKETS = [(1000, 1.0), (3000, 0.8), (5000, 0.6)]
LATENCY_ELSE = 0.4
PASS_ACCURACY = 0.6


def _mean(c: str) -> Column:
    return F.round(F.avg(c), 9)


def score_queries(results: DataFrame, key: str = "analysis_id", keys: DataFrame | None = None) -> DataFrame:
    """Per ``key``: overall 0-100, grade, five components, count, pass rate, mean latency.

    ``keys`` (one column ``key``) adds groups with no results: overall 0, grade F.
    They join the aggregate as rows without values, so results are read and
    shuffled once and nothing is sorted; null keys of either side stay apart.
    """
    groups = [key]
    if keys is None:
        rows = results.withColumn("_result", F.lit(1))
    else:
        values = ["accuracy_score", "retrieval_precision", "citation_accuracy", "latency_ms", "code_valid", "passed"]
        rows = results.select(key, *values, F.lit(1).alias("_result"), F.lit(False).alias("_null_key")).unionByName(
            keys.select(key, *[F.lit(None).cast(results.schema[c].dataType).alias(c) for c in values],
                        F.lit(None).cast("int").alias("_result"), F.col(key).isNull().alias("_null_key")))
        groups.append("_null_key")
    agg = rows.groupBy(*groups).agg(
        F.count("_result").alias("query_count"),
        _mean("accuracy_score").alias("m_acc"), _mean("retrieval_precision").alias("m_prec"),
        _mean("citation_accuracy").alias("m_cit"), F.avg("latency_ms").alias("m_lat"),
        F.sum("latency_ms").alias("s_lat"),
        F.count("code_valid").alias("n_code"), F.sum(F.col("code_valid").cast("int")).alias("n_valid"),
        F.sum(F.col("passed").cast("int")).alias("n_passed"))
    lat = None
    for bound, v in LATENCY_BUCKETS:
        lat = F.when(F.col("m_lat") < bound, F.lit(v)) if lat is None else lat.when(F.col("m_lat") < bound, F.lit(v))
    lat = lat.otherwise(F.lit(LATENCY_ELSE))
    code = F.when(F.col("n_code") == 0, F.lit(1.0)).otherwise(F.col("n_valid") / F.col("n_code"))
    comp = {"accuracy": F.col("m_acc"), "context_utilization": F.col("m_prec"), "latency": lat,
            "citation_quality": F.col("m_cit"), "code_executability": code}
    of = lambda value: value if keys is None else F.when(F.col("query_count") > 0, value).otherwise(0.0)
    comp = {name: of(value) for name, value in comp.items()}
    # summed in the scorer's component order: accuracy, context, latency, citation, code
    composite = None
    weights = dict(K.QUERY_COMPONENTS)
    for name in ["accuracy", "context_utilization", "latency", "citation_quality", "code_executability"]:
        term = comp[name] * F.lit(weights[name])
        composite = term if composite is None else composite + term
    overall = T.half_even(composite * 100)
    return agg.select(
        key, overall.alias("overall"), T.grade(overall).alias("grade"),
        *[T.half_even(comp[n] * 100).alias(n) for n in ["accuracy", "context_utilization", "latency",
                                                       "citation_quality", "code_executability"]],
        "query_count", F.round(of(F.col("n_passed") / F.col("query_count")), 6).alias("pass_rate"),
        F.floor(of(F.col("s_lat") / F.col("query_count"))).cast("long").alias("avg_latency_ms"))


def page_quality_signals(pages: DataFrame) -> DataFrame:
    """One heuristic query result per page (site, ord, url, query, scores)."""
    n = F.length(T.nz("content"))
    has_code = F.size("code_blocks") > 0
    has_heads = F.size("headings") >= 2
    has_links = F.size("links") > 0
    acc = F.least(F.lit(1.0), F.lit(0.5) + (n / 5000) * 0.3 + F.when(has_code, 0.2).otherwise(0.0))
    prec = F.least(F.lit(1.0), F.lit(0.4) + F.when(has_heads, 0.3).otherwise(0.0) + (n / 8000) * 0.3)
    lat = F.least(F.lit(5000), F.lit(800) + F.greatest(F.lit(0), F.floor(n / 10).cast("int")))
    cit = F.least(F.lit(1.0), F.lit(0.7) + F.when(has_heads, 0.2).otherwise(0.0) + F.when(has_links, 0.1).otherwise(0.0))
    return pages.select(
        "site", "ord", "url",
        F.concat(F.lit("Query about: "), F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("url"))).alias("query"),
        (acc > PASS_ACCURACY).alias("passed"), F.round(acc, 9).alias("confidence"), F.round(acc, 9).alias("accuracy_score"),
        F.round(prec, 9).alias("retrieval_precision"), lat.cast("int").alias("latency_ms"),
        F.round(cit, 9).alias("citation_accuracy"), has_code.alias("code_valid"))


# FIXED VALUES — recommendation templates, in emission order
# (component, threshold, impact, effort, category, title, estimated improvement)
RECOMMENDATIONS = [
    ("accuracy", 80, "high", "medium", "content_gap", "Improve content depth and accuracy", 5.0),
    ("code_executability", 80, "high", "low", "code_quality", "Add runnable code examples", 4.0),
    ("context_utilization", 80, "medium", "medium", "structure",
     "Improve documentation hierarchy and cross-linking", 3.0),
    ("citation_quality", 80, "medium", "low", "metadata", "Add descriptive page titles and meta descriptions", 2.0),
]
FALLBACK_RECOMMENDATION = ("low", "low", "optimization", "Fine-tune for perfect agent experience", 1.0)
# FIXED VALUES - descriptions by category
RECOMMENDATION_TEXTS = {
    "content_gap": "Several pages lack sufficient detail for AI agents to generate accurate answers. "
                   "Add more comprehensive explanations, especially for core concepts and API parameters.",
    "code_quality": "Many pages are missing code examples. AI agents perform significantly better "
                    "when documentation includes complete, runnable code snippets.",
    "structure": "The documentation structure makes it difficult for AI agents to locate relevant context. "
                 "Add clear heading hierarchies and cross-references between related topics.",
    "metadata": "Pages lack clear titles and descriptions, making it harder for agents to cite sources accurately. "
                "Add unique, descriptive titles and meta descriptions to every page.",
    "optimization": "Your documentation is already well-optimized. Consider adding more edge-case examples "
                    "and troubleshooting sections to reach a perfect score.",
}
SHORT_PAGE_CHARS, SHORT_PAGE_WINDOW, NO_CODE_PAGES = 500, 3, 5


def first_k(df: DataFrame, key: str, k: int, order: str = "ord") -> DataFrame:
    """First k rows per key by ``order``.

    ``row_number() <= k`` lets Spark insert a partial WindowGroupLimit before
    the shuffle, so at most k rows per (map partition, key) move — a key with
    a third of all rows is cut down map-side.
    """
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def recommendations(scores: DataFrame, pages: DataFrame, key: str = "site") -> DataFrame:
    """A10: per site, one row per component below 80 (fixed order), else one fallback row.

    ``scores`` has ``key`` and the component columns of :func:`score_queries`;
    affected pages come from ``pages`` in crawl order (``ord``): short pages
    among the first three, and the first five pages without code.  Both lists
    are bounded (3 / 5 entries); ``row_number() <= k`` cuts them map-side.
    """
    items = []
    for i, (comp, thr, impact, effort, cat, title, est) in enumerate(RECOMMENDATIONS):
        items.append(F.when(F.col(comp) < thr, F.struct(F.lit(i).alias("slot"), F.lit(impact).alias("impact"),
                                                        F.lit(effort).alias("effort"), F.lit(cat).alias("category"),
                                                        F.lit(title).alias("title"), F.lit(est).alias("estimated_improvement"))))
    emitted = F.filter(F.array(*items), lambda x: x.isNotNull())
    fb_impact, fb_effort, fb_cat, fb_title, fb_est = FALLBACK_RECOMMENDATION
    fallback = F.array(F.struct(F.lit(len(RECOMMENDATIONS)).alias("slot"), F.lit(fb_impact).alias("impact"),
                                F.lit(fb_effort).alias("effort"), F.lit(fb_cat).alias("category"),
                                F.lit(fb_title).alias("title"), F.lit(fb_est).alias("estimated_improvement")))
    recs = F.when(F.size(emitted) == 0, fallback).otherwise(emitted)
    rows = scores.select(key, F.posexplode_outer(recs).alias("pos", "r")).where("pos IS NOT NULL") \
        .select(key, (F.col("pos") + 1).alias("priority"), "r.*")

    page = F.struct("ord", "url", "title")
    short = first_k(pages, key, SHORT_PAGE_WINDOW).where(F.length(T.nz("content")) < SHORT_PAGE_CHARS) \
        .groupBy(key).agg(F.sort_array(F.collect_list(page)).alias("short3"))
    nocode = first_k(pages.where(F.size("code_blocks") == 0), key, NO_CODE_PAGES) \
        .groupBy(key).agg(F.sort_array(F.collect_list(page)).alias("nc"))
    f3 = short
    out = rows.join(f3, key, "left").join(nocode, key, "left")
    affected = (F.when(F.col("category") == "content_gap", F.coalesce("short3", F.array()))
                .when(F.col("category") == "code_quality", F.coalesce("nc", F.array())))
    listed = F.transform(F.coalesce(affected, F.array().cast("array<struct<ord:long,url:string,title:string>>")),
                         lambda p: F.struct(p["url"].alias("url"), p["title"].alias("title")))
    texts = F.create_map(*(F.lit(x) for pair in RECOMMENDATION_TEXTS.items() for x in pair))
    return out.select(key, "priority", "impact", "effort", "category", "title", texts[F.col("category")].alias("description"),
                      "estimated_improvement", listed.alias("affected_pages"))
