"""Site rollups over the rule array: components, overall score, grade,
top issues, status counts, pass rate and the empty-site result.

All of these are narrow projections of the one-row-per-site output of
:func:`sitelens.operators.rules.site_rule_wide`, so the whole site report
costs exactly one shuffle (the rule aggregate).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from .rules import site_rule_wide


def component_score(rules: Column, component: str) -> Column:
    """A2: round(mean of the component's rule scores), 0 when it has no rules."""
    mine = F.filter(rules, lambda r: r["category"] == F.lit(component))
    total = F.aggregate(mine, F.lit(0), lambda acc, r: acc + r["score"])
    return F.coalesce(T.half_even(F.try_divide(total, F.size(mine))), F.lit(0))


def overall_score(components: list[Column]) -> Column:
    """A3: round(Σ component × weight), floats added in component order."""
    acc = None
    for c, (_name, w) in zip(components, K.COMPONENTS):
        term = c.cast("double") * F.lit(w)
        acc = term if acc is None else acc + term
    return T.half_even(acc)


def with_scores(wide: DataFrame) -> DataFrame:
    comps = [component_score(F.col("rules"), name).alias(name) for name, _w in K.COMPONENTS]
    out = wide.select("*", *comps)
    out = out.withColumn("overall_score", overall_score([F.col(n) for n, _ in K.COMPONENTS]))
    return out.withColumn("grade", T.grade("overall_score"))


def site_scores(pages: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """One row per site: overall score, grade, the five components, pages, pass rate.

    ``sites`` (column ``site``) adds sites without pages (A5) with score 0 / F.
    """
    out = scores_of_rules(site_rule_wide(pages))
    if sites is not None:
        out = out.unionByName(empty_site_scores(pages, sites))
    return out


def scores_of_rules(wide: DataFrame) -> DataFrame:
    """Site scores of sites whose rule arrays are known."""
    scored = with_scores(wide)
    passing = F.size(F.filter("rules", lambda r: r["status"] == "pass"))
    return scored.select(
        "site", F.col("n").alias("pages"), "overall_score", "grade",
        *[F.col(n) for n, _ in K.COMPONENTS],
        F.round(F.try_divide(passing, F.size("rules")), 6).alias("pass_rate"))


def sites_without_pages(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """Sites of the dimension that have no page.

    The page side is reduced to its distinct sites first (partial aggregate),
    so whatever the join strategy, it never ships page rows.
    """
    with_pages = pages.select("site").distinct()
    return sites.select("site").distinct().join(with_pages, "site", "left_anti")


def empty_site_scores(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """A5: sites with no pages → score 0, grade F, components 0."""
    empty = sites_without_pages(pages, sites)
    return empty.select(
        "site", F.lit(0).cast("long").alias("pages"), F.lit(0).alias("overall_score"), F.lit("F").alias("grade"),
        *[F.lit(0).alias(n) for n, _ in K.COMPONENTS], F.lit(0.0).alias("pass_rate"))


def issue_struct(r: Column) -> Column:
    return F.struct(
        r["score"].alias("score"), r["rule_id"].alias("rule_id"), r["category"].alias("category"),
        F.concat(F.lit("Rule "), r["rule_id"].cast("string"), F.lit(": "), r["name"], F.lit(" — "),
                 r["finding"]).alias("title"),
        T.severity(r["score"]).alias("severity"), r["short_name"].alias("rule_name"))


def _const_issue(values) -> Column:
    category, title, severity, rule_id, rule_name, score = values
    return F.struct(F.lit(score).alias("score"), F.lit(rule_id).alias("rule_id"), F.lit(category).alias("category"),
                    F.lit(title).alias("title"), F.lit(severity).alias("severity"), F.lit(rule_name).alias("rule_name"))


def top_issues_of(rules: Column, k: int = K.TOP_ISSUES_K) -> Column:
    """Failing or warning rules by (score, rule_id), first k; else 'all_passing'."""
    bad = F.filter(rules, lambda r: r["status"].isin("fail", "warning"))
    ranked = F.slice(F.array_sort(F.transform(bad, issue_struct)), 1, k)
    return F.when(F.size(ranked) == 0, F.array(_const_issue(K.ALL_PASSING_ISSUE))).otherwise(ranked)


def top_issues(pages: DataFrame, sites: DataFrame | None = None, k: int = K.TOP_ISSUES_K) -> DataFrame:
    wide = site_rule_wide(pages)
    out = wide.select("site", F.posexplode_outer(top_issues_of(F.col("rules"), k)).alias("pos", "issue"))
    out = out.select("site", (F.col("pos") + 1).alias("rank"), "issue.*")
    if sites is not None:
        empty = sites_without_pages(pages, sites)
        out = out.unionByName(empty.select("site", F.lit(1).alias("rank"), _const_issue(K.NO_PAGES_ISSUE).alias("i"))
                              .select("site", "rank", "i.*"))
    return out


def rule_status_counts(pages: DataFrame) -> DataFrame:
    """Number of pass / warning / fail rules per site."""
    wide = site_rule_wide(pages)
    cnt = lambda s: F.size(F.filter("rules", lambda r: r["status"] == s)).alias(f"n_{s}")
    return wide.select("site", cnt("pass"), cnt("warning"), cnt("fail"))


def rule_pass_rate(pages: DataFrame) -> DataFrame:
    """Passing rules / rules; query_count = number of rules; avg latency 0."""
    wide = site_rule_wide(pages)
    passing = F.size(F.filter("rules", lambda r: r["status"] == "pass"))
    return wide.select("site", F.size("rules").alias("query_count"),
                       F.round(F.try_divide(passing, F.size("rules")), 6).alias("pass_rate"),
                       F.lit(0).alias("avg_latency_ms"))
