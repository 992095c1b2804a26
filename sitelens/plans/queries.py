"""Driver-facing queries, each with its DuckDB oracle.

Every query reads the driver tables (or views Spark derives from all of
their rows) at ``sf_dir``; none filters rows to stay cheap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rollups, rules
from ..sources import fixtures, records
from . import oracle_rules as OR
from .catalog import query

SITES_SQL = "SELECT 'src' || CAST(c_custkey AS VARCHAR) AS site FROM customer"


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.site_pages(spark, sf)


# --- rules and rollups -----------------------------------------------------

@query("site_rule_results", OR.site_rule_results_sql)
def q_site_rule_results(spark, sf):
    return rules.rule_results(_pages(spark, sf))


@query("site_scores", lambda: OR.site_scores_sql(SITES_SQL))
def q_site_scores(spark, sf):
    return rollups.site_scores(_pages(spark, sf), records.sites(spark, sf))


@query("top_issues", OR.top_issues_sql)
def q_top_issues(spark, sf):
    return rollups.top_issues(_pages(spark, sf))


@query("rule_status_counts", OR.rule_status_counts_sql)
def q_rule_status_counts(spark, sf):
    return rollups.rule_status_counts(_pages(spark, sf))


@query("rule_pass_rate", OR.rule_pass_rate_sql)
def q_rule_pass_rate(spark, sf):
    return rollups.rule_pass_rate(_pages(spark, sf))


@query("empty_sites", f"""SELECT site, 0 AS overall_score, 'F' AS grade, 'no_pages' AS rule_name
  FROM ({SITES_SQL}) s WHERE site NOT IN (SELECT source FROM documents)""")
def q_empty_sites(spark, sf):
    pages = _pages(spark, sf)
    return (rollups.empty_site_scores(pages, records.sites(spark, sf))
            .select("site", "overall_score", "grade", F.lit("no_pages").alias("rule_name")))


# --- page extraction and URLs ---------------------------------------------

from ..functions import urls as U  # noqa: E402
from ..functions import text as TX  # noqa: E402
from ..operators import linkgraph  # noqa: E402
from ..sources import pages as P  # noqa: E402

NETLOC_SQL = "regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)"
PATH_SQL = "regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def _site_sql(u: str) -> str:
    return f"replace({NETLOC_SQL.format(u=u)}, 'www.', '')"


def _unescape_sql(x: str) -> str:
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"),
                    ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{ent}', '{ch}')"
    return x


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


PAGE_CONTENT_SQL = f"""
art0 AS (SELECT page_id, url, html, regexp_extract(html, '(?s)<article[^>]*>(.*)</article>', 1) AS art FROM pages),
art1 AS (SELECT page_id, url, html, art,
   regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(art,
     '(?s)<!--.*?-->', '', 'g'), '(?s)<script\\b.*?</script>', '', 'g'), '(?s)<style\\b.*?</style>', '', 'g'),
     '(?s)<nav\\b.*?</nav>', '', 'g'), '(?s)<footer\\b.*?</footer>', '', 'g'), '(?s)<noscript\\b.*?</noscript>', '', 'g') AS clean
   FROM art0),
pc AS (SELECT page_id, url, html, art,
   array_to_string(list_filter(list_transform(regexp_split_to_array(clean, '<[^>]*>'),
       lambda x: {_strip_sql(_unescape_sql('x'))}), lambda x: x <> ''), chr(10)) AS content
   FROM art1)"""


@query("page_titles", f"""SELECT page_id, {_site_sql('url')} AS site,
  {_strip_sql(_unescape_sql("regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)"))} AS title FROM pages""")
def q_page_titles(spark, sf):
    return P.pages_extracted(spark, sf, columns=("title",)).select(F.col("ord").alias("page_id"), "site", "title")


@query("page_text_stats", f"""WITH {PAGE_CONTENT_SQL}
SELECT page_id, CAST(length(content) AS INTEGER) AS content_chars,
  CAST(len(regexp_extract_all(content, '\\S+')) AS INTEGER) AS content_words,
  CAST(len(regexp_extract_all(art, '<h[1-6][\\s>]')) AS INTEGER) AS n_headings,
  md5(content) AS content_md5, false AS has_tables, 0 AS n_links FROM pc""")
def q_page_text_stats(spark, sf):
    p = P.pages_extracted(spark, sf, columns=("content", "headings", "has_tables", "links"))
    return p.select(F.col("ord").alias("page_id"), F.length("content").alias("content_chars"),
                    TX.word_count("content").alias("content_words"), F.size("headings").alias("n_headings"),
                    F.md5("content").alias("content_md5"), "has_tables", F.size("links").alias("n_links"))


@query("site_names", f"SELECT page_id, url, {_site_sql('url')} AS site FROM pages")
def q_site_names(spark, sf):
    return P.raw_pages(spark, sf).select("page_id", "url", U.site_name("url").alias("site"))


@query("valid_paths", f"""SELECT page_id, url, NOT regexp_matches(lower({PATH_SQL.format(u='url')}),
  '/assets/|/images/|/css/|/js/|/api/|/admin/|/login/|/logout/|\\.pdf|\\.jpg|\\.png|\\.gif|\\.css|\\.js') AS valid FROM pages""")
def q_valid_paths(spark, sf):
    return P.raw_pages(spark, sf).select("page_id", "url", U.valid_path("url").alias("valid"))


@query("normalized_urls", """SELECT page_id, CASE WHEN regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') = '' THEN NULL
  ELSE regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') END AS normalized FROM pages""")
def q_normalized_urls(spark, sf):
    return P.raw_pages(spark, sf).select("page_id", U.normalize_url("url").alias("normalized"))


@query("file_names", f"""SELECT page_id, CASE WHEN regexp_replace({PATH_SQL.format(u='url')}, '^/+|/+$', '', 'g') <> '' THEN
  (CASE WHEN ends_with(regexp_replace(lower(replace(regexp_replace({PATH_SQL.format(u='url')}, '^/+|/+$', '', 'g'), '/', '-')), '\\.(html?|php|aspx?)$', ''), '.md')
        THEN regexp_replace(lower(replace(regexp_replace({PATH_SQL.format(u='url')}, '^/+|/+$', '', 'g'), '/', '-')), '\\.(html?|php|aspx?)$', '')
        ELSE regexp_replace(lower(replace(regexp_replace({PATH_SQL.format(u='url')}, '^/+|/+$', '', 'g'), '/', '-')), '\\.(html?|php|aspx?)$', '') || '.md' END)
  ELSE 'untitled.md' END AS file_name FROM pages""")
def q_file_names(spark, sf):
    return P.raw_pages(spark, sf).select("page_id", U.file_name(F.lit("Untitled"), "url").alias("file_name"))


LINK_EDGES_SQL = f"""WITH a AS (
  SELECT url, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1)) AS href0,
         unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 2)) AS txt
  FROM pages),
b AS (SELECT url, {_unescape_sql('href0')} AS href, txt FROM a
      WHERE NOT regexp_matches({_unescape_sql('href0')}, '(?i)(\\.png|\\.jpg|\\.gif|\\.svg|\\.css|\\.js|\\.woff|\\.pdf|mailto:|javascript:|#$|/login|/signup|/auth|/console|/search\\?|/changelog|/blog)')
        AND {_strip_sql(_unescape_sql('txt'))} <> ''),
c AS (SELECT url, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN href
                       WHEN starts_with(href, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1) || href
                       ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || href END AS abs FROM b),
d AS (SELECT {_site_sql('url')} AS site, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS src,
             regexp_replace(regexp_replace(abs, '#.*$', ''), '/+$', '') AS dst, abs FROM c WHERE starts_with(abs, 'http'))
SELECT DISTINCT site, src, dst FROM d WHERE dst <> '' AND {NETLOC_SQL.format(u='dst')} = {NETLOC_SQL.format(u='src')}"""


@query("link_edges", LINK_EDGES_SQL)
def q_link_edges(spark, sf):
    return linkgraph.link_edges(P.pages_extracted(spark, sf, columns=("link_refs",)))


@query("reachable_pages")
def q_reachable_pages(spark, sf):
    r = linkgraph.reachable(P.pages_stored(spark, sf, columns=("content", "link_refs")))
    return r.select("site", "url", "depth", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"))


@query("frontier")
def q_frontier(spark, sf):
    pages = P.pages_stored(spark, sf, columns=("link_refs",))
    roots = pages.select("site", F.concat(U.origin("url"), F.lit("/")).alias("url")).distinct()
    return linkgraph.frontier(pages, roots)


# --- scoring, recommendations, history --------------------------------------

from ..operators import history, scoring  # noqa: E402

FLAT_PAGES_SQL = f"sp AS (SELECT {fixtures.SITE_PAGES_SELECT} FROM documents)"
PQS_SQL = f"""WITH {FLAT_PAGES_SQL},
pq AS (SELECT site, ord, url,
  'Query about: ' || coalesce(nullif(title, ''), url) AS query,
  least(1.0, 0.5 + (length(coalesce(content, '')) / 5000) * 0.3 + (CASE WHEN code_txt IS NOT NULL THEN 0.2 ELSE 0.0 END)) AS acc,
  least(1.0, 0.4 + (CASE WHEN heading_txt <> '' AND len(string_split(heading_txt, '|')) >= 2 THEN 0.3 ELSE 0.0 END)
             + (length(coalesce(content, '')) / 8000) * 0.3) AS prec,
  least(5000, 800 + greatest(0, length(coalesce(content, '')) // 10)) AS lat,
  least(1.0, 0.7 + (CASE WHEN heading_txt <> '' AND len(string_split(heading_txt, '|')) >= 2 THEN 0.2 ELSE 0.0 END)
             + (CASE WHEN link_n > 0 THEN 0.1 ELSE 0.0 END)) AS cit,
  code_txt IS NOT NULL AS code_valid
  FROM sp)"""


@query("page_quality_signals", PQS_SQL + """
SELECT site, ord, url, query, acc > 0.6 AS passed, round(acc, 9) AS confidence, round(acc, 9) AS accuracy_score,
  round(prec, 9) AS retrieval_precision, CAST(lat AS INTEGER) AS latency_ms, round(CAST(cit AS DOUBLE), 9) AS citation_accuracy, code_valid FROM pq""")
def q_page_quality_signals(spark, sf):
    return scoring.page_quality_signals(_pages(spark, sf))


def _score_sql(src: str, key: str, keys_sql: str | None = None) -> str:
    comp = """(CASE WHEN m_lat < 1000 THEN 1.0 WHEN m_lat < 3000 THEN 0.8 WHEN m_lat < 5000 THEN 0.6 ELSE 0.4 END)"""
    code = "(CASE WHEN n_code = 0 THEN 1.0 ELSE n_valid / n_code END)"
    composite = (f"m_acc * CAST(0.3 AS DOUBLE) + m_prec * CAST(0.25 AS DOUBLE) + {comp} * CAST(0.1 AS DOUBLE) "
                 f"+ m_cit * CAST(0.2 AS DOUBLE) + {code} * CAST(0.15 AS DOUBLE)")
    grade = OR.grade_sql("overall")
    body = f"""agg AS (SELECT {key}, count(*) AS query_count, round(avg(accuracy_score), 9) AS m_acc,
      round(avg(retrieval_precision), 9) AS m_prec, round(avg(citation_accuracy), 9) AS m_cit, avg(latency_ms) AS m_lat,
      sum(latency_ms) AS s_lat, count(code_valid) AS n_code, sum(CAST(code_valid AS INTEGER)) AS n_valid,
      sum(CAST(passed AS INTEGER)) AS n_passed FROM ({src}) r GROUP BY {key}),
s1 AS (SELECT *, CAST(round_even(({composite}) * 100, 0) AS INTEGER) AS overall FROM agg)
SELECT {key}, overall, {grade} AS grade, CAST(round_even(m_acc * 100, 0) AS INTEGER) AS accuracy,
  CAST(round_even(m_prec * 100, 0) AS INTEGER) AS context_utilization, CAST(round_even({comp} * 100, 0) AS INTEGER) AS latency,
  CAST(round_even(m_cit * 100, 0) AS INTEGER) AS citation_quality, CAST(round_even({code} * 100, 0) AS INTEGER) AS code_executability,
  CAST(query_count AS BIGINT) AS query_count, round(n_passed / query_count, 6) AS pass_rate,
  CAST(floor(s_lat / query_count) AS BIGINT) AS avg_latency_ms FROM s1"""
    if keys_sql:
        body += f"""
UNION ALL SELECT {key}, 0, 'F', 0, 0, 0, 0, 0, CAST(0 AS BIGINT), 0.0, CAST(0 AS BIGINT)
  FROM ({keys_sql}) k WHERE {key} NOT IN (SELECT {key} FROM ({src}) r2)"""
    return body


QR_SQL = """SELECT l_orderkey AS analysis_id, l_returnflag <> 'R' AS passed, 1 - l_discount AS accuracy_score,
  1 - l_tax * 5 AS retrieval_precision, 0.7 + l_tax * 2 AS citation_accuracy, CAST(l_quantity * 120 AS INTEGER) AS latency_ms,
  CASE WHEN l_linestatus = 'F' AND l_linenumber = 1 THEN NULL ELSE l_linenumber % 3 <> 0 END AS code_valid FROM lineitem"""


@query("query_scores", "WITH " + _score_sql(QR_SQL, "analysis_id", "SELECT o_orderkey AS analysis_id FROM orders"))
def q_query_scores(spark, sf):
    keys = records.analyses(spark, sf).select(F.col("id").alias("analysis_id"))
    return scoring.score_queries(records.query_results(spark, sf), "analysis_id", keys)


@query("site_friendliness", PQS_SQL + ", " + _score_sql(
    "SELECT site, acc > 0.6 AS passed, round(acc, 9) AS accuracy_score, round(prec, 9) AS retrieval_precision, "
    "round(cit, 9) AS citation_accuracy, CAST(lat AS INTEGER) AS latency_ms, code_valid FROM pq", "site"))
def q_site_friendliness(spark, sf):
    return scoring.score_queries(scoring.page_quality_signals(_pages(spark, sf)), "site")


def _recs_query_sql() -> str:
    fr_body = _score_sql("SELECT site, acc > 0.6 AS passed, round(acc, 9) AS accuracy_score, round(prec, 9) AS retrieval_precision, "
                         "round(cit, 9) AS citation_accuracy, CAST(lat AS INTEGER) AS latency_ms, code_valid FROM pq", "site")
    head, final_select = fr_body.rsplit("\nSELECT ", 1)
    tmpl = " UNION ALL ".join(
        f"SELECT {i} AS slot, '{comp}' AS comp, '{imp}' AS impact, '{eff}' AS effort, '{cat}' AS category, "
        f"'{title}' AS title, CAST({est} AS DOUBLE) AS estimated_improvement"
        for i, (comp, _t, imp, eff, cat, title, est) in enumerate(scoring.RECOMMENDATIONS))
    describe = "CASE category " + " ".join(f"WHEN '{k}' THEN {OR.q(v)}" for k, v in scoring.RECOMMENDATION_TEXTS.items()) + " END"
    return PQS_SQL + f""", {head},
fr AS (SELECT {final_select}),
lg AS (SELECT site, 'accuracy' AS comp, accuracy AS v FROM fr UNION ALL SELECT site, 'code_executability', code_executability FROM fr
       UNION ALL SELECT site, 'context_utilization', context_utilization FROM fr UNION ALL SELECT site, 'citation_quality', citation_quality FROM fr),
t AS ({tmpl}),
em AS (SELECT lg.site, t.* FROM lg JOIN t USING (comp) WHERE lg.v < 80),
em2 AS (SELECT * FROM em UNION ALL
        SELECT site, 4, 'none', 'low', 'low', 'optimization', 'Fine-tune for perfect agent experience', CAST(1.0 AS DOUBLE) FROM fr
        WHERE site NOT IN (SELECT site FROM em)),
rk AS (SELECT site, ord, url, length(coalesce(content, '')) < 500 AS is_short, code_txt IS NULL AS no_code,
              row_number() OVER (PARTITION BY site ORDER BY ord) AS rn FROM sp),
nc AS (SELECT site, ord, url, row_number() OVER (PARTITION BY site ORDER BY ord) AS rn FROM sp WHERE code_txt IS NULL),
a1 AS (SELECT site, string_agg(url, ' ' ORDER BY ord) AS u FROM rk WHERE rn <= 3 AND is_short GROUP BY site),
a2 AS (SELECT site, string_agg(url, ' ' ORDER BY ord) AS u FROM nc WHERE rn <= 5 GROUP BY site)
SELECT em2.site, CAST(row_number() OVER (PARTITION BY em2.site ORDER BY slot) AS INTEGER) AS priority, impact, effort, category, title,
  estimated_improvement, {describe} AS description,
  CASE WHEN category = 'content_gap' THEN coalesce(a1.u, '') WHEN category = 'code_quality' THEN coalesce(a2.u, '') ELSE '' END AS affected_urls
FROM em2 LEFT JOIN a1 USING (site) LEFT JOIN a2 USING (site)"""


@query("recommendations", _recs_query_sql)
def q_recommendations(spark, sf):
    pages = _pages(spark, sf)
    scores = scoring.score_queries(scoring.page_quality_signals(pages), "site")
    r = scoring.recommendations(scores, pages, "site")
    return r.withColumn("affected_urls", F.array_join(F.transform("affected_pages", lambda p: p["url"]), " ")).drop("affected_pages")


ANALYSES_SQL = """an AS (SELECT o_orderkey AS id, o_custkey % 200 AS site_id,
  CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RUNNING' WHEN 'P' THEN 'FAILED' ELSE 'QUEUED' END AS status,
  CASE WHEN o_orderstatus = 'F' THEN CAST((o_orderkey * 37) % 101 AS INTEGER) END AS overall_score,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS completed_at,
  CASE WHEN o_orderstatus = 'F' THEN CAST((o_orderkey * 41) % 101 AS INTEGER) END AS c_accuracy,
  CASE WHEN o_orderstatus = 'F' THEN CAST((o_orderkey * 43) % 101 AS INTEGER) END AS c_context_utilization,
  CASE WHEN o_orderstatus = 'F' THEN CAST((o_orderkey * 47) % 101 AS INTEGER) END AS c_citation_quality,
  CASE WHEN o_orderstatus = 'F' THEN CAST((o_orderkey * 53) % 101 AS INTEGER) END AS c_code_executability,
  CASE WHEN o_orderstatus = 'F' THEN CAST((o_orderkey * 59) % 101 AS INTEGER) END AS c_structure,
  o_orderdate AS created_at, CAST(o_orderkey % 101 AS INTEGER) AS progress
  FROM orders),
done AS (SELECT id, site_id, row_number() OVER (PARTITION BY site_id ORDER BY completed_at DESC, id DESC) AS rn
         FROM an WHERE status = 'COMPLETED' AND overall_score IS NOT NULL),
best AS (SELECT site_id, max(CASE WHEN rn = 1 THEN id END) AS best_id, max(CASE WHEN rn = 2 THEN id END) AS second_id
         FROM done GROUP BY site_id),
prev AS (SELECT a.id, a.site_id, CASE WHEN a.id = b.best_id THEN b.second_id ELSE b.best_id END AS previous_id
         FROM an a LEFT JOIN best b USING (site_id))"""


@query("previous_analysis", f"WITH {ANALYSES_SQL} SELECT id, site_id, previous_id FROM prev")
def q_previous_analysis(spark, sf):
    return history.previous_analysis(records.analyses(spark, sf))


COMPS = ["accuracy", "context_utilization", "citation_quality", "code_executability", "structure"]


@query("compare_analyses", f"""WITH {ANALYSES_SQL}
SELECT p.id, p.site_id, p.previous_id, c.overall_score, q.overall_score AS previous_score,
  CASE WHEN p.previous_id IS NOT NULL THEN c.overall_score - q.overall_score END AS delta,
  {', '.join(f"CASE WHEN p.previous_id IS NOT NULL AND c.c_{n} IS NOT NULL THEN c.c_{n} - coalesce(q.c_{n}, 0) END AS d_{n}" for n in COMPS)}
FROM prev p JOIN an c ON c.id = p.id LEFT JOIN an q ON q.id = p.previous_id""")
def q_compare_analyses(spark, sf):
    c = history.compare_analyses(records.analyses(spark, sf))
    return c.select("id", "site_id", "previous_id", "overall_score", "previous_score", "delta",
                    *[F.col("component_deltas")[n].alias(f"d_{n}") for n in COMPS])


@query("score_trend", """SELECT 'site' || CAST(user_id % 50 AS VARCHAR) AS site, strftime(ts, '%Y-%m-%d %H:%M:%S') AS date, event_id,
  CAST(CAST(trunc(abs(value)) AS BIGINT) % 101 AS INTEGER) AS score,
  CASE WHEN lag(CAST(CAST(trunc(abs(value)) AS BIGINT) % 101 AS INTEGER)) OVER w IS NULL OR lag(CAST(CAST(trunc(abs(value)) AS BIGINT) % 101 AS INTEGER)) OVER w = 0 THEN 0
       ELSE CAST(CAST(trunc(abs(value)) AS BIGINT) % 101 AS INTEGER) - lag(CAST(CAST(trunc(abs(value)) AS BIGINT) % 101 AS INTEGER)) OVER w END AS change
FROM events WINDOW w AS (PARTITION BY 'site' || CAST(user_id % 50 AS VARCHAR) ORDER BY ts, event_id)""")
def q_score_trend(spark, sf):
    t = history.score_trend(records.score_history(spark, sf))
    return t.select("site", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), "event_id", "score", "change")


@query("top_percent", f"""WITH {ANALYSES_SQL}
SELECT id, overall_score, CAST(greatest(1, ceil((1 - percent_rank() OVER (ORDER BY overall_score)) * 100)) AS INTEGER) AS top_percent
FROM an WHERE overall_score IS NOT NULL""")
def q_top_percent(spark, sf):
    a = records.analyses(spark, sf).where(F.col("overall_score").isNotNull()).select("id", "overall_score")
    return history.top_percent(a)


@query("dashboard", f"""WITH {ANALYSES_SQL}
SELECT CAST(floor(round(avg(overall_score), 9) + 0.5) AS INTEGER) AS average_score,
  {OR.grade_sql("CAST(floor(round(avg(overall_score), 9) + 0.5) AS INTEGER)")} AS grade,
  (SELECT CAST(sum(coalesce(CAST(trunc(c_acctbal) AS BIGINT), 0)) AS BIGINT) FROM customer) AS total_pages
FROM an WHERE overall_score IS NOT NULL""")
def q_dashboard(spark, sf):
    a = records.analyses(spark, sf).where(F.col("overall_score").isNotNull())
    return history.dashboard(records.sites(spark, sf), a)


@query("query_pass_counts", """SELECT l_orderkey AS analysis_id, CAST(count_if(l_returnflag <> 'R') AS BIGINT) AS passed,
  CAST(count_if(l_returnflag = 'R') AS BIGINT) AS failed FROM lineitem GROUP BY l_orderkey""")
def q_query_pass_counts(spark, sf):
    return history.query_pass_counts(records.query_results(spark, sf))


# --- diagnosis, language, terminology ---------------------------------------

from ..operators import diagnose as D  # noqa: E402


def _any_sql(col: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({col}, {OR.q(p)})" for p in phrases) + ")"


def _list_sql(phrases) -> str:
    return "[" + ", ".join(OR.q(p) for p in phrases) + "]"


def _diag_cte() -> str:
    def msg(t, v):
        a, b = t.split("{}")
        return f"{OR.q(a)} || {v} || {OR.q(b)}"
    issues = ", ".join([
        f"CASE WHEN vague IS NOT NULL THEN {msg(D.MSG_VAGUE, 'vague')} END",
        f"CASE WHEN NOT has_action AND nh > 0 THEN {OR.q(D.MSG_HEADINGS)} END",
        f"CASE WHEN contains(lc, 'parameter') AND NOT has_tables THEN {OR.q(D.MSG_PROSE_PARAMS)} END",
        f"CASE WHEN has_code AND NOT complete THEN {OR.q(D.MSG_NO_IMPORTS)} WHEN NOT has_code AND (contains(tl, 'how') OR contains(tl, 'guide')) THEN {OR.q(D.MSG_HOWTO_NO_CODE)} END",
        f"CASE WHEN implicit IS NOT NULL THEN {msg(D.MSG_IMPLICIT, 'implicit')} END",
        f"CASE WHEN contains(lc, 'error') AND NOT errors THEN {OR.q(D.MSG_ERRORS)} END",
        f"CASE WHEN NOT front THEN {OR.q(D.MSG_FRONTMATTER)} END",
        f"CASE WHEN marketing IS NOT NULL THEN {msg(D.MSG_MARKETING, 'marketing')} END",
        f"CASE WHEN wc < {D.SHORT_WORDS} THEN {OR.q(D.MSG_SHORT)} END",
        f"CASE WHEN nh < {D.MIN_HEADINGS} THEN {OR.q(D.MSG_STRUCTURE)} END"])
    strengths = ", ".join(f"CASE WHEN {flag} THEN {OR.q(s)} END" for flag, s in zip(
        ["has_tables", "complete", "errors", "prereq", "has_action", "vague IS NULL"], D.STRENGTHS))
    return f"""{FLAT_PAGES_SQL},
d0 AS (SELECT site, ord, url, title, coalesce(content, '') AS c, lower(coalesce(content, '')) AS lc, lower(title) AS tl,
        CASE WHEN heading_txt = '' THEN [] ELSE string_split(heading_txt, '|') END AS heads, code_txt FROM sp),
d1 AS (SELECT *, CAST(len(regexp_extract_all(c, '\\S+')) AS INTEGER) AS wc, CAST(len(heads) AS INTEGER) AS nh,
        code_txt IS NOT NULL AS has_code,
        list_filter({_list_sql(D.VAGUE_REFS)}, lambda x: contains(lc, x))[1] AS vague,
        len(list_filter(heads, lambda h: {_any_sql('lower(h)', D.ACTION_WORDS)})) > len(heads) * {D.ACTION_SHARE} AS has_action,
        contains(c, '|') AND {_any_sql('lc', ['parameter', 'type', 'required'])} AS has_tables,
        code_txt IS NOT NULL AND {_any_sql('lower(code_txt)', ['import', 'require', 'from'])} AS complete,
        list_filter({_list_sql(D.IMPLICIT_PHRASES)}, lambda x: contains(lc, x))[1] AS implicit,
        contains(lc, 'error') AND (contains(lc, 'code') OR contains(lc, 'status')) AND {_any_sql('lc', ['fix', 'solution', 'resolve'])} AS errors,
        regexp_matches(c, '^\\s*---') AS front,
        {_any_sql('lc', ['prerequisite', 'before you begin', 'requirements'])} AS prereq,
        contains(lc, 'response') AND (contains(lc, 'example') OR contains(lc, 'output')) AS output,
        list_filter({_list_sql(D.MARKETING_TERMS)}, lambda x: contains(lc, x))[1] AS marketing,
        {_any_sql('lc', ['version', 'v1', 'v2'])} AS version FROM d0),
diag AS (SELECT *, list_filter([{issues}], lambda x: x IS NOT NULL) AS issues,
        list_filter([{strengths}], lambda x: x IS NOT NULL) AS strengths FROM d1)"""


@query("diagnose_pages", lambda: f"""WITH {_diag_cte()}
SELECT site, ord, wc AS word_count, nh AS heading_count, has_action AS has_action_headings, has_tables AS has_parameter_tables,
  complete AS has_complete_examples, errors AS has_error_docs, output AS has_expected_output, version AS has_version_info,
  array_to_string(issues, ' | ') AS issues, array_to_string(strengths, ' | ') AS strengths FROM diag""")
def q_diagnose_pages(spark, sf):
    d = D.diagnose_pages(_pages(spark, sf))
    return d.select("site", "ord", "word_count", "heading_count", "has_action_headings", "has_parameter_tables",
                    "has_complete_examples", "has_error_docs", "has_expected_output", "has_version_info",
                    F.array_join("issues", " | ").alias("issues"), F.array_join("strengths", " | ").alias("strengths"))


@query("issue_frequency", lambda: f"""WITH {_diag_cte()}
SELECT site, issue, CAST(count(*) AS BIGINT) AS pages FROM (SELECT site, unnest(issues) AS issue FROM diag) GROUP BY site, issue""")
def q_issue_frequency(spark, sf):
    return D.issue_frequency(D.diagnose_pages(_pages(spark, sf)))


def _lang_sql(text: str) -> str:
    sample = f"lower(coalesce({text}, ''))"
    scores = {lang: "(" + " + ".join(f"CAST(contains({sample}, {OR.q(m)}) AS INTEGER)" for m in marks) + ")"
              for lang, marks in D.LANG_MARKERS}
    best = "greatest(" + ", ".join(scores.values()) + ")"
    return "CASE " + " ".join(f"WHEN {s} = {best} AND {best} >= {D.LANG_MIN_HITS} THEN '{lang}'"
                              for lang, s in scores.items()) + " ELSE 'en' END"


@query("detect_language", lambda: f"SELECT doc_id, lang, {_lang_sql('text')} AS predicted FROM documents")
def q_detect_language(spark, sf):
    return fixtures.documents(spark, sf).select("doc_id", "lang", D.detect_language(F.col("text")).alias("predicted"))


@query("language_accuracy", lambda: f"""SELECT lang, predicted, CAST(count(*) AS BIGINT) AS n FROM
  (SELECT lang, {_lang_sql('text')} AS predicted FROM documents) GROUP BY lang, predicted""")
def q_language_accuracy(spark, sf):
    return D.language_accuracy(fixtures.documents(spark, sf))


def _page_types_sql() -> str:
    return f"""WITH {_page_types_ctes()}
SELECT site, ord, hub_score, content_score,
  CASE WHEN content_score >= 4 THEN 'content' WHEN hub_score >= 5 AND content_score <= 2 THEN 'hub' ELSE 'content' END AS page_type FROM sc"""


def _page_types_ctes() -> str:
    prefixes = " OR ".join(f"starts_with(regexp_replace(p, '^\\s+', ''), {OR.q(x)})" for x in D.LIST_OR_BLOCK_PREFIXES)
    hub_terms = _any_sql("lower(title || ' ' || array_to_string(heads, ' '))", D.HUB_TITLE_TERMS)
    return f"""{_diag_cte()},
pt AS (SELECT site, ord, sp.link_n AS link_count, wc, diag.has_code AS has_code, diag.has_tables AS has_tables, errors,
  len(list_filter(string_split(c, chr(10) || chr(10)), lambda p: len(regexp_extract_all(p, '\\S+')) >= {D.LONG_PARAGRAPH_WORDS}
      AND NOT ({prefixes}))) AS long_pars,
  len(regexp_extract_all(c, '(?m)^\\d+\\.')) AS steps, {hub_terms} AS hub_title FROM diag JOIN sp USING (site, ord, url, title)),
sc AS (SELECT site, ord,
  (CASE WHEN link_count >= 8 THEN 2 ELSE 0 END) + (CASE WHEN wc > 0 AND wc / greatest(link_count, 1) <= 40 THEN 2 ELSE 0 END)
  + (CASE WHEN NOT has_code THEN 1 ELSE 0 END) + (CASE WHEN NOT has_tables THEN 1 ELSE 0 END) + (CASE WHEN steps <= 3 THEN 1 ELSE 0 END)
  + (CASE WHEN long_pars <= 2 THEN 1 ELSE 0 END) + (CASE WHEN hub_title THEN 1 ELSE 0 END) AS hub_score,
  (CASE WHEN has_code THEN 3 ELSE 0 END) + (CASE WHEN has_tables THEN 2 ELSE 0 END) + (CASE WHEN steps >= 4 THEN 2 ELSE 0 END)
  + (CASE WHEN long_pars >= 3 THEN 2 ELSE 0 END) + (CASE WHEN errors THEN 2 ELSE 0 END) AS content_score FROM pt)"""


@query("page_types", _page_types_sql)
def q_page_types(spark, sf):
    return D.page_type(_pages(spark, sf))


def _terminology_sql() -> str:
    return f"""WITH {FLAT_PAGES_SQL}, {_terminology_ctes()}
SELECT site, conflicts, terminology FROM term"""


def _terminology_ctes() -> str:
    flags, lines = [], []
    for g, terms in enumerate(D.TERMINOLOGY_GROUPS):
        for t, term in enumerate(terms):
            flags.append(f"bool_or(contains(lower(coalesce(content, '')), {OR.q(term)})) AS g{g}_{t}")
        found = "list_filter([" + ", ".join(f"CASE WHEN g{g}_{t} THEN {OR.q(term)} END" for t, term in enumerate(terms)) \
            + "], lambda x: x IS NOT NULL)"
        a, b = D.TERMINOLOGY_LINE.split("{}")
        lines.append(f"CASE WHEN len({found}) > 1 THEN {OR.q(a)} || array_to_string({found}, ', ') || {OR.q(b)} END")
    conflicts = "list_filter([" + ", ".join(lines) + "], lambda x: x IS NOT NULL)"
    return f"""ag AS (SELECT site, {', '.join(flags)} FROM sp GROUP BY site),
term AS (SELECT site, CAST(len({conflicts}) AS INTEGER) AS conflicts,
  CASE WHEN len({conflicts}) > 0 THEN {OR.q(D.TERMINOLOGY_HEADER)} || array_to_string({conflicts}, chr(10))
       ELSE {OR.q(D.TERMINOLOGY_NONE)} END AS terminology FROM ag)"""


@query("terminology_context", _terminology_sql)
def q_terminology_context(spark, sf):
    return D.terminology_context(_pages(spark, sf))


def _rewrite_requests_sql() -> str:
    return f"""WITH {_page_types_ctes()}, {_terminology_ctes()},
rq AS (SELECT d.site, d.ord, CASE WHEN sc.content_score >= 4 THEN 'content' WHEN sc.hub_score >= 5 AND sc.content_score <= 2 THEN 'hub'
         ELSE 'content' END AS page_type, {_lang_sql('d.c')} AS language,
       'complete' AS source_status,
       d.wc AS word_count, d.nh AS heading_count, CAST(CASE WHEN d.has_code THEN 1 ELSE 0 END AS INTEGER) AS code_count,
       CAST(sp.link_n AS INTEGER) AS link_count,
       CASE WHEN len(d.heads) > 0 THEN array_to_string(d.heads, ', ') ELSE 'None' END AS headings,
       CAST(CASE WHEN d.has_code THEN 1 ELSE 0 END AS INTEGER) AS n_code_examples,
       CAST(length(d.c) AS INTEGER) AS content_chars, CAST(len(d.issues) AS INTEGER) AS n_issues,
       md5(term.terminology) AS terminology_md5, d.wc >= 50 AS needs_rewrite
     FROM diag d JOIN sc USING (site, ord) JOIN sp ON sp.site = d.site AND sp.ord = d.ord LEFT JOIN term ON term.site = d.site)
SELECT * FROM rq"""


@query("rewrite_requests", _rewrite_requests_sql)
def q_rewrite_requests(spark, sf):
    r = D.rewrite_requests(_pages(spark, sf))
    return r.select("site", "ord", "page_type", "language", "source_status", "word_count", "heading_count",
                    "code_count", "link_count", "headings", F.size("code_examples").alias("n_code_examples"),
                    F.length("content").alias("content_chars"), F.size("issues").alias("n_issues"),
                    F.md5("terminology").alias("terminology_md5"), "needs_rewrite")


REQUEST_CHARS, REQUEST_CODE_CHARS, REQUEST_HEADINGS, REQUEST_EXAMPLES = 1_500, 4, 1, 1


@query("rewrite_request_bounds", lambda: f"""WITH {_page_types_ctes()}
SELECT d.site, d.ord, CAST(least(length(d.c), {REQUEST_CHARS}) AS INTEGER) AS content_chars, md5(substr(d.c, 1, {REQUEST_CHARS})) AS content_md5,
  CASE WHEN length(d.c) >= {REQUEST_CHARS - 100} THEN 'possibly_truncated' ELSE 'complete' END AS source_status,
  CASE WHEN len(d.heads) > 0 THEN d.heads[1] ELSE 'None' END AS headings,
  CASE WHEN d.has_code THEN substr(sp.code_txt, 1, {REQUEST_CODE_CHARS}) ELSE '' END AS first_code
FROM diag d JOIN sp ON sp.site = d.site AND sp.ord = d.ord""")
def q_rewrite_request_bounds(spark, sf):
    """Requests for a job of limited input: the bounds of P4 and the status of texts that reach theirs."""
    r = D.rewrite_requests(_pages(spark, sf), content_chars=REQUEST_CHARS, code_chars=REQUEST_CODE_CHARS,
                           max_headings=REQUEST_HEADINGS, max_examples=REQUEST_EXAMPLES)
    return r.select("site", "ord", F.length("content").alias("content_chars"), F.md5("content").alias("content_md5"), "source_status", "headings",
                    F.array_join(F.transform("code_examples", lambda b: b["code"]), "|").alias("first_code"))


# --- record queries ------------------------------------------------------------

from ..operators import records as RQ  # noqa: E402

SITES_DIM_SQL = """sd AS (SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS organization_id, c_name AS name,
  'https://' || lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) || '.example.com/' AS url FROM customer)"""


@query("list_sites", f"""WITH {SITES_DIM_SQL}
SELECT id, organization_id, name, CAST(row_number() OVER (PARTITION BY organization_id ORDER BY id DESC) AS INTEGER) AS position FROM sd""")
def q_list_sites(spark, sf):
    return RQ.list_sites(records.sites(spark, sf)).select("id", "organization_id", "name", "position")


@query("search_sites", f"""WITH {SITES_DIM_SQL}
SELECT id, name, url FROM sd WHERE contains(lower(name), '#0000001') OR contains(lower(url), '#0000001')""")
def q_search_sites(spark, sf):
    return RQ.search_sites(records.sites(spark, sf), "#0000001").select("id", "name", "url")


@query("list_analyses", f"""WITH {ANALYSES_SQL}, {SITES_DIM_SQL},
r AS (SELECT an.id, an.site_id, sd.organization_id, an.status, an.created_at,
        row_number() OVER (PARTITION BY sd.organization_id ORDER BY an.created_at DESC, an.id DESC) AS position
      FROM an JOIN sd ON sd.id = an.site_id)
SELECT id, site_id, organization_id, status, strftime(created_at, '%Y-%m-%d') AS created, CAST(position AS INTEGER) AS position
FROM r WHERE position <= 20""")
def q_list_analyses(spark, sf):
    la = RQ.list_analyses(records.analyses(spark, sf), records.sites(spark, sf), limit=20)
    return la.select("id", "site_id", "organization_id", "status", F.date_format("created_at", "yyyy-MM-dd").alias("created"),
                     "position")


@query("list_queries_borderline", """SELECT l_orderkey AS analysis_id, l_linenumber AS line, l_discount * 10 AS confidence,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'Query about: part ' || CAST(l_partkey AS VARCHAR)) AS INTEGER) AS position
FROM lineitem WHERE l_discount * 10 BETWEEN 0.4 AND 0.6""")
def q_list_queries_borderline(spark, sf):
    lq = RQ.list_queries(records.query_results(spark, sf), page=1, limit=50, status="borderline")
    return lq.select("analysis_id", "line", "confidence", "position")


@query("export_query_results", """WITH r AS (SELECT * FROM lineitem WHERE l_returnflag <> 'R')
SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS id, 'Query about: part ' || CAST(l_partkey AS VARCHAR) AS query_text,
  passed_flag AS passed, l_discount * 10 AS confidence, cnt AS count, 'json' AS format
FROM (SELECT *, true AS passed_flag, count(*) OVER (PARTITION BY l_orderkey) AS cnt FROM r)""")
def q_export_query_results(spark, sf):
    ex = RQ.export_query_results(records.query_results(spark, sf), status="pass")
    return ex.select("id", "query_text", "passed", "confidence", "count", "format")


@query("list_recommendations", """SELECT p_partkey AS id, p_partkey % 200 AS site_id, CAST(p_size % 5 + 1 AS INTEGER) AS priority,
  CAST(row_number() OVER (PARTITION BY p_partkey % 200 ORDER BY p_size % 5 + 1, p_partkey) AS INTEGER) AS position FROM part""")
def q_list_recommendations(spark, sf):
    return RQ.list_recommendations(records.recommendations_table(spark, sf)).select("id", "site_id", "priority", "position")


@query("org_query_results", f"""WITH {ANALYSES_SQL}, {SITES_DIM_SQL}
SELECT l.l_orderkey AS analysis_id, l.l_linenumber AS line, an.site_id, sd.organization_id, n.n_name AS organization
FROM lineitem l JOIN an ON an.id = l.l_orderkey JOIN sd ON sd.id = an.site_id JOIN nation n ON n.n_nationkey = sd.organization_id""")
def q_org_query_results(spark, sf):
    j = RQ.org_query_results(records.query_results(spark, sf), records.analyses(spark, sf), records.sites(spark, sf),
                             records.organizations(spark, sf))
    return j.select("analysis_id", "line", "site_id", "organization_id", "organization")


@query("user_organizations", """SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS organization_id, n.n_name AS organization
FROM supplier LEFT JOIN nation n ON n.n_nationkey = s_nationkey""")
def q_user_organizations(spark, sf):
    return RQ.user_organizations(records.users(spark, sf), records.organizations(spark, sf)) \
        .select("id", "organization_id", "organization")


ASSESS_SQL = """asm AS (SELECT c_custkey AS id, 'src' || CAST(c_custkey AS VARCHAR) AS site, c_name AS site_name,
  CAST((c_custkey * 37) % 101 AS INTEGER) AS score, CASE WHEN c_acctbal > 0 THEN 'paid' ELSE 'pending' END AS payment_status,
  CASE c_custkey % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'failed' WHEN 2 THEN NULL ELSE 'running' END AS optimization_status,
  c_custkey % 4 AS n_docs, 1700000000 + c_custkey * 3600 AS created_s FROM customer)"""


@query("public_gallery", f"""WITH {ASSESS_SQL}
SELECT id, site_name, score, CAST(n_docs AS INTEGER) AS page_count FROM asm
WHERE payment_status = 'paid' AND optimization_status = 'complete' ORDER BY created_s DESC, id DESC LIMIT 24""")
def q_public_gallery(spark, sf):
    return RQ.public_gallery(records.assessments(spark, sf)).select("id", "site_name", "score", "page_count")


@query("retryable_assessments", f"""WITH {ASSESS_SQL}
SELECT id, site FROM asm WHERE payment_status = 'paid' AND (optimization_status IS NULL OR optimization_status = 'failed')""")
def q_retryable_assessments(spark, sf):
    return RQ.retryable_assessments(records.assessments(spark, sf)).select("id", "site")


@query("cancel_analyses", f"""WITH {ANALYSES_SQL}
SELECT status, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN status IN ('QUEUED', 'RUNNING') THEN 'CANCELLED' ELSE status END AS status FROM an)
GROUP BY status""")
def q_cancel_analyses(spark, sf):
    return history.cancel(records.analyses(spark, sf)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("cascade_delete", f"""WITH {ANALYSES_SQL}, {SITES_DIM_SQL},
gone AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0)
SELECT (SELECT CAST(count(*) AS BIGINT) FROM an WHERE site_id NOT IN (SELECT id FROM gone)) AS analyses_left,
       (SELECT CAST(count(*) AS BIGINT) FROM part WHERE p_partkey % 200 NOT IN (SELECT id FROM gone)) AS recommendations_left,
       (SELECT CAST(count(*) AS BIGINT) FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM an WHERE site_id IN (SELECT id FROM gone))) AS results_left""")
def q_cascade_delete(spark, sf):
    gone = records.read(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    a, r, q = RQ.cascade_delete(gone, records.analyses(spark, sf), records.recommendations_table(spark, sf),
                                records.query_results(spark, sf))
    tagged = (a.select(F.lit(0).alias("t")).unionByName(r.select(F.lit(1).alias("t")))
              .unionByName(q.select(F.lit(2).alias("t"))))
    return tagged.agg(*[F.count_if(F.col("t") == i).alias(n)
                        for i, n in enumerate(["analyses_left", "recommendations_left", "results_left"])])


def _slug_sql(x: str) -> str:
    s = f"lower(trim({x}))"
    s = f"regexp_replace({s}, '[^a-z0-9\\s-]', '', 'g')"
    s = f"regexp_replace({s}, '[\\s-]+', '-', 'g')"
    s = f"regexp_replace({s}, '^-+|-+$', '', 'g')"
    return f"CASE WHEN {s} = '' THEN 'product' ELSE {s} END"


@query("slugs", f"""WITH pk AS (SELECT p_partkey AS id, {_slug_sql('p_brand')} AS base,
  'owner' || CAST(p_partkey % 7 AS VARCHAR) || '@example.com' AS email, p_partkey AS created FROM part),
f AS (SELECT base, arg_min(email, created) AS first_email FROM pk GROUP BY base)
SELECT id, CASE WHEN email = first_email THEN base ELSE base || '-' || substr(sha256(email), 1, 6) END AS slug FROM pk JOIN f USING (base)""")
def q_slugs(spark, sf):
    return RQ.unique_slugs(records.packages(spark, sf)).select("id", "slug")


PKG_SQL = f"""pk AS (SELECT p_partkey AS id, {_slug_sql('p_brand')} AS slug,
  CASE p_partkey % 5 WHEN 0 THEN 'planning' WHEN 1 THEN 'preview_ready' WHEN 2 THEN 'full_ready' WHEN 3 THEN 'failed' ELSE 'submitted' END AS status,
  CASE WHEN p_size % 2 = 0 THEN 'paid' ELSE 'pending' END AS payment_status, string_split(lower(p_type), ' ') AS words FROM part)"""


@query("ready_packages", f"""WITH {PKG_SQL}
SELECT id, status, CAST(len(words) AS INTEGER) AS page_count FROM pk WHERE status IN ('preview_ready', 'full_ready')""")
def q_ready_packages(spark, sf):
    return RQ.ready_packages(records.packages(spark, sf)).select("id", "status", "page_count")


@query("entitled_pages", f"""WITH {PKG_SQL},
ex AS (SELECT id, slug, payment_status, status, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM pk),
sel AS (SELECT * FROM ex WHERE CASE WHEN payment_status = 'paid' AND status = 'full_ready' THEN true ELSE i <= 2 END),
dedup AS (SELECT id, slug, payment_status, w, max(CASE WHEN i <= 2 THEN 'preview' ELSE 'full' END) AS tier FROM sel GROUP BY id, slug, payment_status, w)
SELECT slug, w AS page_slug, tier, tier = 'full' AND payment_status <> 'paid' AS locked FROM dedup""")
def q_entitled_pages(spark, sf):
    pk = records.packages(spark, sf).withColumnRenamed("slug", "pkg_slug").withColumn("slug", F.col("pkg_slug"))
    e = RQ.entitled_pages(pk)
    return e.select("slug", "page_slug", "tier", "locked").where(F.col("page_slug").isNotNull())


# --- rewrites ------------------------------------------------------------------

from ..operators import rewrites as RW  # noqa: E402


def _accepted(spark, sf):
    return RW.accept_rewrites(fixtures.rewrites(spark, sf), _pages(spark, sf), fixtures.REWRITE_RUN_DATE)


@query("validate_rewrites")
def q_validate_rewrites(spark, sf):
    v = RW.validate_rewrites(fixtures.rewrites(spark, sf), _pages(spark, sf), fixtures.REWRITE_RUN_DATE)
    return v.select("site", "ord", F.md5("validated").alias("validated_md5"), "date_fixed", "blocks_removed",
                    "table_rows_removed", "sections_removed")


@query("clean_rewrites")
def q_clean_rewrites(spark, sf):
    r = fixtures.rewrites(spark, sf)
    return r.select("site", "ord", F.md5(RW.clean_rewrite(F.col("optimized_content"))).alias("clean_md5"),
                    F.length(RW.clean_rewrite(F.col("optimized_content"))).alias("clean_chars"))


@query("claimed_improvements")
def q_claimed_improvements(spark, sf):
    a = _accepted(spark, sf)
    return a.select("site", "ord", F.size("improvements").alias("n_improvements"),
                    F.array_join("improvements", " | ").alias("improvements"))


@query("improvement_summary")
def q_improvement_summary(spark, sf):
    return RW.improvement_summary(_accepted(spark, sf))


@query("fabrication_report")
def q_fabrication_report(spark, sf):
    return RW.fabrication_report(_accepted(spark, sf))


@query("llms_txt")
def q_llms_txt(spark, sf):
    return RW.llms_txt_lines(_accepted(spark, sf))


@query("viewer_index")
def q_viewer_index(spark, sf):
    acc = _accepted(spark, sf)
    idx = RQ.viewer_index(records.assessments(spark, sf), acc)
    return RQ.viewer_page(idx).select("site", "file_name", "title", "url")


@query("dedent_fences")
def q_dedent_fences(spark, sf):
    a = _accepted(spark, sf)
    return RW.dedent_nested_fences(a).select("site", "ord", F.md5("content").alias("dedented_md5"))


# --- guides and packages -----------------------------------------------------

from ..operators import guides as G  # noqa: E402


def _parsed(spark, sf):
    return G.parse_guides(fixtures.raw_guides(spark, sf))


GUIDE_OK_SQL = "NOT ((conv_id + turn) % 9 = 4)"


@query("parse_guides", f"""SELECT conv_id * 100 + turn AS guide_id, {GUIDE_OK_SQL} AS ok,
  CASE WHEN NOT {GUIDE_OK_SQL} THEN 'Could not parse the guide JSON' END AS error,
  CASE WHEN {GUIDE_OK_SQL} THEN 'product-' || CAST(conv_id AS VARCHAR) END AS slug FROM conversations""")
def q_parse_guides(spark, sf):
    p = _parsed(spark, sf)
    return p.select("guide_id", "ok", "error", F.col("guide.meta.slug").alias("slug"))


def _playbooks_sql() -> str:
    risks = fixtures.RISKS
    labels = {"safe_read": "SAFE", "safe_write": "SAFE WRITE", "requires_confirmation": "CONFIRM",
              "requires_escalation": "ESCALATE", "high_risk": "HIGH RISK", "custom_level": "Custom Level"}
    risk_case = "CASE i % 6 " + " ".join(f"WHEN {k} THEN '{labels[r]}'" for k, r in enumerate(risks)) + " END"
    return f"""WITH g AS (SELECT conv_id, turn, conv_id * 100 + turn AS guide_id, string_split(text, '. ') AS sent
                   FROM conversations WHERE {GUIDE_OK_SQL}),
s AS (SELECT guide_id, conv_id, unnest(sent) AS s, generate_subscripts(sent, 1) - 1 AS i FROM g),
w AS (SELECT *, string_split(s, ' ') AS w FROM s)
SELECT guide_id, CAST(i AS INTEGER) AS idx, array_to_string(w[1:3], ' ') AS task_name, {risk_case} AS risk,
  CAST(CASE WHEN conv_id % 3 = 1 OR i % 3 = 0 THEN 1 ELSE least(i % 3, len(w)) END AS INTEGER) AS n_ask,
  CAST(len(w[2:6]) AS INTEGER) AS n_check, CAST(len(w) AS INTEGER) AS n_do,
  array_to_string(w, ' ') AS do, conv_id % 2 = 0 AND i >= 2 AS locked FROM w"""


@query("guide_playbooks", _playbooks_sql)
def q_guide_playbooks(spark, sf):
    pb = G.guide_playbooks(_parsed(spark, sf))
    return pb.select("guide_id", "idx", "task_name", "risk", F.size("ask_for").alias("n_ask"),
                     F.size("check").alias("n_check"), F.size("do").alias("n_do"), F.array_join("do", " ").alias("do"),
                     "locked")


@query("guide_stop_conditions")
def q_guide_stop_conditions(spark, sf):
    s = G.stop_conditions(_parsed(spark, sf))
    return s.select("guide_id", "ok", F.size("stop_and_ask").alias("n_ask"), F.size("stop_and_escalate").alias("n_escalate"),
                    F.md5(F.array_join("stop_and_ask", "\n")).alias("ask_md5"))


@query("guide_scope")
def q_guide_scope(spark, sf):
    return G.guide_scope(_parsed(spark, sf))


@query("guide_rules_setup")
def q_guide_rules_setup(spark, sf):
    return G.guide_rules_setup(_parsed(spark, sf))


@query("guide_decisions")
def q_guide_decisions(spark, sf):
    d = G.guide_decisions(_parsed(spark, sf))
    return d.select("guide_id", "pos", "decision", F.size("use_when").alias("n_use"), F.get("escalate_if", F.lit(0)).alias("escalate"))


@query("guide_troubleshooting")
def q_guide_troubleshooting(spark, sf):
    return G.guide_troubleshooting(_parsed(spark, sf))


@query("guide_references")
def q_guide_references(spark, sf):
    return G.guide_references(_parsed(spark, sf))


@query("package_page_map")
def q_package_page_map(spark, sf):
    return G.package_page_map(records.packages(spark, sf)).select("slug", "pos", "page_type", "tier", "locked")


@query("faq_by_category")
def q_faq_by_category(spark, sf):
    return G.faq_by_category(fixtures.faq_questions(spark, sf))


@query("source_pages")
def q_source_pages(spark, sf):
    return G.source_pages(P.pages_extracted(spark, sf))


# --- streaming -----------------------------------------------------------------

import uuid as _uuid  # noqa: E402

from ..session import checkpoint_dir as _checkpoint_dir  # noqa: E402
from ..streaming import incremental as INC  # noqa: E402


def page_versions(spark, sf):
    """Two versions of every fixture page: the original, then a revised text for
    one page in three (a later ``fetched_at``)."""
    base = _pages(spark, sf)
    v1 = base.withColumn("fetched_at", F.timestamp_seconds(F.lit(1767225600)))
    v2 = base.where(F.col("ord") % 3 == 0).withColumn("content", F.concat(F.col("content"), F.lit(" version 3 -> done ")))
    v2 = v2.withColumn("fetched_at", F.timestamp_seconds(F.lit(1767312000)))
    return v1, v2


@query("incremental_site_scores", lambda: OR.site_scores_sql(
    revise_content="CASE WHEN ord % 3 = 0 THEN content || ' version 3 -> done ' ELSE content END"))
def q_incremental_site_scores(spark, sf):
    root = f"{_checkpoint_dir(spark)}/incremental-{_uuid.uuid4().hex}"
    src, state = f"{root}/source", f"{root}/state"
    v1, v2 = page_versions(spark, sf)
    v1.write.mode("append").parquet(src)
    q1 = INC.start(spark, src, state)
    q1.awaitTermination()
    v2.write.mode("append").parquet(src)
    q2 = INC.start(spark, src, state)
    q2.awaitTermination()
    return INC.read_scores(spark, state).drop("batch_id")


# --- sitemaps and discovery -------------------------------------------------------

from ..sources import sitemaps as SM  # noqa: E402


@query("sitemap_urls", """WITH p AS (SELECT replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1), 'www.', '') AS site,
  page_id, url FROM pages),
s AS (SELECT site, min(page_id) AS first_id FROM p GROUP BY site)
SELECT p.site, u AS url FROM p JOIN s USING (site), unnest([p.url, p.url || '/img.png']) t(u) WHERE s.first_id % 5 <> 0""")
def q_sitemap_urls(spark, sf):
    sm, _ix = fixtures.fetched_sitemaps(spark, sf)
    return SM.sitemap_urls(sm).select("site", "url")


@query("discover_urls")
def q_discover_urls(spark, sf):
    sm, ix = fixtures.fetched_sitemaps(spark, sf)
    # only start pages are parsed: they are picked by URL and number first
    raw = P.raw_pages(spark, sf).withColumn("site", U.site_name("url"))
    starts = linkgraph.default_starts(raw.withColumnRenamed("page_id", "ord"))
    firsts = raw.join(starts.select("site", F.col("url").alias("start")), "site").where("url = start")
    start_pages = P.extract_pages(firsts, keep=("page_id", "site"))
    # at the conventional place, sites with a name of odd length have a sitemap whose end is missing
    found = sm.withColumn("xml", F.when(F.length("site") % 2 == 0, F.col("xml")).otherwise(F.replace("xml", F.lit("</urlset>"), F.lit(""))))
    out = SM.discover_urls(starts, SM.sitemap_urls(found), SM.sitemap_index_urls(ix, sm),
                           SM.start_page_links(start_pages))
    return out


@query("read_fetched_pages")
def q_read_fetched_pages(spark, sf):
    raw = P.raw_pages(spark, sf)
    ctype = F.element_at(F.array(F.lit("text/html; charset=utf-8"), F.lit(None).cast("string"), F.lit("text/plain"),
                                 F.lit("application/xhtml+xml"), F.lit("application/octet-stream")),
                         (F.col("page_id") % 5 + 1).cast("int"))
    status = F.when(F.col("page_id") % 7 == 3, F.lit(404)).otherwise(F.lit(200))
    fetched = raw.select("page_id", "url", F.col("html").alias("body"), status.alias("status"), ctype.alias("content_type"))
    out = P.read_fetched_pages(fetched)
    return out.select("site", "url", F.length("content").alias("content_chars"), F.size("headings").alias("n_headings"),
                      F.col("title").isNotNull().alias("has_title"))


@query("capped_pages")
def q_capped_pages(spark, sf):
    pages = P.min_content_filter(P.pages_extracted(spark, sf, columns=("content",)), 50)
    return P.per_site_page_cap(pages, 10).select("site", "ord", "url")


# --- merges and upserts ---------------------------------------------------------


def _package_pages(spark, sf):
    pk = records.packages(spark, sf)
    prev = pk.select(F.col("slug").alias("package"), F.explode_outer("preview_pages").alias("slug", "p")).where("slug IS NOT NULL") \
        .select("package", "slug", F.col("p.title").alias("title"), F.lit("preview").alias("version"))
    full = pk.select(F.col("slug").alias("package"), F.explode_outer("full_pages").alias("slug", "p")).where("slug IS NOT NULL") \
        .select("package", "slug", F.col("p.title").alias("title"), F.lit("full").alias("version"))
    return prev, full


@query("merge_pages", f"""WITH {PKG_SQL},
ex AS (SELECT slug AS package, status, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM pk),
c AS (SELECT package, w AS slug, CASE WHEN status = 'full_ready' THEN 'full' ELSE 'preview' END AS version FROM ex
      WHERE i <= 2 OR status = 'full_ready')
SELECT package, slug, min(version) AS version FROM c GROUP BY package, slug""")
def q_merge_pages(spark, sf):
    prev, full = _package_pages(spark, sf)
    return RQ.merge_pages(prev, full).select("package", "slug", "version")


@query("mandatory_pages")
def q_mandatory_pages(spark, sf):
    pk = records.packages(spark, sf)
    pm = pk.select(F.col("slug").alias("package"), F.posexplode_outer("page_map").alias("ord", "p")).where("ord IS NOT NULL") \
        .select("package", F.col("p.page_type").alias("page_type"), F.col("p.title").alias("title"),
                F.col("p.slug").alias("slug"), F.col("p.tier").alias("tier"), F.col("ord").cast("int").alias("ord"))
    return RQ.ensure_mandatory_pages(pm)


@query("upsert_by_slug")
def q_upsert_by_slug(spark, sf):
    pk = records.packages(spark, sf).groupBy("slug").agg(F.min_by(F.struct("status", "payment_status", F.col("name").alias("title")), F.col("id")).alias("p")) \
        .select("slug", "p.*")
    part = records.read(spark, sf, "part")
    name = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")) \
        .otherwise(F.concat(F.col("p_brand"), F.lit(" "), F.split(F.col("p_type"), " ")[0]))
    seeds = part.select(TX.slugify(name).alias("slug"), F.concat(F.lit("Seed "), name).alias("title"),
                        F.lit("full_ready").alias("status"))
    seeds = seeds.groupBy("slug").agg(F.min("title").alias("title"), F.first("status").alias("status"))
    return RQ.upsert_by_slug(pk, seeds, content_cols=["title"])


@query("ordered_distinct_links")
def q_ordered_distinct_links(spark, sf):
    return RQ.ordered_distinct_links(P.pages_extracted(spark, sf))


# --- additional oracles for queries registered above ---------------------------------

from .catalog import REGISTRY as _REG  # noqa: E402


def _attach(name: str, sql):
    fn, _old = _REG[name]
    _REG[name] = (fn, sql)


def _title_case_sql(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all(lower({x}), '[a-z]+|[^a-z]+'), "
            f"lambda t: upper(t[1]) || t[2:]), '')")


_attach("capped_pages", f"""WITH {PAGE_CONTENT_SQL},
ok AS (SELECT {_site_sql('url')} AS site, page_id AS ord, url FROM pc WHERE length({_strip_sql('content')}) > 50),
r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY ord) AS rn FROM ok)
SELECT site, ord, url FROM r WHERE rn <= 10""")

_attach("source_pages", f"""SELECT {_site_sql('url')} AS site, page_id AS ord, url,
  coalesce(nullif({_strip_sql(_unescape_sql("regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)"))}, ''), 'Untitled') AS title FROM pages""")

_attach("frontier", LINK_EDGES_SQL.replace("SELECT DISTINCT site, src, dst FROM d", "SELECT DISTINCT site, dst AS url FROM d")
        .replace("WITH a AS (", "WITH known AS (SELECT regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS u FROM pages), a AS (")
        + " AND dst NOT IN (SELECT u FROM known)")

_attach("package_page_map", f"""WITH {PKG_SQL}
SELECT slug, CAST(i - 1 AS INTEGER) AS pos, w AS page_type, CASE WHEN i <= 2 THEN 'preview' ELSE 'full' END AS tier,
  i > 2 AND payment_status <> 'paid' AS locked
FROM (SELECT slug, payment_status, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM pk)""")

_attach("mandatory_pages", f"""WITH {PKG_SQL},
pm AS (SELECT slug AS package, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM pk),
req AS (SELECT * FROM (VALUES ('overview', 'Overview', 'overview', 0), ('agents', 'For AI Agents', 'agents', 1),
                               ('getting-started', 'Getting Started', 'getting-started', 2)) v(page_type, title, slug, k))
SELECT package, w AS page_type, upper(w[1]) || w[2:] AS title, w AS slug,
  CASE WHEN i <= 2 THEN 'preview' ELSE 'full' END AS tier, CAST(i - 1 AS INTEGER) AS ord FROM pm
UNION ALL
SELECT p.package, req.page_type, req.title, req.slug, 'preview', CAST(-req.k - 3 AS INTEGER)
FROM (SELECT DISTINCT package FROM pm) p CROSS JOIN req
WHERE NOT EXISTS (SELECT 1 FROM pm WHERE pm.package = p.package AND pm.w = req.page_type)""")

_attach("faq_by_category", f"""WITH q AS (SELECT conv_id % 10 AS package, conv_id * 100 + turn AS ord,
  string_split(text, '. ')[1] AS question, substr(text, length(string_split(text, '. ')[1]) + 1) AS answer,
  {_title_case_sql("coalesce(CASE conv_id % 5 WHEN 0 THEN 'billing' WHEN 1 THEN NULL WHEN 2 THEN 'setup' WHEN 3 THEN 'api_keys' ELSE '' END, 'general')")} AS category
  FROM conversations)
SELECT package, category, min(ord) OVER (PARTITION BY package, category) AS cat_ord, ord, question, answer FROM q""")

_attach("upsert_by_slug", f"""WITH t AS (SELECT {_slug_sql('p_brand')} AS slug,
  arg_min(CASE p_partkey % 5 WHEN 0 THEN 'planning' WHEN 1 THEN 'preview_ready' WHEN 2 THEN 'full_ready' WHEN 3 THEN 'failed' ELSE 'submitted' END, p_partkey) AS status,
  arg_min(CASE WHEN p_size % 2 = 0 THEN 'paid' ELSE 'pending' END, p_partkey) AS payment_status,
  arg_min(p_brand, p_partkey) AS title FROM part GROUP BY 1),
s0 AS (SELECT CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_brand || ' ' || string_split(p_type, ' ')[1] END AS nm FROM part),
s AS (SELECT {_slug_sql('nm')} AS slug, min('Seed ' || nm) AS title, 'full_ready' AS status FROM s0 GROUP BY 1)
SELECT coalesce(t.slug, s.slug) AS slug, coalesce(t.status, s.status) AS status, t.payment_status,
  CASE WHEN s.slug IS NOT NULL THEN s.title ELSE t.title END AS title
FROM t FULL OUTER JOIN s ON t.slug = s.slug""")


def _clean_sql(x: str) -> str:
    s0 = _strip_sql(x)
    unf = (f"CASE WHEN starts_with({s0}, '```') THEN array_to_string(CASE WHEN len(string_split({s0}, chr(10))[2:]) > 0 "
           f"AND {_strip_sql(f'string_split({s0}, chr(10))[-1]')} = '```' AND len(string_split({s0}, chr(10))) > 1 "
           f"THEN string_split({s0}, chr(10))[2:-2] ELSE string_split({s0}, chr(10))[2:] END, chr(10)) ELSE {s0} END")
    return unf


_attach("clean_rewrites", lambda: f"""WITH r AS (SELECT {', '.join(fixtures.REWRITES_COLUMNS)} FROM documents),
a AS (SELECT site, ord, {_clean_sql('optimized_content')} AS s1 FROM r),
b AS (SELECT site, ord, {_strip_sql(_strip_sql("split_part(s1, '<!-- IMPROVEMENTS -->', 1)"))} AS s2 FROM a),
c AS (SELECT site, ord, {_strip_sql("split_part(s2, '## Improvements Made', 1)")} AS s3 FROM b),
d AS (SELECT site, ord, s3, string_split(s3, chr(10)) AS ls,
      list_position(list_transform(string_split(s3, chr(10)), lambda x: starts_with(regexp_replace(x, '^\\s+', ''), '---')), true) AS idx FROM c),
e AS (SELECT site, ord, {_strip_sql("CASE WHEN starts_with(s3, 'Here') AND idx > 0 THEN array_to_string(ls[idx:], chr(10)) ELSE s3 END")} AS s4 FROM d)
SELECT site, ord, md5(s4) AS clean_md5, CAST(length(s4) AS INTEGER) AS clean_chars FROM e""")

_attach("ordered_distinct_links", f"""WITH a AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1)) AS href0,
         unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 2)) AS txt0,
         generate_subscripts(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1), 1) AS k FROM pages),
b AS (SELECT page_id, url, k, {_unescape_sql('href0')} AS href, {_strip_sql(_unescape_sql('txt0'))} AS txt FROM a),
c AS (SELECT *, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN href
                     WHEN starts_with(href, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1) || href
                     ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || href END AS abs
      FROM b WHERE NOT regexp_matches(href, '(?i)(\\.png|\\.jpg|\\.gif|\\.svg|\\.css|\\.js|\\.woff|\\.pdf|mailto:|javascript:|#$|/login|/signup|/auth|/console|/search\\?|/changelog|/blog)')),
d AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS pos FROM c WHERE starts_with(abs, 'http') AND txt <> ''),
e AS (SELECT *, row_number() OVER (PARTITION BY page_id, txt ORDER BY pos) AS first FROM d)
SELECT {_site_sql('url')} AS site, page_id AS ord, CAST(pos AS INTEGER) AS pos, txt AS text,
  CASE WHEN abs = '' OR abs = '#' OR starts_with(abs, 'javascript:') THEN 'UNRESOLVED' ELSE abs END AS target
FROM e WHERE first = 1""")


GUIDES_BASE_SQL = f"""g AS (SELECT conv_id * 100 + turn AS guide_id, string_split(text, '. ') AS sent, string_split(text, ' ') AS w
                 FROM conversations WHERE {GUIDE_OK_SQL})"""


def _rows_sql(list_sql: str, label: str, col: str = "action") -> str:
    return (f"SELECT guide_id, '{label}' AS list, CAST(generate_subscripts({list_sql}, 1) - 1 AS INTEGER) AS pos, "
            f"unnest({list_sql}) AS {col} FROM g")


_THIRDS = [f"w[1:len(w) // 3]", "w[len(w) // 3 + 1:2 * (len(w) // 3)]", "w[2 * (len(w) // 3) + 1:]"]

_attach("guide_scope", f"""WITH {GUIDES_BASE_SQL}
{_rows_sql(_THIRDS[0], 'safe')} UNION ALL {_rows_sql(_THIRDS[1], 'confirm')} UNION ALL {_rows_sql(_THIRDS[2], 'never')}""")

_attach("guide_rules_setup", f"""WITH {GUIDES_BASE_SQL}
SELECT guide_id, list AS section, pos, action AS item FROM (
{_rows_sql('sent[1:1]', 'always')} UNION ALL {_rows_sql('sent[2:2]', 'never')} UNION ALL {_rows_sql('sent[3:3]', 'environment')} UNION ALL
{_rows_sql(_THIRDS[0], 'prerequisites')} UNION ALL {_rows_sql(_THIRDS[1], 'auth_methods')} UNION ALL
{_rows_sql(_THIRDS[2], 'required_secrets')} UNION ALL {_rows_sql('sent[1:1]', 'env_notes')})""")

_OLD_SQL = "(guide_id // 100) % 3 = 1"

_attach("guide_troubleshooting", f"""WITH {GUIDES_BASE_SQL},
t AS (SELECT guide_id, unnest(sent) AS s, generate_subscripts(sent, 1) - 1 AS pos FROM g)
SELECT guide_id, CAST(pos AS INTEGER) AS pos, s AS issue, string_split(s, ' ')[1] AS likely_cause,
  coalesce(string_split(s, ' ')[2], '') AS fix, CASE WHEN {_OLD_SQL} THEN string_split(s, ' ')[1] ELSE '' END AS escalate_if FROM t""")

_attach("guide_decisions", f"""WITH {GUIDES_BASE_SQL},
t AS (SELECT guide_id, unnest(sent) AS s, generate_subscripts(sent, 1) - 1 AS pos FROM g)
SELECT guide_id, CAST(pos AS INTEGER) AS pos, s AS decision, CAST(len(string_split(s, ' ')) AS INTEGER) AS n_use,
  string_split(s, ' ')[1] AS escalate FROM t""")

_attach("guide_references", f"""WITH {GUIDES_BASE_SQL},
t AS (SELECT guide_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS pos, len(w) // 3 AS third FROM g)
SELECT guide_id, CAST(pos AS INTEGER) AS pos,
  CASE WHEN {_OLD_SQL} THEN CASE WHEN pos < third THEN 'API' ELSE 'More' END WHEN pos % 2 = 0 THEN 'API' ELSE '' END AS topic, x AS label,
  'https://docs.example.com/' || x AS url FROM t WHERE NOT {_OLD_SQL} OR pos < 2 * third""")


@query("package_errors", f"""WITH {GUIDES_BASE_SQL},
t AS (SELECT guide_id, unnest(sent) AS s, generate_subscripts(sent, 1) - 1 AS pos FROM g)
SELECT guide_id, CAST(pos AS INTEGER) AS pos, s AS error, string_split(s, ' ')[1] AS likely_cause,
  CASE WHEN {_OLD_SQL} THEN '' ELSE 'retry' END AS fix, '' AS escalate_if FROM t""")
def q_package_errors(spark, sf):
    return G.package_errors(_parsed(spark, sf))


_attach("read_fetched_pages", f"""WITH {PAGE_CONTENT_SQL},
f AS (SELECT page_id, url, html, content, art,
        CASE page_id % 5 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN NULL WHEN 2 THEN 'text/plain'
             WHEN 3 THEN 'application/xhtml+xml' ELSE 'application/octet-stream' END AS ctype,
        CASE WHEN page_id % 7 = 3 THEN 404 ELSE 200 END AS status FROM pc)
SELECT {_site_sql('url')} AS site, url,
  CAST(CASE WHEN ctype = 'text/plain' THEN length(html) ELSE length(content) END AS INTEGER) AS content_chars,
  CAST(CASE WHEN ctype = 'text/plain' THEN 0 ELSE len(regexp_extract_all(art, '<h[1-6][\\s>]')) END AS INTEGER) AS n_headings,
  ctype IS DISTINCT FROM 'text/plain' AS has_title
FROM f WHERE status = 200""")


def _ordered_distinct_sql(lst: str) -> str:
    return f"list_filter({lst}, lambda x, i: list_position({lst}, x) = i)"


_PB_CONFIRM = "flatten(list_transform(sent, lambda s: string_split(s, ' ')[3:4]))"
_PB_ESCALATE = "flatten(list_transform(sent, lambda s: string_split(s, ' ')[4:5]))"
_AMB = "sent[-1:]"
_BASE_ASK = "(CASE WHEN turn % 2 = 0 THEN [] ELSE sent[1:2] END)"
_BASE_ESC = "(CASE WHEN turn % 3 = 0 THEN [] ELSE sent[2:3] END)"
_ASK = (f"CASE WHEN len({_BASE_ASK}) = 0 THEN list_concat({_AMB}, list_filter({_ordered_distinct_sql(_PB_CONFIRM)}, "
        f"lambda x: NOT list_contains({_AMB}, x))) ELSE {_BASE_ASK} END")
_ESC = f"CASE WHEN len({_BASE_ESC}) = 0 THEN {_ordered_distinct_sql(_PB_ESCALATE)} ELSE {_BASE_ESC} END"

_attach("guide_stop_conditions", f"""WITH g AS (SELECT conv_id * 100 + turn AS guide_id, turn, {GUIDE_OK_SQL} AS ok,
  string_split(text, '. ') AS sent FROM conversations),
s AS (SELECT guide_id, ok, CASE WHEN ok THEN {_ASK} ELSE [] END AS ask, CASE WHEN ok THEN {_ESC} ELSE [] END AS esc FROM g)
SELECT guide_id, ok, CAST(len(ask) AS INTEGER) AS n_ask, CAST(len(esc) AS INTEGER) AS n_escalate,
  md5(array_to_string(ask, chr(10))) AS ask_md5 FROM s""")


@query("score_trend_summary", """WITH h AS (SELECT 'site' || CAST(user_id % 50 AS VARCHAR) AS site, ts, event_id,
  CAST(CAST(trunc(abs(value)) AS BIGINT) % 101 AS INTEGER) AS score FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY ts DESC, event_id DESC) AS rn FROM h),
a AS (SELECT site, max(CASE WHEN rn = 1 THEN score END) AS l, max(CASE WHEN rn = 2 THEN score END) AS p FROM r WHERE rn <= 2 GROUP BY site),
b AS (SELECT site, coalesce(CASE WHEN l <> 0 THEN l END, 0) AS current_score, p FROM a)
SELECT site, current_score, CASE WHEN p IS NOT NULL AND p <> 0 THEN p ELSE current_score END AS previous_score,
  current_score - CASE WHEN p IS NOT NULL AND p <> 0 THEN p ELSE current_score END AS trend FROM b""")
def q_score_trend_summary(spark, sf):
    return history.score_trend_summary(records.score_history(spark, sf))


# --- rewrite validation as a recursive CTE (one step per line) ----------------------

def _validate_cte() -> str:
    run = fixtures.REWRITE_RUN_DATE
    date_rx = r"(?m)^(last_updated:\s*[\"']?)(\d{4}-\d{2}-\d{2})([\"']?\s*)$"
    st = "regexp_replace(ls[i + 1], '^\\s+|\\s+$', '', 'g')"
    low = "lower(ls[i + 1])"
    fence = f"starts_with({st}, '```')"
    pipe = f"starts_with({st}, '|')"
    head = f"starts_with({st}, '#')"
    err_kw = f"(contains({low}, 'error') OR contains({low}, 'troubleshoot') OR (contains({low}, 'cause') AND contains({low}, 'fix')))"
    head_kw = f"(contains({low}, 'troubleshoot') OR contains({low}, 'common error') OR contains({low}, 'error code'))"
    skipping = f"(head AND NOT {head})"
    open_fab = f"(NOT fence AND {fence} AND NOT has_code)"
    keep_fence = f"(NOT fence AND {fence} AND has_code)"
    reaches = f"(NOT {skipping} AND NOT {fence} AND NOT fence)"
    err_row = f"({pipe} AND {err_kw} AND no_errors)"
    tcont = f"(tbl AND {pipe})"
    fab_head = f"({head} AND {head_kw} AND no_errors)"
    counted = f"({reaches} AND NOT {err_row} AND NOT {tcont} AND {fab_head})"
    drop = (f"(CASE WHEN {skipping} THEN true WHEN {keep_fence} THEN false WHEN fence THEN true "
            f"ELSE ({open_fab} OR {err_row} OR {tcont} OR {fab_head}) END)")
    return f"""RECURSIVE rw AS (SELECT {', '.join(fixtures.REWRITES_COLUMNS)} FROM documents),
{FLAT_PAGES_SQL},
jn AS (SELECT rw.site, rw.ord, rw.optimized_content AS oc,
         (sp.code_txt IS NOT NULL) OR contains(coalesce(sp.content, ''), '```') AS has_code,
         NOT contains(lower(coalesce(sp.content, '')), 'error') AND NOT contains(lower(coalesce(sp.content, '')), 'troubleshoot') AS no_errors
       FROM rw JOIN sp ON rw.site = sp.site AND rw.ord = sp.ord),
dt AS (SELECT *, regexp_extract(oc, {OR.q(date_rx)}, 2) AS first_date FROM jn),
dd AS (SELECT site, ord, oc, has_code, no_errors,
         CASE WHEN first_date <> '' AND first_date <> '{run}' THEN regexp_replace(oc, {OR.q(date_rx)}, '\\1{run}\\3', 'g') ELSE oc END AS dated
       FROM dt),
st AS (SELECT site, ord, oc, dated, has_code, no_errors, string_split(dated, chr(10)) AS ls, 0 AS i, []::VARCHAR[] AS out,
         false AS fence, false AS tbl, false AS head, 0 AS blocks, 0 AS rws, 0 AS sections FROM dd
       UNION ALL
       SELECT site, ord, oc, dated, has_code, no_errors, ls, i + 1,
         CASE WHEN {drop} THEN out ELSE list_append(out, ls[i + 1]) END,
         CASE WHEN {skipping} THEN fence WHEN {open_fab} THEN true WHEN fence AND {fence} THEN false ELSE fence END,
         CASE WHEN NOT {reaches} THEN tbl WHEN {err_row} THEN true WHEN tbl AND {pipe} THEN true ELSE false END,
         {skipping} OR {counted},
         blocks + CASE WHEN NOT {skipping} AND {open_fab} THEN 1 ELSE 0 END,
         rws + CASE WHEN {reaches} AND ({err_row} OR {tcont}) THEN 1 ELSE 0 END,
         sections + CASE WHEN {counted} THEN 1 ELSE 0 END
       FROM st WHERE i < len(ls)),
val AS (SELECT site, ord, array_to_string(out, chr(10)) AS validated, dated <> oc AS date_fixed,
          CAST(blocks AS INTEGER) AS blocks_removed, CAST(rws AS INTEGER) AS table_rows_removed,
          CAST(sections AS INTEGER) AS sections_removed FROM st WHERE i = len(ls))"""


_attach("validate_rewrites", lambda: f"""WITH {_validate_cte()}
SELECT site, ord, md5(validated) AS validated_md5, date_fixed, blocks_removed, table_rows_removed, sections_removed FROM val""")


_attach("fabrication_report", lambda: f"""WITH {_validate_cte()}
SELECT site, CAST(count(*) AS BIGINT) AS docs, CAST(sum(CAST(date_fixed AS INTEGER)) AS BIGINT) AS dates_fixed,
  CAST(sum(blocks_removed) AS BIGINT) AS blocks_removed, CAST(sum(table_rows_removed) AS BIGINT) AS table_rows_removed,
  CAST(sum(sections_removed) AS BIGINT) AS sections_removed FROM val GROUP BY site""")


def _claimed_cte() -> str:
    marker = RW.IMPROVEMENTS_MARKER
    strip = _strip_sql
    derived_items = [
        ("vague IS NOT NULL", "vague"), ("NOT has_action", "headings"),
        ("NOT has_tables AND len(list_filter(issues, lambda x: contains(lower(x), 'parameter'))) > 0", "params"),
        ("NOT complete AND has_code", "code"), ("implicit IS NOT NULL", "implicit"),
        ("NOT errors AND has_code AND contains(lower(validated), 'error') AND (contains(lower(validated), '| error') "
         "OR contains(lower(validated), '| code'))", "errors"),
        ("NOT front", "frontmatter"),
        ("NOT prereq AND contains(validated, 'prerequisites:') AND contains(coalesce(string_split(validated, "
         "'prerequisites:')[2], ''), '- ')", "prereq"),
        ("NOT output AND has_code AND contains(validated, '```') AND (contains(lower(validated), 'output') OR "
         "contains(lower(validated), 'response') OR contains(lower(validated), 'returns'))", "outputs"),
        ("marketing IS NOT NULL", "marketing"), ("NOT version AND contains(lower(validated), 'version')", "version")]
    derived = "list_filter([" + ", ".join(f"CASE WHEN {cond} THEN {OR.q(RW.DERIVED_IMPROVEMENTS[k])} END"
                                          for cond, k in derived_items) + "], lambda x: x IS NOT NULL)"
    after = f"CASE WHEN contains(validated, {OR.q(marker)}) THEN string_split(validated, {OR.q(marker)})[2] END"
    items = f"list_transform(string_split({strip(f'coalesce({after}, {OR.q(str())})')}, chr(10)), lambda x: {strip('x')})"
    bullets = f"list_filter({items}, lambda x: starts_with(x, '- ') OR starts_with(x, '* '))"
    marked = f"list_filter(list_transform({bullets}, lambda x: {strip('x[3:]')}), lambda x: length(x) > 5)"
    return f"""{_validate_cte()}, {_diag_cte().replace(FLAT_PAGES_SQL + ',', '', 1)},
ci AS (SELECT v.site, v.ord, v.validated, d.*EXCLUDE (site, ord), {marked} AS marked FROM val v JOIN diag d USING (site, ord)),
cl AS (SELECT site, ord, validated, CASE WHEN len(marked) > 0 THEN marked
        WHEN len({derived}) = 0 THEN [{OR.q(RW.DEFAULT_IMPROVEMENT)}] ELSE {derived} END AS improvements FROM ci)"""


_attach("claimed_improvements", lambda: f"""WITH {_claimed_cte()}
SELECT site, ord, CAST(len(improvements) AS INTEGER) AS n_improvements, array_to_string(improvements, ' | ') AS improvements FROM cl""")

_attach("improvement_summary", lambda: f"""WITH {_claimed_cte()},
ex AS (SELECT site, unnest(improvements) AS imp FROM cl)
SELECT c.site, CAST(count(*) AS BIGINT) AS pages_optimized, CAST(sum(len(improvements)) AS BIGINT) AS total_improvements,
  CAST(coalesce(max(u.n), 0) AS BIGINT) AS unique_improvements
FROM cl c LEFT JOIN (SELECT site, count(DISTINCT imp) AS n FROM ex GROUP BY site) u USING (site) GROUP BY c.site""")

_attach("viewer_index", f"""WITH rw AS (SELECT {', '.join(fixtures.REWRITES_COLUMNS)} FROM documents),
ok AS (SELECT 'src' || CAST(c_custkey AS VARCHAR) AS site FROM customer WHERE c_acctbal > 0 AND c_custkey % 4 = 0),
f AS (SELECT site, ord, title, url, regexp_replace(lower(replace(regexp_replace({PATH_SQL.format(u='url')}, '^/+|/+$', '', 'g'), '/', '-')),
        '\\.(html?|php|aspx?)$', '') || '.md' AS file_name FROM rw WHERE site IN (SELECT site FROM ok)),
r AS (SELECT *, row_number() OVER (PARTITION BY site, file_name ORDER BY ord) AS rn FROM f)
SELECT site, file_name, title, url FROM r WHERE rn = 1""")


def _llms_sql() -> str:
    fname = (f"regexp_replace(lower(replace(regexp_replace({PATH_SQL.format(u='url')}, '^/+|/+$', '', 'g'), '/', '-')), "
             f"'\\.(html?|php|aspx?)$', '') || '.md'")
    cat = _title_case_sql(f"string_split(replace({fname}, '.md', ''), '-')[1]")
    return f"""WITH {_claimed_cte()},
docs AS (SELECT cl.site, cl.ord, rw.title, rw.url, cl.improvements, {cat} AS cat FROM cl JOIN rw USING (site, ord)),
fs AS (SELECT site, cat, min(ord) AS cat_ord FROM docs GROUP BY site, cat),
ps AS (SELECT site, count(*) AS pages, arg_min(url, ord) AS first_url FROM docs GROUP BY site)
SELECT site, 0 AS section, CAST(0 AS BIGINT) AS cat_ord, CAST(0 AS BIGINT) AS ord,
  replace(replace({OR.q(RW.LLMS_HEADER)}, '{{domain}}', coalesce(nullif({NETLOC_SQL.format(u='first_url')}, ''), first_url)),
          '{{base_url}}', first_url) AS line FROM ps
UNION ALL SELECT site, 1, cat_ord, CAST(-1 AS BIGINT), '## ' || cat FROM fs
UNION ALL SELECT d.site, 1, fs.cat_ord, d.ord, '  - [' || coalesce(d.title, '') || '](' || coalesce(d.url, '') || '): '
  || coalesce(d.improvements[1], {OR.q(RW.LLMS_DEFAULT_NOTE)}) FROM docs d JOIN fs USING (site, cat)
UNION ALL SELECT site, 2, CAST(0 AS BIGINT), CAST(0 AS BIGINT), replace({OR.q(RW.LLMS_FOOTER)}, '{{pages}}', CAST(pages AS VARCHAR)) FROM ps"""


_attach("llms_txt", _llms_sql)


def _dedent_sql() -> str:
    strip = _strip_sql
    line = "ls[i + 1]"
    lstr = f"regexp_replace({line}, '^\\s+', '')"
    ind = f"(length({line}) - length({lstr}))"
    opens = f"(indent < 0 AND starts_with({lstr}, '```') AND {ind} >= 2)"
    closes = f"(indent >= 0 AND starts_with({lstr}, '```') AND length({lstr}) <= 4)"
    body = f"(CASE WHEN starts_with({line}, repeat(' ', greatest(indent, 0))) THEN {line}[indent + 1:] ELSE {lstr} END)"
    return f"""WITH {_claimed_cte()},
ca AS (SELECT site, ord, {_clean_sql('validated')} AS s1 FROM cl),
cb AS (SELECT site, ord, {strip(strip("split_part(s1, '<!-- IMPROVEMENTS -->', 1)"))} AS s2 FROM ca),
cc AS (SELECT site, ord, {strip("split_part(s2, '## Improvements Made', 1)")} AS s3 FROM cb),
cd AS (SELECT site, ord, s3, string_split(s3, chr(10)) AS ls2,
       list_position(list_transform(string_split(s3, chr(10)), lambda x: starts_with(regexp_replace(x, '^\\s+', ''), '---')), true) AS idx FROM cc),
ce AS (SELECT site, ord, {strip("CASE WHEN starts_with(s3, 'Here') AND idx > 0 THEN array_to_string(ls2[idx:], chr(10)) ELSE s3 END")} AS content FROM cd),
dr AS (SELECT site, ord, string_split(content, chr(10)) AS ls, 0 AS i, []::VARCHAR[] AS out, -1 AS indent FROM ce
       UNION ALL
       SELECT site, ord, ls, i + 1,
         CASE WHEN {opens} THEN list_concat(out, ['', '```' || {strip(f'{lstr}[4:]')}])
              WHEN {closes} THEN list_concat(out, ['```', ''])
              WHEN indent >= 0 THEN list_append(out, {body})
              ELSE list_append(out, {line}) END,
         CASE WHEN {opens} THEN {ind} WHEN {closes} THEN -1 ELSE indent END
       FROM dr WHERE i < len(ls))
SELECT site, ord, md5(array_to_string(CASE WHEN indent >= 0 THEN list_concat(out, ['```', '']) ELSE out END, chr(10))) AS dedented_md5
FROM dr WHERE i = len(ls)"""


_attach("dedent_fences", lambda: "WITH RECURSIVE " + _dedent_sql()[len("WITH "):].replace("RECURSIVE ", "", 1))


def _reachable_sql() -> str:
    norm = lambda u: f"regexp_replace(regexp_replace({u}, '#.*$', ''), '/+$', '')"
    return f"""WITH RECURSIVE {PAGE_CONTENT_SQL},
pg AS (SELECT {_site_sql('url')} AS site, page_id, url, {norm('url')} AS nurl, length({_strip_sql('content')}) > 50 AS substantial,
       html FROM pc),
starts AS (SELECT site, arg_min(nurl, page_id) AS start FROM pg GROUP BY site),
a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1)) AS href0,
        unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 2)) AS txt0,
        generate_subscripts(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1), 1) AS k FROM pages),
b AS (SELECT page_id, url, k, {_unescape_sql('href0')} AS href, {_strip_sql(_unescape_sql('txt0'))} AS txt FROM a),
c AS (SELECT *, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN href
                     WHEN starts_with(href, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1) || href
                     ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || href END AS abs
      FROM b WHERE NOT regexp_matches(href, '(?i)(\\.png|\\.jpg|\\.gif|\\.svg|\\.css|\\.js|\\.woff|\\.pdf|mailto:|javascript:|#$|/login|/signup|/auth|/console|/search\\?|/changelog|/blog)')),
d AS (SELECT page_id, url, abs, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS pos FROM c
      WHERE starts_with(abs, 'http') AND txt <> ''),
lk AS (SELECT {_site_sql('d.url')} AS site, {norm('d.url')} AS src, {norm('abs')} AS dst, min(pos) AS pos
       FROM d JOIN starts s ON s.site = {_site_sql('d.url')}
       WHERE {norm('abs')} <> '' AND {NETLOC_SQL.format(u=norm('abs'))} = {NETLOC_SQL.format(u='s.start')}
         AND starts_with({PATH_SQL.format(u=norm('abs'))}, regexp_replace({PATH_SQL.format(u='s.start')}, '/+$', ''))
       GROUP BY 1, 2, 3),
walk AS (SELECT site, start AS url, 0 AS depth, []::INTEGER[] AS path, [start] AS seen FROM starts
         UNION
         SELECT w.site, lk.dst, w.depth + 1, list_append(w.path, CAST(lk.pos AS INTEGER)), list_append(w.seen, lk.dst)
         FROM walk w JOIN (SELECT DISTINCT site, nurl FROM pg) f ON f.site = w.site AND f.nurl = w.url
              JOIN lk ON lk.site = w.site AND lk.src = w.url WHERE NOT list_contains(w.seen, lk.dst)),
best AS (SELECT site, url, min(depth) AS depth FROM walk GROUP BY site, url),
bp AS (SELECT w.site, w.url, w.depth, min(w.path) AS path FROM walk w JOIN best b USING (site, url, depth) GROUP BY 1, 2, 3)
SELECT bp.site, bp.url, bp.depth, array_to_string(bp.path, '.') AS path FROM bp
WHERE EXISTS (SELECT 1 FROM pg WHERE pg.site = bp.site AND pg.nurl = bp.url AND pg.substantial)"""


_attach("reachable_pages", _reachable_sql)


def _discover_sql() -> str:
    vp = ("NOT regexp_matches(lower({p}), '/assets/|/images/|/css/|/js/|/api/|/admin/|/login/|/logout/|"
          "\\.pdf|\\.jpg|\\.png|\\.gif|\\.css|\\.js')")
    return f"""WITH p AS (SELECT {_site_sql('url')} AS site, page_id, url FROM pages),
s AS (SELECT site, min(page_id) AS first_id, arg_min(url, page_id) AS start FROM p GROUP BY site),
r AS (SELECT p.site, p.url, s.first_id, s.start, row_number() OVER (PARTITION BY p.site ORDER BY p.page_id) - 1 AS rk
      FROM p JOIN s USING (site)),
locs AS (SELECT site, first_id, start, url, 2 * rk AS pos FROM r UNION ALL SELECT site, first_id, start, url || '/img.png', 2 * rk + 1 FROM r),
ok AS (SELECT * FROM locs WHERE first_id % 5 <> 0 AND {NETLOC_SQL.format(u='url')} = {NETLOC_SQL.format(u='start')}),
src1 AS (SELECT site, url, 1 AS src, 0 AS grp, pos FROM ok WHERE length(site) % 2 = 0),
src2 AS (SELECT site, url, 2 AS src, 0 AS grp, pos FROM ok),
a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1)) AS href0,
        unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 2)) AS txt0,
        generate_subscripts(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1), 1) AS k
      FROM pages WHERE page_id IN (SELECT first_id FROM s)),
b AS (SELECT page_id, url, k, {_unescape_sql('href0')} AS href, {_strip_sql(_unescape_sql('txt0'))} AS txt FROM a),
c AS (SELECT *, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN href
                     WHEN starts_with(href, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1) || href
                     ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || href END AS abs
      FROM b WHERE NOT regexp_matches(href, '(?i)(\\.png|\\.jpg|\\.gif|\\.svg|\\.css|\\.js|\\.woff|\\.pdf|mailto:|javascript:|#$|/login|/signup|/auth|/console|/search\\?|/changelog|/blog)')),
d AS (SELECT page_id, url, abs, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS pos FROM c
      WHERE starts_with(abs, 'http') AND txt <> ''),
e AS (SELECT {_site_sql('url')} AS site, abs AS url, pos, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM d
      WHERE {NETLOC_SQL.format(u='abs')} = {NETLOC_SQL.format(u='url')} AND {vp.format(p=PATH_SQL.format(u='abs'))}),
src3 AS (SELECT site, url, 3 AS src, 0 AS grp, pos FROM e),
allsrc AS (SELECT * FROM src1 UNION ALL SELECT * FROM src2 UNION ALL SELECT * FROM src3),
ch AS (SELECT site, min(src) AS src FROM allsrc GROUP BY site),
picked AS (SELECT a.* FROM allsrc a JOIN ch USING (site, src)
           UNION ALL SELECT site, start, 0, -1, -1 FROM s),
rk AS (SELECT *, row_number() OVER (PARTITION BY site, url ORDER BY grp, pos, src) AS k FROM picked)
SELECT site, url, src, CAST(grp AS BIGINT) AS grp, CAST(pos AS BIGINT) AS pos FROM rk WHERE k = 1"""


_attach("discover_urls", _discover_sql)


# --- page-level signals -----------------------------------------------

TEXT_SIGNALS = ["r1_pass", "r5_pass", "r6_err", "r6_fix", "r9_prereq", "r13_pass", "r14_any", "r15_pass", "r16_pass",
                "r18_pass", "r19_state", "r19_arrow", "r20_pass"]
STRUCTURE_SIGNALS = ["r2_total", "r2_action", "r3_params", "r3_tables", "r4_code", "r4_complete", "r8_pass",
                     "r9_howto", "r10_code", "r10_pass", "r11_linked", "r11_pass", "r17_good"]


def _signals(spark, sf, cols):
    sig = rules.page_signals(_pages(spark, sf), keep=("site", "ord"))
    return sig.select("site", "ord", *[F.col(c).cast("double" if c == "r17_good" else "long").alias(c) for c in cols])


def _signals_sql(cols) -> str:
    sel = ", ".join(f"CAST({c} AS {'DOUBLE' if c == 'r17_good' else 'BIGINT'}) AS {c}" for c in cols)
    return OR.rules_cte() + f"\nSELECT site, ord, {sel} FROM sig"


@query("page_signals_text", lambda: _signals_sql(TEXT_SIGNALS))
def q_page_signals_text(spark, sf):
    return _signals(spark, sf, TEXT_SIGNALS)


@query("page_signals_structure", lambda: _signals_sql(STRUCTURE_SIGNALS))
def q_page_signals_structure(spark, sf):
    return _signals(spark, sf, STRUCTURE_SIGNALS)


@query("heading_action_ratio", lambda: OR.rules_cte() + """
SELECT site, r2_action AS action_headings, r2_total AS headings,
  CASE WHEN r2_total = 0 THEN NULL ELSE round(r2_action / r2_total, 6) END AS ratio FROM sums""")
def q_heading_action_ratio(spark, sf):
    s = rules.site_signal_sums(_pages(spark, sf))
    return s.select("site", F.col("r2_action").alias("action_headings"), F.col("r2_total").alias("headings"),
                    F.when(F.col("r2_total") == 0, F.lit(None).cast("double"))
                    .otherwise(F.round(F.col("r2_action") / F.col("r2_total"), 6)).alias("ratio"))


@query("content_types", lambda: OR.rules_cte() + """
SELECT site, r12_0 > 0 AS conceptual, r12_1 > 0 AS how_to, r12_2 > 0 AS reference FROM sums""")
def q_content_types(spark, sf):
    s = rules.site_signal_sums(_pages(spark, sf))
    return s.select("site", (F.col("r12_0") > 0).alias("conceptual"), (F.col("r12_1") > 0).alias("how_to"),
                    (F.col("r12_2") > 0).alias("reference"))


def _term_conflicts_sql() -> str:
    from .. import constants as KK
    parts = []
    for g, (terms, label) in enumerate(KK.R7_TERM_GROUPS):
        found = " + ".join(f"(CASE WHEN r7_g{g}_t{t} > 0 THEN 1 ELSE 0 END)" for t in range(len(terms)))
        parts.append(f"SELECT site, {OR.q(label)} AS term_group, CAST({found} AS INTEGER) AS terms_found, "
                     f"({found}) >= {KK.R7_CONFLICT_AT} AS conflict FROM sums")
    return OR.rules_cte() + "\n" + "\nUNION ALL\n".join(parts)


@query("terminology_conflicts", _term_conflicts_sql)
def q_terminology_conflicts(spark, sf):
    from .. import constants as KK
    s = rules.site_signal_sums(_pages(spark, sf))
    rows = []
    for g, (terms, label) in enumerate(KK.R7_TERM_GROUPS):
        found = sum(((F.col(f"r7_g{g}_t{t}") > 0).cast("int") for t in range(len(terms))), F.lit(0))
        rows.append(F.struct(F.lit(label).alias("term_group"), found.cast("int").alias("terms_found"),
                             (found >= KK.R7_CONFLICT_AT).alias("conflict")))
    return s.select("site", F.inline_outer(F.array(*rows)))


# --- agent pages, prices, organization joins and scalar functions ---------------------------

AGENT_SQL = f"""ag AS (SELECT p_partkey AS id, p_name AS product_name, {_slug_sql('p_brand')} || '-' || CAST(p_partkey AS VARCHAR) AS slug,
  'https://docs.example.com/' || CAST(p_partkey AS VARCHAR) AS docs_url, 'owner' || CAST(p_partkey % 7 AS VARCHAR) || '@example.com' AS email,
  {str(records.AGENT_PAGE_STATES)}[p_partkey % 7 + 1] AS status, CASE WHEN p_size % 2 = 0 THEN 'paid' ELSE 'pending' END AS payment_status,
  CASE WHEN p_partkey % 7 = 6 THEN 'timed out' END AS error_message, p_partkey * 7919 % 100000 AS created FROM part)"""


@query("ready_agent_pages", f"""WITH {AGENT_SQL}
SELECT CAST(row_number() OVER (ORDER BY created, id) AS INTEGER) AS position, product_name, slug, status, payment_status
FROM ag WHERE status IN ('full_ready', 'draft_ready')""")
def q_ready_agent_pages(spark, sf):
    return RQ.ready_agent_pages(records.agent_pages(spark, sf))


@query("retryable_jobs", f"""WITH {AGENT_SQL},
r AS (SELECT *, id % 2 = 0 AS asked, status IN ('failed', 'submitted', 'crawling', 'generating') AS again FROM ag)
SELECT id, slug, CASE WHEN asked AND again THEN 'submitted' ELSE status END AS status,
  CASE WHEN asked AND again THEN NULL ELSE error_message END AS error_message,
  CASE WHEN asked AND again THEN docs_url || '/new' ELSE docs_url END AS docs_url, asked AND again AS retried FROM r""")
def q_retryable_jobs(spark, sf):
    jobs = records.agent_pages(spark, sf)
    # owners of every second job ask again; strangers' requests for the others change nothing
    email = F.when(F.col("id") % 2 == 0, F.col("email")).otherwise(F.concat(F.lit("x"), F.col("email")))
    requests = jobs.select("slug", email.alias("email"), F.concat("docs_url", F.lit("/new")).alias("docs_url"))
    return RQ.retry(jobs, requests).select("id", "slug", "status", "error_message", "docs_url", "retried")


@query("org_recommendations", """SELECT p_partkey AS id, p_partkey % 200 AS site_id, c_name AS site_name, n_name AS organization
FROM part JOIN customer ON c_custkey = p_partkey % 200 JOIN nation ON n_nationkey = c_nationkey""")
def q_org_recommendations(spark, sf):
    out = RQ.org_recommendations(records.recommendations_table(spark, sf), records.sites(spark, sf), records.organizations(spark, sf))
    return out.select("id", "site_id", "site_name", "organization")


@query("prices", """SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 84 WHEN 1 THEN 0 WHEN 2 THEN 1 END AS price_eur, c_custkey % 4 <> 3 AS valid FROM customer""")
def q_prices(spark, sf):
    code = F.element_at(F.array(F.lit(None).cast("string"), F.lit("free100"), F.lit("Beta2025"), F.lit("other")), (F.col("id") % 4 + 1).cast("int"))
    return RQ.prices(records.assessments(spark, sf).withColumn("promo_code", code)).select("id", "price_eur", "valid")


@query("public_gallery_seeded", """WITH paid AS (SELECT c_custkey AS id, c_name AS site_name FROM customer WHERE c_acctbal > 0 AND c_custkey % 4 = 0
  ORDER BY c_custkey DESC LIMIT 24)
SELECT CAST(0 AS INTEGER) AS src, CAST(r_regionkey AS BIGINT) AS id, r_name AS site_name FROM region UNION ALL SELECT 1, id, site_name FROM paid""")
def q_public_gallery_seeded(spark, sf):
    seeds = records.read(spark, sf, "region").select(
        F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("site_name"), F.lit(90).alias("score"), F.lit("A").alias("grade"),
        F.lit(1).alias("page_count"), F.timestamp_seconds(F.lit(1600000000)).alias("created_at"))
    return RQ.public_gallery(records.assessments(spark, sf), seeds).select("src", "id", "site_name")


def _grade_text_sql() -> str:
    from .. import constants as KK
    g = OR.grade_sql("score")
    return f"CASE {g} " + " ".join(f"WHEN {OR.q(k)} THEN {OR.q(v)}" for k, v in KK.GRADE_TEXT.items()) + " ELSE 'Unknown' END"


@query("scalar_texts", lambda: f"""WITH s AS (SELECT o_orderkey AS id, CAST((o_orderkey * 37) % 101 AS INTEGER) AS score, o_orderkey % 4 AS k,
  o_orderstatus AS st, CAST(o_orderkey % 101 AS INTEGER) AS progress FROM orders)
SELECT id, {_grade_text_sql()} AS interpretation, CAST(CAST(floor(score / 101 * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%' AS percent,
  CASE k WHEN 0 THEN 'body ' || CAST(id AS VARCHAR) WHEN 1 THEN '--- open' ELSE 'plain' END AS body,
  'a &lt; b &amp; &quot;c&quot;' || CAST(k AS VARCHAR) AS escaped,
  CASE WHEN st = 'O' THEN {str(['crawling', 'analyzing', 'scoring', 'generating recommendations'])}[least(progress // 25, 3) + 1] END AS stage,
  CASE WHEN k = 3 THEN CAST(0 AS BIGINT) ELSE CAST(round(k * 90.5) AS BIGINT) END AS seconds FROM s""")
def q_scalar_texts(spark, sf):
    a = records.analyses(spark, sf)
    score, k = ((F.col("id") * 37) % 101).cast("int"), F.col("id") % 4
    doc = F.when(k == 0, F.concat(F.lit("---\ntitle: x\n---\n\nbody "), F.col("id").cast("string"))).when(k == 1, "--- open").otherwise("plain")
    html = F.concat(F.when(k % 2 == 0, 'a &lt; b &amp; "c"').otherwise('a < b & &quot;c&quot;'), k.cast("string"))
    end = F.when(k != 3, F.timestamp_micros((k * 90500000).cast("long")))
    return a.select("id", TX.interpretation(TX.grade(score)).alias("interpretation"), TX.percent_text(score / 101).alias("percent"),
                    TX.strip_frontmatter(doc).alias("body"), TX.html_escape(html).alias("escaped"),
                    history.progress_stage(F.col("progress"), F.col("status")).alias("stage"),
                    history.duration_seconds(F.timestamp_micros(F.lit(0).cast("long")), end).alias("seconds"))


@query("distinct_urls", """WITH n AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS norm FROM pages
  UNION ALL SELECT page_id + 1000000, url || '#again', regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') FROM pages)
SELECT min(page_id) AS ord, arg_min(url, page_id) AS url FROM n WHERE norm <> '' GROUP BY norm""")
def q_distinct_urls(spark, sf):
    pages = P.raw_pages(spark, sf).select(F.col("page_id").alias("ord"), "url")
    again = pages.select((F.col("ord") + 1000000).alias("ord"), F.concat("url", F.lit("#again")).alias("url"))
    return RQ.dedupe_urls(pages.unionByName(again)).select("ord", "url")


@query("extra_rule", """SELECT source AS site, CAST(count(*) AS BIGINT) AS pages,
  CAST(sum(CASE WHEN doc_id % 6 = 2 THEN 1 ELSE 0 END) AS BIGINT) AS with_tables FROM documents GROUP BY source""")
def q_extra_rule(spark, sf):
    """A rule beyond the twenty, declared as data and evaluated in the same aggregate."""
    spec = rules.RuleSpec(rule_id=21, name="Has tables", short_name="tables", component="extra", signals={"r21_pass": lambda c: c.has_tables.cast("int")},
                          result=lambda a, n: (F.lit(0), n, a("r21_pass"), F.lit("")))
    sums = rules.site_signal_sums(_pages(spark, sf), [*rules.RULE_SPECS, spec])
    return sums.select("site", F.col("n").alias("pages"), F.col("r21_pass").alias("with_tables"))


STRUCTURE_HTML = """CASE WHEN strpos(html, '</article>') > 0 THEN replace(html, '</article>', concat(
  CASE WHEN page_id % 3 = 0 THEN '<table><tr><td>x</td></tr></table>' ELSE '' END,
  CASE WHEN page_id % 4 < 2 THEN '<h3>Third</h3><h2>Second</h2>' ELSE '' END,
  CASE WHEN page_id % 5 = 1 THEN '<pre><code class="a language-sql">SELECT 1</code></pre>' WHEN page_id % 5 = 2 THEN '<pre>plain</pre>' ELSE '' END,
  '<nav><a href="/inner-nav">inner</a></nav>',
  CASE WHEN page_id % 2 = 0 THEN '<a href="/kept-a">A</a><a href="/kept-a">A2</a><a href="../up/b">B</a>' ELSE '' END, '</article>')) ELSE html END"""


@query("page_structure", """SELECT page_id, page_id % 3 = 0 AS has_tables, CAST(CASE WHEN page_id % 2 = 0 THEN 2 ELSE 0 END AS INTEGER) AS n_links,
  CASE WHEN page_id % 4 < 2 THEN 'Second|Third' ELSE '' END AS lower_headings, CASE WHEN page_id % 4 < 2 THEN 'Third|Second' ELSE '' END AS flat_tail,
  CASE page_id % 5 WHEN 1 THEN 'sql:SELECT 1' WHEN 2 THEN '-:plain' ELSE '' END AS code, CASE page_id % 5 WHEN 1 THEN 'sql:SELECT 1' ELSE '' END AS samples,
  CAST(CASE WHEN page_id % 2 = 0 THEN 3 ELSE 0 END AS INTEGER) AS kept_refs, CAST(0 AS INTEGER) AS nav_refs FROM pages""")
def q_page_structure(spark, sf):
    raw = P.raw_pages(spark, sf).select("page_id", "url", F.expr(STRUCTURE_HTML.replace("strpos(html, '</article>')", "instr(html, '</article>')")).alias("html"))
    p = P.extract_pages(raw)
    show = lambda c: F.array_join(F.transform(c, lambda b: F.concat(F.coalesce(b["language"], F.lit("-")), F.lit(":"), b["code"])), "|")
    ends = lambda *names: F.size(F.filter("link_refs", lambda r: F.regexp_extract(r["href"], "[^/]*$", 0).isin(*names)))
    return p.select("page_id", "has_tables", F.size("links").alias("n_links"),
                    F.array_join(F.transform(F.filter("headings", lambda h: h["level"] > 1), lambda h: h["text"]), "|").alias("lower_headings"),
                    F.array_join(F.filter("headings_flat", lambda h: h.isin("Third", "Second")), "|").alias("flat_tail"), show(F.col("code_blocks")).alias("code"),
                    show(F.col("code_samples")).alias("samples"), ends("kept-a", "b").alias("kept_refs"), ends("inner-nav").alias("nav_refs"))
