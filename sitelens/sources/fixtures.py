"""Derived fixture views over the driver tables.

The driver's ``documents`` hold invented prose in which the rule
vocabulary almost never occurs, so scores on the raw text are constants.
``site_pages`` derives documentation-like pages from *every* document row
(no row is dropped): it groups documents into sites by ``source`` and adds
phrases chosen by ``doc_id`` so every rule sees several per-site outcomes.
The same SELECT list is valid Spark SQL and DuckDB SQL; the oracle runs it
verbatim.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table_path

SITE_PAGES_COLUMNS = [
    """source AS site""",
    """doc_id AS ord""",
    """concat('https://', source, '.example.com/docs/p', CAST(doc_id AS STRING)) AS url""",
    """CASE WHEN doc_id % 6 = 0 THEN concat('How to set up p', CAST(doc_id AS STRING))
      WHEN doc_id % 7 = 1 AND doc_id % 20 < 10 THEN 'Overview' WHEN doc_id % 6 = 2 THEN 'API reference'
      WHEN doc_id % 6 = 3 THEN 'p1' ELSE concat('Topic ', CAST(doc_id AS STRING)) END AS title""",
    """CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN 'too short' ELSE 'A description of this page' END AS description""",
    """concat(CASE WHEN doc_id % 13 = 5 THEN '--- ' ELSE '' END,
   CASE WHEN doc_id % 9 = 0 THEN 'This guide is here to send data. ' ELSE '' END, text,
   CASE WHEN doc_id % 7 = 0 THEN ' See above for it. ' ELSE '' END,
   CASE WHEN doc_id % 11 = 1 THEN ' simply one usually two typically ' WHEN doc_id % 11 = 2 THEN ' simply one usually ' ELSE '' END,
   CASE WHEN doc_id % 20 < 8 AND doc_id % 3 = 0 THEN ' error code 404 ' ELSE '' END,
   CASE WHEN doc_id % 20 < 4 AND doc_id % 3 = 0 THEN ' workaround : retry ' ELSE '' END,
   CASE WHEN doc_id % 20 < 12 AND doc_id % 9 = 1 THEN ' token secret ' ELSE '' END,
   CASE WHEN doc_id % 20 < 6 AND doc_id % 9 = 2 THEN ' credential endpoint ' ELSE '' END,
   CASE WHEN doc_id % 7 < 2 THEN ' required ' ELSE '' END,
   CASE WHEN doc_id % 3 = 1 THEN ' sample response ' ELSE '' END,
   CASE WHEN doc_id % 8 = 3 THEN ' click here ' ELSE '' END,
   CASE WHEN doc_id % 10 < 4 THEN ' version 2 ' ELSE '' END,
   CASE WHEN doc_id % 20 IN (1, 5, 9) AND doc_id % 3 = 0 THEN ' when to use it ' ELSE '' END,
   CASE WHEN doc_id % 20 IN (2, 5, 8) THEN ' rate limit ' ELSE '' END,
   CASE WHEN doc_id % 9 = 4 THEN ' unlock leverage ' ELSE '' END,
   CASE WHEN doc_id % 20 < 9 AND doc_id % 5 = 2 THEN ' status pending ' ELSE '' END,
   CASE WHEN doc_id % 20 IN (2, 3) AND doc_id % 3 = 0 THEN ' a -> b ' ELSE '' END,
   CASE WHEN doc_id % 6 = 5 THEN ' multiple ' ELSE '' END,
   CASE WHEN doc_id % 3 = 2 THEN ' parameter ' ELSE '' END) AS content""",
    """CASE WHEN doc_id % 20 = 19 THEN '' WHEN doc_id % 3 = 0 THEN 'Install it|Details|Create a key' WHEN doc_id % 3 = 1 THEN 'Details' ELSE 'Notes|Deploy|About|More' END AS heading_txt""",
    """CASE WHEN doc_id % 20 = 18 OR doc_id % 4 = 3 THEN NULL WHEN doc_id % 8 = 0 THEN 'import x' ELSE 'x = 1' END AS code_txt""",
    """CASE WHEN doc_id % 12 = 1 THEN 'python' WHEN doc_id % 12 = 2 THEN 'text' END AS code_lang""",
    """CASE WHEN doc_id % 20 = 17 THEN 0 ELSE CAST(doc_id % 4 AS INT) END AS link_n""",
    """(doc_id % 6 = 2) AS has_tables""",
]
SITE_PAGES_SELECT = ",\n".join(SITE_PAGES_COLUMNS)



def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(table_path(sf_dir, "documents")))


def site_pages_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture view with flat columns (heading_txt, code_txt, code_lang, link_n)."""
    return documents(spark, sf_dir).selectExpr(*SITE_PAGES_COLUMNS)


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture view in the canonical page schema used by all page operators."""
    return to_page_schema(site_pages_flat(spark, sf_dir))


def to_page_schema(flat: DataFrame) -> DataFrame:
    """flat fixture columns → (site, ord, url, title, description, content,
    headings array<struct<level,text>>, code_blocks array<struct<language,code>>,
    links array<string>, has_tables)."""
    heads = F.when(F.col("heading_txt") == "", F.array().cast("array<string>")) \
        .otherwise(F.split(F.col("heading_txt"), r"\|"))
    headings = F.transform(heads, lambda h: F.struct(F.lit(2).alias("level"), h.alias("text")))
    code_blocks = F.when(F.col("code_txt").isNull(),
                         F.array().cast("array<struct<language:string,code:string>>")) \
        .otherwise(F.array(F.struct(F.col("code_lang").alias("language"), F.col("code_txt").alias("code"))))
    link_pool = F.array(*[F.concat(F.col("url"), F.lit(f"/l{i}")) for i in (1, 2, 3)])
    links = F.slice(link_pool, 1, F.col("link_n"))
    return flat.select(
        "site", "ord", "url", "title", "description", "content",
        headings.alias("headings"), code_blocks.alias("code_blocks"), links.alias("links"), "has_tables")



# Rewritten documents as an external model would return them: the original
# text wrapped in the usual decorations (outer fence, preamble, frontmatter
# with a stale or current date, invented code / error sections, an
# improvements list), chosen by doc_id so every cleaning branch is exercised.
REWRITE_RUN_DATE = "2026-01-15"
REWRITES_COLUMNS = [
    "source AS site", "doc_id AS ord",
    "concat('https://', source, '.example.com/docs/p', CAST(doc_id AS STRING)) AS url",
    "concat('Page ', CAST(doc_id AS STRING)) AS title",
    f"""concat(
   CASE WHEN doc_id % 5 = 0 THEN '```markdown' || chr(10) ELSE '' END,
   CASE WHEN doc_id % 7 = 3 THEN 'Here is the optimized page:' || chr(10) ELSE '' END,
   CASE WHEN doc_id % 3 = 0 THEN '---' || chr(10) || 'title: Page ' || CAST(doc_id AS STRING) || chr(10) || 'last_updated: '
        || CASE WHEN doc_id % 2 = 0 THEN '2024-01-01' ELSE '{REWRITE_RUN_DATE}' END || chr(10) || '---' || chr(10) ELSE '' END,
   '# Page ', CAST(doc_id AS STRING), chr(10), text,
   CASE WHEN doc_id % 4 = 1 THEN chr(10) || '```python' || chr(10) || 'import os' || chr(10) || '```' ELSE '' END,
   CASE WHEN doc_id % 6 = 2 THEN chr(10) || '## Troubleshooting' || chr(10) || 'Some text' || chr(10) || '| Error | Cause | Fix |'
        || chr(10) || '| a | b | c |' || chr(10) || '## Next' ELSE '' END,
   CASE WHEN doc_id % 6 = 4 THEN chr(10) || '| Error code | Meaning |' || chr(10) || '| 1 | x |' || chr(10) || 'after table' ELSE '' END,
   CASE WHEN doc_id % 8 = 5 THEN chr(10) || '<!-- IMPROVEMENTS -->' || chr(10) || '- Added frontmatter metadata'
        || chr(10) || '* Fixed action headings' || chr(10) || '- ok' ELSE '' END,
   CASE WHEN doc_id % 9 = 7 THEN chr(10) || '## Improvements Made' || chr(10) || '- something' ELSE '' END,
   CASE WHEN doc_id % 5 = 0 THEN chr(10) || '```' ELSE '' END) AS optimized_content""",
]


def rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rewritten document per driver document (site, ord, url, title, optimized_content)."""
    return documents(spark, sf_dir).selectExpr(*REWRITES_COLUMNS)


# Raw guide documents as a model would return them, one per conversation turn:
# playbooks from the turn's sentences, scope lists from its words.  Some use
# the old field names, some are fenced, some are cut in half (invalid JSON).
RISKS = ["safe_read", "safe_write", "requires_confirmation", "requires_escalation", "high_risk", "custom_level"]


def raw_guides(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = spread(spark.read.parquet(table_path(sf_dir, "conversations")))
    sent = F.split(F.col("text"), r"\. ")
    old = (F.col("conv_id") % 3) == 1

    def words(s):
        return F.split(s, " ")

    def playbook(x, i, old_names: bool):
        s, w = x["s"], x["w"]
        names = (["pre_checks", "steps", "verification_checks", "confirmation_required_when", "escalate_when",
                  "source_refs"] if old_names else ["check", "do", "verify", "confirm_before", "escalate_if", "refs"])
        fields = [F.array_join(F.slice(w, 1, 3), " ").alias("task_name"), s.alias("goal"),
                  F.element_at(F.array(*[F.lit(r) for r in RISKS]), (i % len(RISKS) + 1).cast("int")).alias("risk_level"),
                  F.array(F.struct(w[0].alias("name"))).alias("required_inputs"),
                  F.slice(w, 2, 5).alias(names[0]), w.alias(names[1]), F.slice(w, 1, 2).alias(names[2]),
                  F.slice(w, 3, 2).alias(names[3]), F.slice(w, 4, 2).alias(names[4]),
                  F.array(F.struct(w[0].alias("label"), F.concat(F.lit("https://docs.example.com/"), w[0]).alias("url")))
                  .alias(names[5])]
        if not old_names:
            fields.append(F.slice(w, 1, i % 3).alias("ask_for"))
        return F.struct(*fields)

    def quoted(x):  # a JSON string
        js = F.to_json(F.struct(x.alias("a")))
        return F.substring(js, F.lit(6), F.length(js) - 6)

    def mixed(items):  # a JSON list of objects with an action and plain strings by turns
        return F.concat(F.lit("["), F.array_join(F.transform(items, lambda x, i: F.when(
            i % 2 == 0, F.to_json(F.struct(x.alias("action"), F.lit("safe_read").alias("risk_level")))).otherwise(quoted(x))), ","), F.lit("]"))

    def guide(old_names: bool):
        w_all, third = F.col("_words"), F.floor(F.size("_words") / 3).cast("int")
        part = lambda k: F.slice(w_all, k * third + 1, third if k < 2 else F.size(w_all) - 2 * third)
        always, env = ("always_do", "environment_rules") if old_names else ("always", "environment")
        auth = F.struct(part(1).alias("methods"), part(2).alias("required_secrets_or_tokens"), F.slice(sent, 1, 1).alias("environment_notes"))
        setup = F.struct(part(0).alias("prerequisites"), *([auth.alias("authentication")] if old_names else [
            part(1).alias("auth_methods"), part(2).alias("required_secrets"), F.slice(sent, 1, 1).alias("env_notes")]))
        ref = lambda x: F.struct(x.alias("label"), F.concat(F.lit("https://docs.example.com/"), x).alias("url"))
        flat = lambda x, i: F.struct(x.alias("label"), F.concat(F.lit("https://docs.example.com/"), x).alias("url"), F.when(i % 2 == 0, F.lit("API")).alias("topic"))
        trouble = (lambda s: F.struct(s.alias("issue"), F.array(words(s)[0], F.lit("other")).alias("likely_causes"), F.array(F.get(words(s), 1)).alias("recommended_actions"),
                                      F.array(words(s)[0]).alias("escalate_when"))) if old_names else \
            (lambda s: F.struct(s.alias("issue"), words(s)[0].alias("likely_cause"), F.get(words(s), 1).alias("fix")))
        decide = (lambda s: F.struct(s.alias("decision"), words(s).alias("choose_when"), F.slice(words(s), 1, 1).alias("escalate_when"))) if old_names else \
            (lambda s: F.struct(s.alias("decision"), words(s).alias("use_when"), F.slice(words(s), 1, 1).alias("escalate_if")))
        error = (lambda s: F.struct(s.alias("error"), words(s)[0].alias("cause"))) if old_names else \
            (lambda s: F.struct(s.alias("error_code_or_message"), words(s)[0].alias("likely_cause"), F.lit("retry").alias("fix")))
        plain = F.to_json(F.struct(
            F.struct(F.concat(F.lit("Product "), F.col("conv_id").cast("string")).alias("product_name"),
                     F.concat(F.lit("product-"), F.col("conv_id").cast("string")).alias("slug"),
                     F.when(F.col("conv_id") % 2 == 0, "draft").otherwise("full").alias("mode")).alias("meta"),
            F.struct(sent[0].alias("summary")).alias("hero"),
            F.struct(F.when(F.col("turn") % 2 == 0, F.array().cast("array<string>")).otherwise(F.slice(sent, 1, 2)).alias("stop_and_ask"),
                     F.when(F.col("turn") % 3 == 0, F.array().cast("array<string>")).otherwise(F.slice(sent, 2, 2)).alias("stop_and_escalate")).alias("stop_conditions"),
            F.transform(F.col("_sw"), lambda x, i: playbook(x, i, old_names)).alias("task_playbooks"),
            F.struct(F.slice(sent, 1, 1).alias(always), F.slice(sent, 2, 1).alias("never_do" if old_names else "never"),
                     F.slice(sent, 3, 1).alias(env), F.slice(sent, -1, 1).alias("ambiguity_rules")).alias("operating_rules"),
            setup.alias("setup"), F.transform(sent, decide).alias("decision_guide"), F.transform(sent, trouble).alias("troubleshooting"),
            (F.array(F.struct(F.lit("API").alias("topic"), F.transform(part(0), ref).alias("references")),
                     F.struct(F.lit("More").alias("topic"), F.transform(part(1), ref).alias("references"))) if old_names
             else F.transform(w_all, flat)).alias("references")))
        errors = F.concat(F.lit('["text only"'), F.array_join(F.transform(sent, lambda s: F.concat(F.lit(","), F.to_json(error(s)))), ""), F.lit("]"))
        scope = F.concat(F.lit('{"safe_without_approval":'), mixed(part(0)), F.lit(',"requires_confirmation":'), mixed(part(1)), F.lit(',"never_do":'), mixed(part(2)), F.lit("}"))
        return F.concat(F.substring(plain, F.lit(1), F.length(plain) - 1), F.lit(',"agent_scope":'), scope, F.lit(',"errors":'), errors, F.lit("}"))
    conv = conv.withColumn("_sent", sent).withColumn("_words", words(F.col("text")))
    sent = F.col("_sent")
    conv = conv.withColumn("_sw", F.transform(sent, lambda s: F.struct(s.alias("s"), words(s).alias("w"))))
    staged = conv.withColumn("_js", F.when(old, guide(True)).otherwise(guide(False)))
    js = F.col("_js")
    staged = staged.withColumn("_js", F.when((F.col("conv_id") + F.col("turn")) % 9 == 4,
                                             F.substring(js, 1, F.floor(F.length(js) / 2).cast("int"))).otherwise(js))
    staged = staged.withColumn("_js", F.when(F.col("turn") % 4 == 1, F.concat(F.lit("```json\n"), js, F.lit("\n```")))
                               .otherwise(js))
    return staged.select((F.col("conv_id") * 100 + F.col("turn")).alias("guide_id"), "conv_id", "turn",
                         F.col("_js").alias("raw"))


def faq_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FAQ entries per package, one per turn: question = first sentence, answer = the rest, category by conv_id."""
    conv = spark.read.parquet(table_path(sf_dir, "conversations"))
    cat = F.element_at(F.array(F.lit("billing"), F.lit(None).cast("string"), F.lit("setup"), F.lit("api_keys"), F.lit("")),
                       (F.col("conv_id") % 5 + 1).cast("int"))
    first = F.split(F.col("text"), r"\. ")[0]
    return conv.select((F.col("conv_id") % 10).alias("package"), (F.col("conv_id") * 100 + F.col("turn")).alias("ord"),
                       first.alias("question"), F.substring(F.col("text"), F.length(first) + 1, F.length("text")).alias("answer"), cat.alias("category"))


# Sitemaps as a crawler would have fetched them, derived from the page table:
# per site, ceil(pages / 50 000) sitemap files (the protocol's size limit), each
# listing its pages with an image:loc child and one foreign-host entry.  Sites
# whose first page_id is a multiple of 5 have a sitemap whose end is missing.
SITEMAP_MAX_URLS = 50000


def _xml_escape(c):
    for ch, ent in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(ch), F.lit(ent))
    return c


def fetched_sitemaps(spark: SparkSession, sf_dir: str):
    """(sitemaps, index): sitemaps (site, base_url, sitemap_url, xml); index (site, base_url, xml)."""
    from ..functions import urls as U
    pages = spark.read.parquet(table_path(sf_dir, "pages")).select(
        U.site_name("url").alias("site"), "page_id", "url", U.origin("url").alias("origin"))
    per_site = pages.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_id"),
                                         F.min(F.struct("page_id", "origin")).alias("o"))
    per_site = per_site.select("site", "first_id", F.col("o.origin").alias("origin"),
                               F.ceil(F.col("n") / SITEMAP_MAX_URLS).cast("long").alias("chunks"))
    j = pages.drop("origin").join(per_site, "site").withColumn("chunk", F.col("page_id") % F.col("chunks"))
    entry = F.concat(F.lit("<url><loc>"), _xml_escape(F.col("url")), F.lit("</loc><image:image><image:loc>"),
                     _xml_escape(F.concat(F.col("url"), F.lit("/img.png"))), F.lit("</image:loc></image:image></url>"))
    docs = j.groupBy("site", "origin", "first_id", "chunk").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("page_id", entry.alias("e"))))["e"], "").alias("body"))
    xml = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" '
                         'xmlns:image="http://www.google.com/schemas/sitemap-image/1.1">'),
                   F.col("body"), F.lit("<url><loc>https://elsewhere.example.org/x</loc></url></urlset>"))
    xml = F.when(F.col("first_id") % 5 == 0, F.replace(xml, F.lit("</urlset>"), F.lit(""))).otherwise(xml)
    base = F.concat(F.col("origin"), F.lit("/"))
    sitemap_url = F.concat(F.col("origin"), F.lit("/sitemap-"), F.col("chunk").cast("string"), F.lit(".xml"))
    sitemaps = docs.select("site", base.alias("base_url"), sitemap_url.alias("sitemap_url"), xml.alias("xml"))
    index = sitemaps.groupBy("site", "base_url").agg(
        F.concat(F.lit("<sitemapindex>"),
                 F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<sitemap><loc>"), F.col("sitemap_url"),
                                                                   F.lit("</loc></sitemap>")))), ""),
                 F.lit("</sitemapindex>")).alias("xml"))
    return sitemaps, index
