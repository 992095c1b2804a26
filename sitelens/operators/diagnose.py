"""Per-page diagnosis for rewriting (P1-P4), language (X13, A17),
terminology context (A12).

Everything is a narrow projection of page columns with plain substring
checks (``contains``), except the terminology context, which is one
``groupBy(site)`` of per-page presence flags (partial aggregation: a big site
costs one row per map partition in the shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrays import let

# ---------------------------------------------------------------------------
# FIXED VALUES — diagnosis vocabularies and messages
# ---------------------------------------------------------------------------
VAGUE_REFS = ["as mentioned above", "see previous section", "as described earlier", "refer to the above",
              "as noted above", "see above", "as shown above", "as discussed", "the previous example"]
ACTION_WORDS = ["how to", "create", "send", "configure", "set up", "install", "authenticate", "deploy", "handle",
                "verify", "migrate", "troubleshoot", "debug", "retry", "list"]
ACTION_SHARE = 0.3
IMPLICIT_PHRASES = ["typically", "usually", "simply", "you may want to", "it works like", "as you might expect",
                    "obviously"]
MARKETING_TERMS = ["seamlessly", "world-class", "next-generation", "cutting-edge", "unlock", "leverage", "synergy",
                   "revolutionary", "best-in-class", "game-changing", "disruptive", "supercharge"]
MSG_VAGUE = "Contains vague reference: '{}' — sections must be self-contained"
MSG_HEADINGS = "Headings are topic-based, not action/task-oriented"
MSG_PROSE_PARAMS = "Parameters described in prose — should use structured tables"
MSG_NO_IMPORTS = "Code examples lack imports/setup — not copy-paste runnable"
MSG_HOWTO_NO_CODE = "How-to/guide page has NO code examples"
MSG_IMPLICIT = "Contains vague language: '{}' — be explicit"
MSG_ERRORS = "Mentions errors but lacks structured error documentation"
MSG_FRONTMATTER = "Missing frontmatter metadata (title, version, tags)"
MSG_MARKETING = "Contains marketing language: '{}' — strip from technical docs"
MSG_SHORT = "Page is too short — needs more detail"
MSG_STRUCTURE = "Missing clear structure — needs more headings"
STRENGTHS = ["Has structured parameter tables", "Has complete code examples with imports",
             "Has structured error documentation", "Documents prerequisites", "Uses action-oriented headings",
             "Sections are self-contained"]
SHORT_WORDS, MIN_HEADINGS = 100, 2

HUB_TITLE_TERMS = ["overview", "get started", "getting started", "docs", "guides", "products", "topics",
                   "use cases", "resources", "documentation"]
LONG_PARAGRAPH_WORDS = 80
LIST_OR_BLOCK_PREFIXES = ["|", "-", "*", "#", "```"]

LANG_MARKERS = [
    ("fr", [" les ", " des ", " une ", " pour ", " avec ", " dans ", " votre ", " sont ", " cette "]),
    ("es", [" los ", " las ", " una ", " para ", " con ", " esta ", " como ", " más ", " tiene "]),
    ("de", [" die ", " das ", " und ", " für ", " mit ", " eine ", " wird ", " sich ", " auch "]),
    ("pt", [" para ", " uma ", " com ", " dos ", " são ", " como ", " mais ", " esta ", " você "]),
    ("it", [" per ", " una ", " con ", " del ", " sono ", " come ", " dalla ", " nella ", " questo "]),
]
LANG_MIN_HITS = 3

TERMINOLOGY_GROUPS = [
    ["user", "account", "customer", "client", "member"],
    ["workspace", "organization", "org", "team", "project", "space"],
    ["token", "api key", "secret", "credential", "auth token"],
    ["endpoint", "route", "path", "url", "uri"],
    ["request", "call", "invocation"],
    ["response", "result", "output", "return value"],
]
TERMINOLOGY_LINE = "Multiple terms found for same concept: {}. Pick the most precise term and use it consistently."
TERMINOLOGY_HEADER = "TERMINOLOGY CONFLICTS DETECTED:\n"
TERMINOLOGY_NONE = "No major terminology conflicts detected."


def _first_found(lower: Column, phrases: list[str]) -> Column:
    """First phrase of the list (list order) that occurs in the text, else NULL."""
    return F.coalesce(*[F.when(lower.contains(p), F.lit(p)) for p in phrases])


def _msg(template: str, value: Column) -> Column:
    a, b = template.split("{}")
    return F.concat(F.lit(a), value, F.lit(b))


def heading_texts(pages: DataFrame) -> Column:
    """Heading texts of levels 1-4: in document order where the extraction gives it (``headings_flat``)."""
    if "headings_flat" in pages.columns:
        return F.transform("headings_flat", lambda h: T.nz(h))
    return F.transform(F.filter("headings", lambda h: h["level"] <= 4), lambda h: T.nz(h["text"]))


def code_samples(pages: DataFrame) -> Column:
    return F.col("code_samples" if "code_samples" in pages.columns else "code_blocks")


def _diagnosis_inputs(pages: DataFrame, extra: tuple[Column, ...] = ()) -> DataFrame:
    """Per-page values computed once (lower-cased text, heading texts, counts), and columns to carry along."""
    return pages.select(
        "site", "ord", "url", F.coalesce(F.col("title"), F.lit("Untitled")).alias("_title"),
        T.nz("content").alias("_c"), F.lower(T.nz("content")).alias("_lc"),
        F.transform(heading_texts(pages), F.lower).alias("_heads"),
        F.transform(code_samples(pages), lambda b: F.lower(T.nz(b["code"]))).alias("_codes"), *extra)


def diagnose_pages(pages: DataFrame, extra: tuple[Column, ...] = ()) -> DataFrame:
    """Per page: counts, boolean findings, ordered issues and strengths (and ``extra`` columns of the page)."""
    pages = _diagnosis_inputs(pages, extra)
    carried = [c for c in pages.columns if not c.startswith("_") and c not in ("site", "ord", "url")]
    c, lc, heads = F.col("_c"), F.col("_lc"), F.col("_heads")
    title_l = F.lower(F.col("_title"))
    n_heads = F.size(heads)
    words = T.word_count(c)
    has_code = F.size("_codes") > 0
    vague = _first_found(lc, VAGUE_REFS)
    action_count = F.size(F.filter(heads, lambda h: T.contains_any(h, ACTION_WORDS)))
    has_action = action_count > n_heads * ACTION_SHARE
    has_tables = c.contains("|") & T.contains_any(lc, ["parameter", "type", "required"])
    complete = has_code & F.exists("_codes", lambda b: T.contains_any(b, ["import", "require", "from"]))
    implicit = _first_found(lc, IMPLICIT_PHRASES)
    errors = lc.contains("error") & (lc.contains("code") | lc.contains("status")) & \
        T.contains_any(lc, ["fix", "solution", "resolve"])
    front = c.rlike(r"^(?U)\s*---")
    prereq = T.contains_any(lc, ["prerequisite", "before you begin", "requirements"])
    output = lc.contains("response") & (lc.contains("example") | lc.contains("output"))
    marketing = _first_found(lc, MARKETING_TERMS)
    version = T.contains_any(lc, ["version", "v1", "v2"])
    flags = pages.select(
        "site", "ord", "url", F.col("_title").alias("title"),
        words.alias("word_count"), n_heads.alias("heading_count"), F.size("_codes").alias("code_count"),
        vague.isNotNull().alias("has_vague_references"), has_action.alias("has_action_headings"),
        has_tables.alias("has_parameter_tables"), complete.alias("has_complete_examples"),
        implicit.isNotNull().alias("has_implicit_language"), errors.alias("has_error_docs"),
        front.alias("has_frontmatter"), prereq.alias("has_prerequisites"), output.alias("has_expected_output"),
        marketing.isNotNull().alias("has_marketing_language"), version.alias("has_version_info"),
        vague.alias("_vague"), implicit.alias("_implicit"), marketing.alias("_marketing"),
        lc.contains("parameter").alias("_mentions_params"), lc.contains("error").alias("_mentions_errors"),
        (title_l.contains("how") | title_l.contains("guide")).alias("_howto_title"), *carried)
    return _issues(flags)


def _issues(f: DataFrame) -> DataFrame:
    """Ordered issue and strength lists from the boolean findings (one projection)."""
    col = F.col
    issues = F.array(
        F.when(col("_vague").isNotNull(), _msg(MSG_VAGUE, col("_vague"))),
        F.when(~col("has_action_headings") & (col("heading_count") > 0), F.lit(MSG_HEADINGS)),
        F.when(col("_mentions_params") & ~col("has_parameter_tables"), F.lit(MSG_PROSE_PARAMS)),
        F.when((col("code_count") > 0) & ~col("has_complete_examples"), F.lit(MSG_NO_IMPORTS))
         .when((col("code_count") == 0) & col("_howto_title"), F.lit(MSG_HOWTO_NO_CODE)),
        F.when(col("_implicit").isNotNull(), _msg(MSG_IMPLICIT, col("_implicit"))),
        F.when(col("_mentions_errors") & ~col("has_error_docs"), F.lit(MSG_ERRORS)),
        F.when(~col("has_frontmatter"), F.lit(MSG_FRONTMATTER)),
        F.when(col("_marketing").isNotNull(), _msg(MSG_MARKETING, col("_marketing"))),
        F.when(col("word_count") < SHORT_WORDS, F.lit(MSG_SHORT)),
        F.when(col("heading_count") < MIN_HEADINGS, F.lit(MSG_STRUCTURE)))
    strengths = F.array(*[F.when(flag, F.lit(s)) for flag, s in zip(
        [col("has_parameter_tables"), col("has_complete_examples"), col("has_error_docs"), col("has_prerequisites"),
         col("has_action_headings"), col("_vague").isNull()], STRENGTHS)])
    keep = [c for c in f.columns if not c.startswith("_")]
    return f.select(*keep, F.filter(issues, lambda x: x.isNotNull()).alias("issues"),
                    F.filter(strengths, lambda x: x.isNotNull()).alias("strengths"))


def _type_inputs(pages: DataFrame) -> tuple[Column, ...]:
    c = T.nz("content")
    link_col = "link_refs" if "link_refs" in pages.columns else "links"
    paragraphs = F.split(c, "\n\n")
    long_pars = F.size(F.filter(paragraphs, lambda p: (F.regexp_count(p, F.lit(r"(?U)\S+")) >= LONG_PARAGRAPH_WORDS)
                                & ~T.contains_any_prefix(F.regexp_replace(p, r"^(?U)\s+", ""), LIST_OR_BLOCK_PREFIXES)))
    steps = F.regexp_count(c, F.lit(r"(?mUd)^\d+\."))
    combined = F.lower(F.concat(F.coalesce(F.col("title"), F.lit("Untitled")), F.lit(" "), F.array_join(heading_texts(pages), " ")))
    return (F.size(link_col).alias("link_count"), long_pars.alias("long_paragraphs"), steps.alias("ordered_steps"),
            T.contains_any(combined, HUB_TITLE_TERMS).alias("hub_title"))


def page_type(pages: DataFrame) -> DataFrame:
    """P2: 'hub' or 'content' from hub / content points, in the projection that diagnoses the page."""
    hub, content, kind = _type_points()
    return diagnose_pages(pages, _type_inputs(pages)).select("site", "ord", hub.alias("hub_score"), content.alias("content_score"), kind.alias("page_type"))


def _type_points() -> tuple[Column, Column, Column]:
    i = lambda b, n: F.when(b, F.lit(n)).otherwise(F.lit(0))
    hub = (i(F.col("link_count") >= 8, 2)
           + i((F.col("word_count") > 0) & (F.col("word_count") / F.greatest(F.col("link_count"), F.lit(1)) <= 40), 2)
           + i(F.col("code_count") == 0, 1) + i(~F.col("has_parameter_tables"), 1) + i(F.col("ordered_steps") <= 3, 1)
           + i(F.col("long_paragraphs") <= 2, 1) + i(F.col("hub_title"), 1))
    content = (i(F.col("code_count") >= 1, 3) + i(F.col("has_parameter_tables"), 2) + i(F.col("ordered_steps") >= 4, 2)
               + i(F.col("long_paragraphs") >= 3, 2) + i(F.col("has_error_docs"), 2))
    return hub, content, F.when(content >= 4, "content").when((hub >= 5) & (content <= 2), "hub").otherwise("content")


def detect_language(text: Column, sample_chars: int | None = None) -> Column:
    """Marker-word language guess over the whole text (or its first ``sample_chars``);
    'en' unless some language has at least 3 markers.

    Markers stand between two spaces, so the text is cut at spaces once and the
    words that have a space on both sides are intersected with all markers.
    """
    sample = F.lower(T.nz(text) if sample_chars is None else F.substring(T.nz(text), 1, sample_chars))
    marks = {lang: [m.strip(" ") for m in marks] for lang, marks in LANG_MARKERS}
    every = F.array(*map(F.lit, sorted({m for words in marks.values() for m in words})))
    between = lambda words: F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))

    def scored(hits: Column) -> Column:
        scores = F.struct(*(F.size(F.array_intersect(hits, F.array(*map(F.lit, words)))).alias(lang) for lang, words in marks.items()))

        def decided(s: Column) -> Column:
            best = F.greatest(*(s[lang] for lang in marks))
            return F.when(best < LANG_MIN_HITS, "en").otherwise(F.coalesce(*(F.when(s[lang] == best, lang) for lang in marks)))

        return let(scores, decided)

    return let(F.split(sample, " ", -1), lambda words: let(F.array_intersect(between(words), every), scored))


def language_accuracy(docs: DataFrame) -> DataFrame:
    """Confusion counts of the detected language against the labelled ``lang``."""
    pred = docs.select("lang", detect_language(F.col("text")).alias("predicted"))
    return pred.groupBy("lang", "predicted").agg(F.count(F.lit(1)).alias("n"))


def issue_frequency(diagnosis: DataFrame) -> DataFrame:
    """Pages per issue text (and per site)."""
    return diagnosis.select("site", F.explode_outer("issues").alias("issue")).where("issue IS NOT NULL") \
        .groupBy("site", "issue") \
        .agg(F.count(F.lit(1)).alias("pages"))


def terminology_context(pages: DataFrame) -> DataFrame:
    """Per site, the terms of each group found anywhere in the site's text
    (substring presence); groups with more than one term become conflict lines."""
    lc = F.lower(T.nz("content"))
    flags = []
    for g, terms in enumerate(TERMINOLOGY_GROUPS):
        for t, term in enumerate(terms):
            flags.append(F.max(lc.contains(term).cast("int")).alias(f"g{g}_{t}"))
    agg = pages.groupBy("site").agg(*flags)
    lines = []
    for g, terms in enumerate(TERMINOLOGY_GROUPS):
        found = F.filter(F.array(*[F.when(F.col(f"g{g}_{t}") == 1, F.lit(term)) for t, term in enumerate(terms)]),
                         lambda x: x.isNotNull())
        a, b = TERMINOLOGY_LINE.split("{}")
        lines.append(F.when(F.size(found) > 1, F.concat(F.lit(a), F.array_join(found, ", "), F.lit(b))))
    conflicts = F.filter(F.array(*lines), lambda x: x.isNotNull())
    text = F.when(F.size(conflicts) > 0, F.concat(F.lit(TERMINOLOGY_HEADER), F.array_join(conflicts, "\n"))) \
        .otherwise(F.lit(TERMINOLOGY_NONE))
    return agg.select("site", F.size(conflicts).alias("conflicts"), text.alias("terminology"))


def rewrite_requests(pages: DataFrame, min_words: int = 50, content_chars: int | None = None, code_chars: int | None = None,
                     max_headings: int | None = None, max_examples: int | None = None) -> DataFrame:
    """One row per page with everything an external rewriting job needs.

    Pages under ``min_words`` are marked ``pass_through`` (kept unchanged with a
    note) instead of being sent.  No prompt text and no model call here.  The
    page's part is one projection; only the site's terminology row is joined.
    The optional bounds cut what a job with limited input can take.
    """
    cut = lambda c, n: c if n is None else F.substring(c, 1, n)
    first = lambda c, n: c if n is None else F.slice(c, 1, n)
    heads = heading_texts(pages)
    code = F.transform(first(code_samples(pages), max_examples), lambda b: F.struct(
        F.coalesce(b["language"], F.lit("text")).alias("language"), cut(T.nz(b["code"]), code_chars).alias("code")))
    status = F.lit("complete") if content_chars is None else T.truncation_status(F.col("content"), content_chars)
    extra = (*_type_inputs(pages), cut(T.nz("content"), content_chars).alias("content"), detect_language(F.col("content")).alias("language"),
             status.alias("source_status"), F.when(F.size(heads) > 0, F.array_join(first(heads, max_headings), ", ")).otherwise(F.lit("None")).alias("headings"),
             code.alias("code_examples"))
    out = diagnose_pages(pages, extra).withColumn("page_type", _type_points()[2])
    out = out.join(terminology_context(pages).select("site", "terminology"), "site", "left")
    return out.select("site", "ord", "url", "title", "page_type", "language", "source_status", "word_count",
                      "heading_count", "code_count", "link_count", "headings", "code_examples", "content", "issues",
                      "strengths", "terminology", (F.col("word_count") >= min_words).alias("needs_rewrite"))
