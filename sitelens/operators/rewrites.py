"""Checking rewritten documents against their originals.

The rewrite itself is done by an external model job that reads the table of
:func:`sitelens.operators.diagnose.rewrite_requests`.  This module accepts
its output: join to the originals (J7), undo fabrications (P5), read the
claimed improvements (P7), clean wrappers (P6), summarise (A11, P9) and
build per-site ``llms.txt`` lines (A15).

The line state machines (P5, P8) are ``aggregate`` folds over
``split(text, '\\n')`` — JVM-side higher-order functions, one document per
row, no Python and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..functions.arrays import by_index, collect_text, emitting, let, numbers
from ..session import replaced, stored
from .diagnose import diagnose_pages

# ---------------------------------------------------------------------------
# FIXED VALUES — markers, messages and templates
# ---------------------------------------------------------------------------
IMPROVEMENTS_MARKER = "<!-- IMPROVEMENTS -->"
IMPROVEMENTS_HEADING = "## Improvements Made"
LAST_UPDATED_RX = r"(?md)^(last_updated:\s*[\"']?)(\d{4}-\d{2}-\d{2})([\"']?\s*)$"
FABRICATED_HEADING_WORDS = ["troubleshoot", "common error", "error code"]
DERIVED_IMPROVEMENTS = {
    "vague": "Made sections self-contained, removed vague cross-references",
    "headings": "Restructured headings into action-oriented, task-shaped format",
    "params": "Converted parameter descriptions from prose to structured tables",
    "code": "Completed code examples with imports, setup, and expected output",
    "implicit": "Replaced vague language with explicit, precise statements",
    "errors": "Structured error documentation with codes, causes, and fixes",
    "frontmatter": "Added YAML frontmatter metadata (title, version, tags)",
    "prereq": "Added explicit prerequisites section",
    "outputs": "Added expected outputs for API calls and code examples",
    "marketing": "Stripped marketing language, technical precision only",
    "version": "Added version context and clarity",
}
DEFAULT_IMPROVEMENT = "Restructured to be self-contained, explicit and structured"
LLMS_DEFAULT_NOTE = "Rewritten for machine readers"
#: Default texts around the page list; callers may give their own ({domain}, {base_url}, {pages}).
LLMS_HEADER = """# {domain} documentation

> Index of the rewritten pages. The original documentation is at {base_url}
"""
LLMS_FOOTER = """
## About these pages
- {pages} pages, Markdown with YAML frontmatter
- Each page stands on its own; code examples name their imports
"""


def _lines(c: Column) -> Column:
    return F.split(c, "\n")


def _stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"^(?U)\s+|(?U)\s+$", "")


def fix_dates(text: Column, run_date: str) -> Column:
    """(a) when the first ``last_updated:`` date differs from the run date, set every one to it."""
    first = F.regexp_extract(text, LAST_UPDATED_RX, 2)
    return F.when((first != "") & (first != F.lit(run_date)),
                  F.regexp_replace(text, LAST_UPDATED_RX, "$1" + run_date + "$3")).otherwise(text)


def line_features(text: Column) -> Column:
    """Per line: the line and its fence / table / heading / keyword flags, computed once."""
    base = F.transform(_lines(text), lambda l: F.struct(l.alias("line"), _stripped(l).alias("st"),
                                                        F.lower(l).alias("low")))
    return F.transform(base, lambda x: F.struct(
        x["line"].alias("line"), x["st"].startswith("```").alias("fence"), x["st"].startswith("|").alias("pipe"),
        x["st"].startswith("#").alias("head"),
        (x["low"].contains("error") | x["low"].contains("troubleshoot")
         | (x["low"].contains("cause") & x["low"].contains("fix"))).alias("err_kw"),
        T.contains_any(x["low"], FABRICATED_HEADING_WORDS).alias("head_kw")))


def _validate_fold(has_code: Column, no_errors: Column) -> Column:
    """(b)-(d): which lines go: fabricated fenced blocks, error tables and error sections.

    State: line number, the range of lines that is open, skip_fence, in_table,
    skip_heading, blocks, rows, sections.  A range is emitted when it ends, the
    counts at the end, so the state stays small and the fold is linear.
    """
    init = F.struct(F.lit(0).alias("i"), F.lit(-1).alias("open"), F.lit(False).alias("fence"),
                    F.lit(False).alias("table"), F.lit(False).alias("heading"),
                    F.lit(0).alias("blocks"), F.lit(0).alias("rows"), F.lit(0).alias("sections"))
    ended = lambda s, last: F.concat(s["open"].cast("string"), F.lit(":"), last.cast("string"), F.lit(";"))

    def step(s, x):
        is_fence, is_pipe, is_head = x["fence"], x["pipe"], x["head"]
        # (d) still inside a removed section: skip until the next heading line
        skipping_section = s["heading"] & ~is_head
        fence_open_fab = ~s["fence"] & is_fence & ~has_code
        fence_keep = ~s["fence"] & is_fence & has_code
        in_fab_fence = s["fence"]
        err_row = is_pipe & x["err_kw"] & no_errors
        table_cont = s["table"] & is_pipe
        fab_heading = is_head & x["head_kw"] & no_errors
        drop = F.when(skipping_section, F.lit(True)).when(fence_keep, F.lit(False)) \
            .when(in_fab_fence, F.lit(True)).otherwise(fence_open_fab | err_row | table_cont | fab_heading)
        new_fence = F.when(skipping_section, s["fence"]) \
            .when(fence_open_fab, F.lit(True)) \
            .when(in_fab_fence & is_fence, F.lit(False)).otherwise(s["fence"])
        # the table state only moves on lines that reach the table check
        reaches_table = ~skipping_section & ~is_fence & ~in_fab_fence
        new_table = F.when(~reaches_table, s["table"]).when(err_row, F.lit(True)) \
            .when(s["table"] & is_pipe, F.lit(True)).otherwise(F.lit(False))
        counted_heading = reaches_table & ~err_row & ~table_cont & fab_heading
        new_heading = skipping_section | counted_heading
        return emitting(F.struct(
            (s["i"] + 1).alias("i"), F.when(~drop, F.lit(-1)).when(s["open"] < 0, s["i"]).otherwise(s["open"]).alias("open"),
            new_fence.alias("fence"), new_table.alias("table"), new_heading.alias("heading"),
            (s["blocks"] + F.when(~skipping_section & fence_open_fab, 1).otherwise(0)).alias("blocks"),
            (s["rows"] + F.when(reaches_table & (err_row | table_cont), 1).otherwise(0)).alias("rows"),
            (s["sections"] + F.when(counted_heading, 1).otherwise(0)).alias("sections")),
            F.when(~drop & (s["open"] >= 0), ended(s, s["i"] - 1)).otherwise(""))

    finish = lambda s: F.concat(F.when(s["open"] >= 0, ended(s, s["i"] - 1)).otherwise(""), F.lit("|"),
                                F.concat_ws(":", *(s[c].cast("string") for c in ("blocks", "rows", "sections"))))

    def parsed(text: Column) -> Column:
        counts = F.get(numbers(F.substring_index(text, "|", -1), ("blocks", "rows", "sections")), F.lit(0))
        return let(counts, lambda n: F.struct(numbers(F.substring_index(text, "|", 1), ("a", "b")).alias("gone"), *(n[c].alias(c) for c in ("blocks", "rows", "sections"))))

    return let(collect_text(line_features(F.col("_dated")), init, step, finish), parsed)


def _original_flags() -> tuple[Column, Column]:
    """What the line checks need to know of an original page, without its text."""
    orig_l = F.lower(T.nz("content"))
    has_code = (F.coalesce(F.size("code_blocks"), F.lit(0)) > 0) | T.nz("content").contains("```")
    return has_code.alias("original_has_code"), (~orig_l.contains("error") & ~orig_l.contains("troubleshoot")).alias("original_no_errors")


def _once(df: DataFrame, *columns: Column) -> DataFrame:
    """Columns that several later columns read, computed once (a generator of one row is not merged away)."""
    return df.select("*", F.inline_outer(F.array(F.struct(*columns))))


def _validated(joined: DataFrame, run_date: str) -> DataFrame:
    """P5 on rewrites that carry their original's two flags: the validated text and what was removed."""
    df = _once(joined, fix_dates(T.nz("optimized_content"), run_date).alias("_dated"))
    df = _once(df, _validate_fold(F.col("original_has_code"), F.col("original_no_errors")).alias("_f"))
    stay = let(by_index(F.col("_f.gone"), "struct<a:int,b:int>"), lambda gone: F.filter(_lines(F.col("_dated")), lambda line, i: F.get(gone, i).isNull()))
    text = F.when(F.size("_f.gone") == 0, F.col("_dated")).otherwise(F.array_join(stay, "\n"))
    return _once(df, text.alias("validated"), (F.col("_dated") != T.nz("optimized_content")).alias("date_fixed"), F.col("_f.blocks").alias("blocks_removed"),
                 F.col("_f.rows").alias("table_rows_removed"), F.col("_f.sections").alias("sections_removed")).drop("_dated", "_f")


def validate_rewrites(rewrites: DataFrame, originals: DataFrame, run_date: str) -> DataFrame:
    """Rewrites (site, ord, optimized_content) joined with flags of their originals
    (no original text moves): the validated text plus what was removed."""
    flags = originals.select("site", "ord", *_original_flags())
    return _validated(rewrites.join(flags, ["site", "ord"]), run_date).drop("original_has_code", "original_no_errors")


def clean_rewrite(c: Column) -> Column:
    """Strip an outer fence, cut at the improvements marker / heading, drop a 'Here…' preamble.

    Each step reads the previous result once (linear expression tree):
    the fence rule removes the first line and a closing line that is only
    ```; the preamble rule removes everything before the first line that
    starts with '---'.
    """
    s = _strip_ws(T.nz(c))
    s = F.regexp_replace(s, r"(?s)^```[^\n]*(?:\n|$)(.*?)(?:(?:\n|(?<=\n))[^\S\n]*```[^\S\n]*)?$", "$1")
    s = _strip_ws(F.substring_index(s, IMPROVEMENTS_MARKER, 1))
    s = _strip_ws(F.substring_index(s, IMPROVEMENTS_HEADING, 1))
    s = F.regexp_replace(s, r"(?s)^Here.*?\n(?=[^\S\n]*---)", "")
    return _strip_ws(s)


def _strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"^(?U)\s+|(?U)\s+$", "")


def marker_improvements(c: Column, limit: int | None = None) -> Column:
    """P7 (first branch): bullets after the marker, longer than 5 chars (the first ``limit`` where a bound is given)."""
    after = F.when(c.contains(IMPROVEMENTS_MARKER),
                   F.element_at(F.split(c, F.lit(IMPROVEMENTS_MARKER).cast("string")), 2))
    items = F.transform(_lines(_strip_ws(F.coalesce(after, F.lit("")))), _strip_ws)
    bullets = F.filter(items, lambda x: x.startswith("- ") | x.startswith("* "))
    texts = F.filter(F.transform(bullets, lambda x: _strip_ws(F.substring(x, 3, 1 << 30))), lambda x: F.length(x) > 5)
    return texts if limit is None else F.slice(texts, 1, limit)


def claimed_improvements(validated: DataFrame, diagnosis: DataFrame) -> DataFrame:
    """Marker bullets, else improvements derived from the page diagnosis and the text."""
    return validated.join(diagnosis.select("site", "ord", *FACTS), ["site", "ord"]).withColumn("improvements", _improvements()).drop(*FACTS)


FACTS = ["has_vague_references", "has_action_headings", "has_parameter_tables", "has_complete_examples", "code_count",
         "has_implicit_language", "has_error_docs", "has_frontmatter", "has_prerequisites", "has_expected_output",
         "has_marketing_language", "has_version_info", "issues"]


def _improvements() -> Column:
    text = F.col("validated")
    low = F.lower(text)
    has_code = F.col("code_count") > 0
    after_prereq = F.coalesce(F.get(F.split(text, "prerequisites:"), F.lit(1)), F.lit(""))
    derived = F.array(
        F.when(F.col("has_vague_references"), F.lit(DERIVED_IMPROVEMENTS["vague"])),
        F.when(~F.col("has_action_headings"), F.lit(DERIVED_IMPROVEMENTS["headings"])),
        F.when(~F.col("has_parameter_tables") & F.exists("issues", lambda x: F.lower(x).contains("parameter")),
               F.lit(DERIVED_IMPROVEMENTS["params"])),
        F.when(~F.col("has_complete_examples") & has_code, F.lit(DERIVED_IMPROVEMENTS["code"])),
        F.when(F.col("has_implicit_language"), F.lit(DERIVED_IMPROVEMENTS["implicit"])),
        F.when(~F.col("has_error_docs") & has_code & low.contains("error")
               & (low.contains("| error") | low.contains("| code")), F.lit(DERIVED_IMPROVEMENTS["errors"])),
        F.when(~F.col("has_frontmatter"), F.lit(DERIVED_IMPROVEMENTS["frontmatter"])),
        F.when(~F.col("has_prerequisites") & text.contains("prerequisites:") & after_prereq.contains("- "),
               F.lit(DERIVED_IMPROVEMENTS["prereq"])),
        F.when(~F.col("has_expected_output") & has_code & text.contains("```")
               & T.contains_any(low, ["output", "response", "returns"]), F.lit(DERIVED_IMPROVEMENTS["outputs"])),
        F.when(F.col("has_marketing_language"), F.lit(DERIVED_IMPROVEMENTS["marketing"])),
        F.when(~F.col("has_version_info") & low.contains("version"), F.lit(DERIVED_IMPROVEMENTS["version"])))
    derived = F.filter(derived, lambda x: x.isNotNull())
    derived = F.when(F.size(derived) == 0, F.array(F.lit(DEFAULT_IMPROVEMENT))).otherwise(derived)
    marked = marker_improvements(text)
    return F.when(F.size(marked) > 0, marked).otherwise(derived)


def accept_rewrites(rewrites: DataFrame, originals: DataFrame, run_date: str) -> DataFrame:
    """E3 second half: validate → improvements (read after validation, before
    cleaning) → clean → file name.  Output one row per rewritten page."""
    facts = diagnose_pages(originals, _original_flags()).select("site", "ord", "original_has_code", "original_no_errors", *FACTS)
    imp = _once(_validated(rewrites.join(facts, ["site", "ord"]), run_date), _improvements().alias("improvements"))
    title = F.coalesce(F.col("title"), F.lit("Untitled")) if "title" in rewrites.columns else F.lit("Untitled")
    return imp.select("site", "ord", "url", title.alias("title"), clean_rewrite(F.col("validated")).alias("content"),
                      "improvements", U.file_name(title, F.col("url")).alias("file_name"),
                      "date_fixed", "blocks_removed", "table_rows_removed", "sections_removed")


def fabrication_report(accepted: DataFrame) -> DataFrame:
    """Per site, documents changed and blocks / rows / sections / dates removed or fixed."""
    return accepted.groupBy("site").agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum(F.col("date_fixed").cast("int")).alias("dates_fixed"),
        F.sum("blocks_removed").alias("blocks_removed"),
        F.sum("table_rows_removed").alias("table_rows_removed"),
        F.sum("sections_removed").alias("sections_removed"))


def distinct_improvements(accepted: DataFrame) -> DataFrame:
    """The different improvements of each site, with the number of pages that have them."""
    return accepted.select("site", F.explode_outer(F.array_distinct("improvements")).alias("improvement")).where("improvement IS NOT NULL") \
        .groupBy("site", "improvement").agg(F.count(F.lit(1)).alias("pages"))


def improvement_summary(accepted: DataFrame) -> DataFrame:
    """Pages, total improvements and distinct improvements per site.

    Distinct improvements are counted with a (site, improvement) aggregate,
    so no per-site list is ever built.
    """
    per_site = accepted.groupBy("site").agg(F.count(F.lit(1)).alias("pages_optimized"),
                                            F.sum(F.size("improvements")).alias("total_improvements"))
    distinct = distinct_improvements(accepted).groupBy("site").agg(F.count(F.lit(1)).alias("unique_improvements"))
    return per_site.join(distinct, "site", "left").fillna(0, ["unique_improvements"])


def dedent_nested_fences(df: DataFrame, column: str = "content", name: str | None = None) -> DataFrame:
    """P8 on a text column (in place, or under a new name): fences indented by at least 2 inside lists move to the top level, body de-indented,
    with a blank line before and after; an unterminated one gets its closing fence.

    The fold only notes the blocks (first line, last line, indent); the lines
    are then changed by their number.
    """
    init = F.struct(F.lit(0).alias("i"), F.lit(-1).alias("a"), F.lit(-1).alias("indent"))
    left = lambda line: F.regexp_replace(line, r"^(?U)\s+", "")
    note = lambda s, last: F.concat(F.concat_ws(":", s["a"].cast("string"), last.cast("string"), s["indent"].cast("string")), F.lit(";"))

    def step(s, line):
        fence = left(line).startswith("```")
        indent = F.length(line) - F.length(left(line))
        inside = s["a"] >= 0
        opens = ~inside & fence & (indent >= 2)
        closes = inside & fence & (F.length(left(line)) <= 4)
        return emitting(F.struct((s["i"] + 1).alias("i"), F.when(opens, s["i"]).when(closes, F.lit(-1)).otherwise(s["a"]).alias("a"),
                                 F.when(opens, indent).when(closes, F.lit(-1)).otherwise(s["indent"]).alias("indent")),
                        F.when(closes, note(s, s["i"])).otherwise(""))

    # a block that is never closed ends after the last line
    fold = numbers(collect_text(F.col("_lines"), init, step, lambda s: F.when(s["a"] >= 0, note(s, s["i"])).otherwise("")), ("a", "b", "indent"))
    staged = _once(_once(df, _lines(T.nz(column)).alias("_lines")), fold.alias("_blocks"))
    blocks = F.col("_blocks")

    def changed(line, i, own):
        body = F.when(line.startswith(F.repeat(F.lit(" "), own["indent"])), F.substring(line, own["indent"] + 1, F.length(line))).otherwise(left(line))
        return F.when(own.isNull(), line).when(own["a"] == i, F.concat(F.lit("\n```"), _strip_ws(F.substring(left(line), 4, 1 << 30)))) \
            .when(own["b"] == i, F.lit("```\n")).otherwise(body)

    out = let(by_index(blocks, "struct<a:int,b:int,indent:int>"), lambda places: F.array_join(
        F.transform("_lines", lambda line, i: changed(line, i, F.get(places, i))), "\n"))
    out = F.when(F.exists(blocks, lambda b: b["b"] == F.size("_lines")), F.concat(out, F.lit("\n```\n"))).otherwise(out)
    return staged.withColumn(name or column, F.when(F.size(blocks) == 0, T.nz(column)).otherwise(out)).drop("_lines", "_blocks")


def category_of(file_name: Column) -> Column:
    """Title-cased part of the file name before the first '-'."""
    first = F.split(F.replace(file_name, F.lit(".md"), F.lit("")), "-")[0]
    return T.title_case(first)


def llms_txt_lines(accepted: DataFrame, header_text: str = LLMS_HEADER, footer_text: str = LLMS_FOOTER) -> DataFrame:
    """The per-site ``llms.txt`` as ordered lines (site, section, key, line).

    Categories appear in first-seen document order; documents keep crawl
    order inside their category.  Order by (site, section, cat_ord, ord) to
    read the file; a site's lines are never gathered into one row.

    What the lines need of each page is written to the shared folder: all four
    kinds of lines read it there, so the rewrite chain behind it runs once.
    """
    note = F.coalesce(F.try_element_at("improvements", F.lit(1)), F.lit(LLMS_DEFAULT_NOTE))
    docs = stored(accepted.select("site", "ord", "title", "url", note.alias("note"), category_of(F.col("file_name")).alias("cat")), "llms-pages")
    first_seen = docs.groupBy("site", "cat").agg(F.min("ord").alias("cat_ord"))
    doc_lines = docs.join(first_seen, ["site", "cat"]).select(
        "site", F.lit(1).alias("section"), "cat_ord", "ord",
        F.concat(F.lit("  - ["), T.nz("title"), F.lit("]("), T.nz("url"), F.lit("): "), "note").alias("line"))
    heads = first_seen.select("site", F.lit(1).alias("section"), "cat_ord", F.lit(-1).cast("long").alias("ord"),
                              F.concat(F.lit("## "), F.col("cat")).alias("line"))
    per_site = docs.groupBy("site").agg(F.count(F.lit(1)).alias("pages"), F.min(F.struct("ord", "url")).alias("f"))
    domain = F.coalesce(F.nullif(U.netloc(F.col("f.url")), F.lit("")), F.col("f.url"))
    h_text = F.replace(F.replace(F.lit(header_text), F.lit("{domain}"), domain), F.lit("{base_url}"), F.col("f.url"))
    header = per_site.select("site", F.lit(0).alias("section"), F.lit(0).cast("long").alias("cat_ord"),
                             F.lit(0).cast("long").alias("ord"), h_text.alias("line"))
    footer = per_site.select("site", F.lit(2).alias("section"), F.lit(0).cast("long").alias("cat_ord"),
                             F.lit(0).cast("long").alias("ord"),
                             F.replace(F.lit(footer_text), F.lit("{pages}"), F.col("pages").cast("string")).alias("line"))
    return header.unionByName(heads).unionByName(doc_lines).unionByName(footer)


def write_rewrite_bundle(accepted: DataFrame, out_dir: str) -> None:
    """Markdown files, llms.txt lines and metadata of all sites, as JSON lines.

    The rewrite chain runs once (its result is written to the shared folder);
    the five outputs take the place of an earlier bundle together; every output is range-partitioned and sorted by site, so files follow the
    data and a very large site is written by several tasks.

    * ``markdown/`` - one line per document (site, file_name, content);
    * ``llms/`` - llms.txt lines in order of (site, section, category, document);
    * ``metadata/`` - per-page title, file name, URL and improvements, the
      per-site summary (A11) and its distinct improvements.
    """
    accepted = stored(accepted, "accepted")
    with replaced(accepted.sparkSession, out_dir) as draft:
        put = lambda df, name, *keys: df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.json(f"{draft}/{name}")
        put(accepted.select("site", "file_name", "title", "url", "content"), "markdown", "site", "file_name")
        put(llms_txt_lines(accepted), "llms", "site", "section", "cat_ord", "ord")
        put(accepted.select("site", "title", "file_name", F.col("url").alias("original_url"), "improvements"), "metadata/pages", "site", "file_name")
        put(improvement_summary(accepted), "metadata/summary", "site")
        put(distinct_improvements(accepted), "metadata/improvements", "site", "improvement")
