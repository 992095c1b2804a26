"""The twenty documentation rules as one projection + one grouped aggregate.

Each rule is a :class:`RuleSpec`: page-level signal columns (0/1 ints or
doubles, summed per site) plus a function that turns the per-site sums into
``(score, pages_checked, pages_passing, finding)`` Column expressions.

Physical shape of :func:`site_rule_wide` for any number of rules::

    scan(pages) → Project(signals) → HashAggregate(partial) → Exchange(site)
                → HashAggregate(final) → Project(rule structs)

One shuffle, whose input is one row per (map partition, site) thanks to the
partial aggregate — a site holding a third of all pages costs no more than
any other site.  Rules that the original evaluates on the concatenation of
all pages of a site (terminology, decisions, states) become "present on any
page" sums; phrases are matched within a page.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T


@dataclass(frozen=True)
class PageCtx:
    """Columns every signal may use (built once per page)."""
    content: Column = field(default_factory=lambda: F.col("_c"))
    lower: Column = field(default_factory=lambda: F.col("_lc"))
    title: Column = field(default_factory=lambda: F.col("_title"))
    description: Column = field(default_factory=lambda: F.col("description"))
    headings: Column = field(default_factory=lambda: F.col("headings"))
    code_blocks: Column = field(default_factory=lambda: F.col("code_blocks"))
    links: Column = field(default_factory=lambda: F.col("links"))
    has_tables: Column = field(default_factory=lambda: F.col("has_tables"))
    words: Column = field(default_factory=lambda: F.col("_words"))
    terms: Column = field(default_factory=lambda: F.col("_terms"))
    tokens: Column = field(default_factory=lambda: F.col("_tok"))


@dataclass(frozen=True)
class RuleSpec:
    rule_id: int
    name: str
    short_name: str
    component: str
    # signal name → builder(ctx) returning a numeric Column (summed per site)
    signals: dict[str, Callable[[PageCtx], Column]]
    # builder(agg: name → Column, n: Column) → (score, checked, passing, finding)
    result: Callable[[Callable[[str], Column], Column], tuple[Column, Column, Column, Column]]
    # optional per-site values computed from the sums before ``result`` (name → builder(col))
    derived: dict[str, Callable[[Callable[[str], Column]], Column]] = field(default_factory=dict)


def _i(c: Column) -> Column:
    return c.cast("int")


def fmt(template: str, **values) -> Column:
    """Fill ``{name}`` placeholders of a fixed message with Column values."""
    parts = re.split(r"(\{\w+\})", template)
    cols = []
    for p in parts:
        if p.startswith("{") and p.endswith("}"):
            cols.append(values[p[1:-1]].cast("string"))
        elif p:
            cols.append(F.lit(p))
    return F.concat(*cols)


def _ratio_rule(passing_sig: str, template_key):
    def result(a, n):
        p = a(passing_sig)
        return T.ratio_score(p, n), n, p, fmt(K.FINDINGS[template_key], passing=p, n=n)
    return result


def _lits(words):
    return F.array(*[F.lit(w) for w in words])


def P(c: PageCtx, pattern: str, key: str) -> Column:
    """Prefiltered case-insensitive search (see ``constants.PREFILTER``)."""
    return T.search_lc_pref(c.lower, c.tokens, pattern, K.PREFILTER[key])


def _has_code(ctx: PageCtx) -> Column:
    return F.size(ctx.code_blocks) > 0


def _word(term: str) -> str:
    return r"\b" + re.escape(term).replace(r"\ ", " ") + r"\b"


def _build_rules() -> list[RuleSpec]:
    meta = {rid: (name, short, comp) for rid, name, short, comp in K.RULES}
    specs: list[RuleSpec] = []

    def add(rid, signals, result, derived=None):
        name, short, comp = meta[rid]
        specs.append(RuleSpec(rid, name, short, comp, signals, result, derived or {}))

    # R1 — self-contained
    add(1, {"r1_pass": lambda c: _i(~P(c, K.R1_VAGUE_REFS, "R1"))}, _ratio_rule("r1_pass", 1))

    # R2 — action headings (ratio over headings, boosted)
    def r2(a, n):
        act, tot = a("r2_action"), a("r2_total")
        score = F.when(tot == 0, F.lit(0)).otherwise(
            F.least(F.lit(100), T.half_even(F.try_divide(act, tot) * F.lit(100) * F.lit(K.R2_BOOST))))
        finding = F.when(tot == 0, F.lit(K.FINDINGS["2_none"])).otherwise(
            fmt(K.FINDINGS[2], action=act, total=tot))
        return score, n, act, finding
    add(2, {
        "r2_total": lambda c: F.size(c.headings),
        # headings matching the pattern, without a lambda: one string per page with
        # \u0001 between heading texts; each match must start at a separator, so a
        # heading is counted at most once (\u0001 is neither \w nor \s)
        "r2_action": lambda c: F.regexp_count(
            F.lower(F.array_join(c.headings["text"], "\u0001")),
            F.lit(T.CS + "(?:^|\u0001)[^\u0001]*?" + K.R2_ACTION)),
    }, r2)

    # R3 — parameter tables
    def r3(a, n):
        params, tables = a("r3_params"), a("r3_tables")
        score = F.when(params == 0, F.lit(K.R3_NO_PARAMS)).otherwise(T.ratio_score(tables, params))
        finding = F.when(params == 0, F.lit(K.FINDINGS["3_none"])).otherwise(
            fmt(K.FINDINGS[3], tables=tables, params=params))
        return score, params, tables, finding
    add(3, {
        "r3_params": lambda c: _i(P(c, K.R3_PARAM, "R3")),
        "r3_tables": lambda c: _i(P(c, K.R3_PARAM, "R3")
                                  & (T.search(c.content, K.R3_TABLE_ROW, False) | F.coalesce(c.has_tables, F.lit(False)))),
    }, r3)

    # R4 — complete code
    def r4(a, n):
        code, complete = a("r4_code"), a("r4_complete")
        score = F.when(code == 0, F.lit(K.R4_NO_CODE)).otherwise(T.ratio_score(complete, code))
        finding = F.when(code == 0, F.lit(K.FINDINGS["4_none"])).otherwise(
            fmt(K.FINDINGS[4], complete=complete, code=code))
        return score, code, complete, finding

    def r4_complete(c):
        # any block's code has an import word (blocks joined by \u0001, a non-word character),
        # or any block has a language other than '' / 'text' — no lambda functions
        imports = T.search(F.array_join(c.code_blocks["code"], "\u0001"), K.R4_IMPORT, False)
        tagged = F.size(F.array_except(c.code_blocks["language"],
                                       F.array(F.lit(""), F.lit("text"), F.lit(None).cast("string")))) > 0
        return _i(_has_code(c) & (imports | tagged))
    add(4, {"r4_code": lambda c: _i(_has_code(c)), "r4_complete": r4_complete}, r4)

    # R5 — explicit language (at most two vague phrases)
    add(5, {"r5_pass": lambda c: _i(~F.arrays_overlap(c.tokens, _lits(K.PREFILTER["R5"])) | (T.count_matches_lc(c.lower, K.R5_VAGUE) <= K.R5_MAX_MATCHES))},
        _ratio_rule("r5_pass", 5))

    # R6 — error docs (site level)
    def r6(a, n):
        err, fix = a("r6_err"), a("r6_fix")
        hi, mid, lo = K.R6_SCORES
        score = F.when(fix > 0, F.lit(hi)).when(err > 0, F.lit(mid)).otherwise(F.lit(lo))
        finding = F.when(fix > 0, F.lit(K.FINDINGS["6_fix"])).when(err > 0, F.lit(K.FINDINGS["6_err"])) \
            .otherwise(F.lit(K.FINDINGS["6_none"]))
        return score, n, _i(fix > 0).cast("long"), finding
    add(6, {
        "r6_err": lambda c: _i(P(c, K.R6_ERROR, "R6_ERROR")),
        "r6_fix": lambda c: _i(P(c, K.R6_ERROR, "R6_ERROR") & P(c, K.R6_FIX, "R6_FIX")),
    }, r6)

    # R7 — terminology (site-level presence per term).  All terms are whole
    # words and none is a prefix-word of another phrase, so one pass that
    # extracts every term occurrence finds exactly the terms that a separate
    # search per term would find.
    r7_signals = {}
    for g, (terms, _label) in enumerate(K.R7_TERM_GROUPS):
        for t, term in enumerate(terms):
            r7_signals[f"r7_g{g}_t{t}"] = (lambda term: lambda c: _i(F.array_contains(c.terms, term)))(term)

    def r7_counts(a, at_least):
        out = F.lit(0)
        for g, (terms, _label) in enumerate(K.R7_TERM_GROUPS):
            found = sum((_i(a(f"r7_g{g}_t{t}") > 0) for t in range(len(terms))), F.lit(0))
            out = out + _i(found >= at_least)
        return out

    def r7(a, n):
        groups, conflicts = a("r7_groups"), a("r7_conflicts")
        score = F.when(groups == 0, F.lit(K.R7_NO_TERMS)).otherwise(
            T.ratio_score(groups - conflicts, groups))
        finding = F.when(groups == 0, F.lit(K.FINDINGS["7_none"])) \
            .when(conflicts > 0, fmt(K.FINDINGS["7_conflict"], conflicts=conflicts)) \
            .otherwise(F.lit(K.FINDINGS["7_ok"]))
        return score, n, n - conflicts, finding
    add(7, r7_signals, r7, {"r7_groups": lambda a: r7_counts(a, 1),
                            "r7_conflicts": lambda a: r7_counts(a, K.R7_CONFLICT_AT)})

    # R8 — frontmatter or title+description
    def r8_pass(c):
        front = c.content.rlike(r"^(?U)\s*---")
        meta_ok = F.coalesce(F.length(c.description) > 10, F.lit(False)) & (F.length(c.title) > 3)
        return _i(front | meta_ok)
    add(8, {"r8_pass": r8_pass}, _ratio_rule("r8_pass", 8))

    # R9 — prerequisites on how-to pages (all pages when there are none)
    def r9(a, n):
        howto, both, prereq = a("r9_howto"), a("r9_howto_prereq"), a("r9_prereq")
        checked = F.when(howto > 0, howto).otherwise(n)
        passing = F.when(howto > 0, both).otherwise(prereq)
        return T.ratio_score(passing, checked), checked, passing, fmt(K.FINDINGS[9], passing=passing, checked=checked)
    howto_title = lambda c: T.contains_any(F.lower(c.title), K.R9_HOWTO_TITLE)
    add(9, {
        "r9_howto": lambda c: _i(howto_title(c)),
        "r9_prereq": lambda c: _i(P(c, K.R9_PREREQ, "R9")),
        "r9_howto_prereq": lambda c: _i(howto_title(c) & P(c, K.R9_PREREQ, "R9")),
    }, r9)

    # R10 — expected outputs among code pages
    def r10(a, n):
        code, ok = a("r10_code"), a("r10_pass")
        score = F.when(code == 0, F.lit(K.R10_NO_CODE)).otherwise(T.ratio_score(ok, code))
        finding = F.when(code == 0, F.lit(K.FINDINGS["10_none"])).otherwise(fmt(K.FINDINGS[10], passing=ok, code=code))
        return score, code, ok, finding
    add(10, {
        "r10_code": lambda c: _i(_has_code(c)),
        "r10_pass": lambda c: _i(_has_code(c) & P(c, K.R10_OUTPUT, "R10")),
    }, r10)

    # R11 — descriptive link text among pages with links
    def r11(a, n):
        linked, ok = a("r11_linked"), a("r11_pass")
        score = F.when(linked == 0, F.lit(K.R11_NO_LINKS)).otherwise(T.ratio_score(ok, linked))
        finding = F.when(linked == 0, F.lit(K.FINDINGS["11_none"])).otherwise(
            fmt(K.FINDINGS[11], passing=ok, linked=linked))
        return score, linked, ok, finding
    add(11, {
        "r11_linked": lambda c: _i(F.size(c.links) > 0),
        "r11_pass": lambda c: _i((F.size(c.links) > 0) & ~P(c, K.R11_BAD_LINK_TEXT, "R11")),
    }, r11)

    # R12 — content types on title + first 200 chars
    def head_text(c):
        return F.lower(F.concat(c.title, F.lit(" "), F.substring(c.content, 1, K.R12_PREFIX_CHARS)))
    r12_signals = {f"r12_{i}": (lambda pat: lambda c: _i(T.search_lc(head_text(c), pat)))(pat)
                   for i, (_name, pat) in enumerate(K.R12_TYPES)}

    def r12(a, n):
        flags = [F.when(a(f"r12_{i}") > 0, F.lit(name)) for i, (name, _p) in enumerate(K.R12_TYPES)]
        types = sum((_i(a(f"r12_{i}") > 0) for i in range(len(K.R12_TYPES))), F.lit(0))
        listed = F.array_join(F.array(*flags), ", ")
        found = F.when(types == 0, F.lit(K.FINDINGS["12_none"])).otherwise(listed)
        return (F.least(F.lit(100), types * K.R12_POINTS_PER_TYPE), n, types.cast("long"),
                fmt(K.FINDINGS[12], types=found))
    add(12, r12_signals, r12)

    # R13 — version clarity, capped
    def r13(a, n):
        p = a("r13_pass")
        return (F.least(T.ratio_score(p, n), F.lit(K.R13_CAP)), n, p, fmt(K.FINDINGS[13], passing=p, n=n))
    add(13, {"r13_pass": lambda c: _i(T.search_lc(c.lower, K.R13_VERSION))}, r13)

    # R14 — decision docs (site level)
    def r14(a, n):
        d = a("r14_any") > 0
        yes, no = K.R14_SCORES
        return (F.when(d, F.lit(yes)).otherwise(F.lit(no)), n, _i(d).cast("long"),
                F.when(d, F.lit(K.FINDINGS["14_yes"])).otherwise(F.lit(K.FINDINGS["14_no"])))
    add(14, {"r14_any": lambda c: _i(P(c, K.R14_DECISION, "R14"))}, r14)

    # R15 — safety boundaries
    def r15(a, n):
        p = a("r15_pass")
        yes, no = K.R15_SCORES
        return (F.when(p > 0, F.lit(yes)).otherwise(F.lit(no)), n, p,
                F.when(p > 0, fmt(K.FINDINGS[15], passing=p)).otherwise(F.lit(K.FINDINGS["15_none"])))
    add(15, {"r15_pass": lambda c: _i(P(c, K.R15_SAFETY, "R15"))}, r15)

    # R16 — no marketing anti-patterns
    add(16, {"r16_pass": lambda c: _i(~P(c, K.R16_ANTIPATTERN, "R16"))}, _ratio_rule("r16_pass", 16))

    # R17 — heading density (full / half credit)
    def r17_good(c):
        density = F.try_divide(F.size(c.headings).cast("double"), c.words / F.lit(float(K.R17_WORDS_PER_UNIT)))
        return (F.when(c.words < K.R17_MIN_WORDS, F.lit(0.0))
                .when((density >= K.R17_FULL_DENSITY) & (c.words <= K.R17_MAX_WORDS), F.lit(1.0))
                .when(density >= K.R17_HALF_DENSITY, F.lit(0.5)).otherwise(F.lit(0.0)))

    def r17(a, n):
        good = a("r17_good")
        passing = F.floor(good).cast("long")
        return T.ratio_score(good, n), n, passing, fmt(K.FINDINGS[17], passing=passing, n=n)
    add(17, {"r17_good": r17_good}, r17)

    # R18 — intent first (first 500 chars, plain substrings)
    add(18, {"r18_pass": lambda c: _i(T.contains_any(F.lower(F.substring(c.content, 1, K.R18_PREFIX_CHARS)),
                                                     K.R18_INTENT))},
        _ratio_rule("r18_pass", 18))

    # R19 — states and arrows anywhere on the site
    def r19(a, n):
        st, ar = a("r19_state") > 0, a("r19_arrow") > 0
        both, only, none = K.R19_SCORES
        score = F.when(st & ar, F.lit(both)).when(st, F.lit(only)).otherwise(F.lit(none))
        finding = F.when(st & ar, F.lit(K.FINDINGS["19_both"])).when(st, F.lit(K.FINDINGS["19_states"])) \
            .otherwise(F.lit(K.FINDINGS["19_none"]))
        return score, n, _i(st & ar).cast("long"), finding
    add(19, {
        "r19_state": lambda c: _i(P(c, K.R19_STATE, "R19")),
        "r19_arrow": lambda c: _i(c.lower.rlike(K.R19_ARROW)),
    }, r19)

    # R20 — callouts (plain substrings, +20 bonus)
    def r20(a, n):
        p = a("r20_pass")
        return (F.least(F.lit(100), T.ratio_score(p, n) + F.lit(K.R20_BONUS)), n, p,
                fmt(K.FINDINGS[20], passing=p, n=n))
    add(20, {"r20_pass": lambda c: _i(T.contains_any(c.lower, K.R20_CALLOUT_SUBSTRINGS))}, r20)
    return specs


RULE_SPECS: list[RuleSpec] = _build_rules()
TERM_RX = r"\b(" + "|".join(re.escape(t).replace(r"\ ", " ") for terms, _l in K.R7_TERM_GROUPS for t in terms) + r")\b"


def register_rule(spec: RuleSpec) -> None:
    """Extension point: add a rule (e.g. rule 21) to the registry."""
    RULE_SPECS.append(spec)


# ---------------------------------------------------------------------------
# page signals and the site aggregate
# ---------------------------------------------------------------------------

def page_context(pages: DataFrame) -> DataFrame:
    """Add the shared per-page helper columns (null-safe text, lower-case, word count)."""
    return (pages
            .withColumn("_c", T.nz("content"))
            .withColumn("_lc", T.fold("_c"))
            .withColumn("_title", T.nz("title"))
            .withColumn("_words", T.word_count(F.col("_c")))
            .withColumn("_tok", T.anchor_tokens("_lc", sorted(set().union(*K.PREFILTER.values()))))
            .withColumn("_terms", F.when(F.arrays_overlap(F.col("_tok"), F.array(*[F.lit(a) for a in K.PREFILTER["R7"]])),
                                         F.array_distinct(F.regexp_extract_all(F.col("_lc"), F.lit(T.CS + TERM_RX), 1)))
                        .otherwise(F.array().cast("array<string>"))))


def page_signals(pages: DataFrame, specs: list[RuleSpec] | None = None, keep: tuple[str, ...] = ("site",)) -> DataFrame:
    """One row per page with every rule's signal columns (narrow, no shuffle)."""
    specs = specs or RULE_SPECS
    ctx = PageCtx()
    cols = [F.col(k) for k in keep]
    for spec in specs:
        for name, build in spec.signals.items():
            cols.append(build(ctx).alias(name))
    return page_context(pages).select(*cols)


def site_signal_sums(pages: DataFrame, specs: list[RuleSpec] | None = None) -> DataFrame:
    """groupBy(site): page count ``n`` plus the sum of every signal."""
    specs = specs or RULE_SPECS
    return sum_signals(page_signals(pages, specs), specs)


def signal_names(specs: list[RuleSpec] | None = None) -> list[str]:
    return [n for s in specs or RULE_SPECS for n in s.signals]


def sum_signals(signals: DataFrame, specs: list[RuleSpec] | None = None) -> DataFrame:
    """Signal rows (site and signals) to one row per site."""
    return signals.groupBy("site").agg(F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(n) for n in signal_names(specs)])


def _rule_parts(spec: RuleSpec) -> list[Column]:
    n = F.col("n")
    score, checked, passing, finding = spec.result(lambda name: F.col(name), n)
    rid = spec.rule_id
    return [score.cast("int").alias(f"_s{rid}"), checked.cast("long").alias(f"_c{rid}"),
            passing.cast("long").alias(f"_p{rid}"), finding.alias(f"_f{rid}")]


def _rule_struct(spec: RuleSpec) -> Column:
    rid = spec.rule_id
    score = F.col(f"_s{rid}")
    return F.struct(
        F.lit(rid).alias("rule_id"), F.lit(spec.name).alias("name"),
        F.lit(spec.short_name).alias("short_name"), F.lit(spec.component).alias("category"),
        score.alias("score"), T.status(score).alias("status"), F.col(f"_f{rid}").alias("finding"),
        F.col(f"_c{rid}").alias("pages_checked"), F.col(f"_p{rid}").alias("pages_passing"))


def site_rule_wide(pages: DataFrame, specs: list[RuleSpec] | None = None) -> DataFrame:
    """One row per site: ``site, n, rules array<struct<rule_id, …>>`` (sorted by rule_id).

    Three projections over the aggregate: rule-specific derived values (e.g.
    terminology group counts), then score / checked / passing / finding per
    rule, then the struct array.  Each value is computed once and referenced,
    which also keeps every generated method under the JVM's 64 KB limit.
    """
    return rules_of_sums(site_signal_sums(pages, specs), specs)


def rules_of_sums(sums: DataFrame, specs: list[RuleSpec] | None = None) -> DataFrame:
    """The rule array of sites whose signal sums are known (:func:`site_signal_sums`)."""
    specs = sorted(specs or RULE_SPECS, key=lambda s: s.rule_id)
    derived = [build(F.col).alias(name) for s in specs for name, build in s.derived.items()]
    if derived:
        sums = sums.select("*", *derived)
    parts = sums.select("site", "n", *[c for s in specs for c in _rule_parts(s)])
    return parts.select("site", "n", F.array(*[_rule_struct(s) for s in specs]).alias("rules"))


def rule_results(pages: DataFrame, specs: list[RuleSpec] | None = None) -> DataFrame:
    """A1: one row per (site, rule)."""
    return site_rule_wide(pages, specs).select("site", F.inline_outer("rules"))
