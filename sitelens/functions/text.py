"""Scalar text functions as Spark Column expressions (JVM side, codegen'd).

Regex flags: Spark uses java.util.regex.  ``(?U)`` makes ``\\b``, ``\\w``,
``\\s`` and ``\\d`` Unicode-aware and ``(?i)`` case folding Unicode-aware,
which is what Python's ``re`` does on str patterns.  ``(?d)`` (UNIX_LINES)
makes ``.`` and ``^``/``$`` treat only ``\\n`` as a line break, as Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .entities import unescape_text

CI = "(?iUd)"   # case-insensitive search
CS = "(?Ud)"    # case-sensitive search


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def search(c, pattern: str, case_insensitive: bool = True) -> Column:
    """True when ``pattern`` occurs anywhere in the text (Python ``re.search``)."""
    return col_of(c).rlike((CI if case_insensitive else CS) + pattern)


def search_lc(lower_text, pattern: str) -> Column:
    """Case-insensitive search on text that is already lower-cased (``F.lower``).

    Lower-casing once per page and matching lower-case patterns without the
    ``(?i)`` flag is cheaper than case folding inside every regex.
    """
    return col_of(lower_text).rlike(CS + pattern)


def fold(c) -> Column:
    """Lower-cased text in which the code points that a case-insensitive search takes for the ASCII
    letters i, k and s (capital I with dot, dotless i, Kelvin sign, long s) are these letters."""
    c = nz(c)
    return F.lower(F.when(contains_any(c, "\u0130\u0131\u212A\u017F"), F.translate(c, "\u0130\u0131\u212A\u017F", "iiks")).otherwise(c))


def word_tokens(lower_text) -> Column:
    """Distinct word tokens (maximal runs of Unicode word characters, as ``\\b`` sees them)."""
    return F.array_distinct(F.split(col_of(lower_text), r"(?U)\W+"))


def anchor_tokens(lower_text, anchors) -> Column:
    """The anchors that occur among the text's word tokens: one pass, after which each rule looks at a short array."""
    return F.array_intersect(F.split(col_of(lower_text), r"(?U)\W+"), F.array(*[F.lit(a) for a in anchors]))


def search_lc_pref(lower_text, tokens, pattern: str, anchors) -> Column:
    """``search_lc`` that runs the regex only when an anchor token is present.

    The anchors must satisfy the invariant stated in ``constants.PREFILTER``;
    the result is then identical to the plain search.
    """
    return F.arrays_overlap(col_of(tokens), F.array(*[F.lit(a) for a in anchors])) & search_lc(lower_text, pattern)


def count_matches_lc(lower_text, pattern: str) -> Column:
    return F.regexp_count(col_of(lower_text), F.lit(CS + pattern))


def count_matches(c, pattern: str, case_insensitive: bool = True) -> Column:
    """Number of non-overlapping matches (Python ``len(re.findall(...))``)."""
    return F.regexp_count(col_of(c), F.lit((CI if case_insensitive else CS) + pattern))


def contains_any(c, phrases) -> Column:
    """Plain substring presence of any phrase (no regex)."""
    c = col_of(c)
    out = F.lit(False)
    for p in phrases:
        out = out | c.contains(p)
    return out


def nz(c) -> Column:
    """Null text as empty string."""
    return F.coalesce(col_of(c), F.lit(""))


def word_count(c) -> Column:
    """Whitespace-separated non-empty tokens (Python ``len(s.split())``)."""
    return F.regexp_count(nz(c), F.lit(r"(?U)\S+"))


def half_even(x) -> Column:
    """Python ``round(x)`` on a float: banker's rounding to an int."""
    return F.bround(col_of(x), 0).cast("int")


def ratio_score(passing, total) -> Column:
    """``round(passing / total * 100)``; null when total is 0."""
    return half_even(F.try_divide(col_of(passing), col_of(total)) * F.lit(100))


def grade(score) -> Column:
    s = col_of(score)
    expr = None
    for bound, g in K.GRADES:
        expr = F.when(s >= bound, F.lit(g)) if expr is None else expr.when(s >= bound, F.lit(g))
    return expr.otherwise(F.lit("F"))


def status(score) -> Column:
    s = col_of(score)
    return F.when(s >= K.STATUS_PASS, "pass").when(s >= K.STATUS_WARN, "warning").otherwise("fail")


def severity(score) -> Column:
    s = col_of(score)
    return F.when(s < K.STATUS_WARN, "high").when(s < K.STATUS_PASS, "medium").otherwise("low")


def interpretation(grade_col) -> Column:
    pairs = []
    for g, text in K.GRADE_TEXT.items():
        pairs += [F.lit(g), F.lit(text)]
    return F.coalesce(F.create_map(*pairs)[col_of(grade_col)], F.lit("Unknown"))


def slugify(c) -> Column:
    """lower/trim, keep [a-z0-9 whitespace -], runs of space/- to '-', trim '-', default 'product'."""
    s = F.lower(F.trim(nz(c)))
    s = F.regexp_replace(s, r"[^a-z0-9\s-]", "")
    s = F.regexp_replace(s, r"[\s-]+", "-")
    s = F.regexp_replace(s, r"^-+|-+$", "")
    return F.when(s == "", F.lit("product")).otherwise(s)


def title_case(c) -> Column:
    """Python ``str.title()``: upper after every non-letter, lower elsewhere."""
    s = F.lower(nz(c))
    # split into letter runs and non-letter runs, capitalise letter runs
    parts = F.regexp_extract_all(s, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)),
                                                               F.substring(p, 2, 1 << 30))), "")


def strip_frontmatter(c) -> Column:
    """Text starting with '---' → the part after the second '---'."""
    s = nz(c)
    parts = F.split(s, "---", 3)
    return F.when(s.startswith("---") & (F.size(parts) >= 3), strip_ws(parts[2])).otherwise(s)


def html_escape(c) -> Column:
    """Decode all character references first, then escape & < > \" (no double escaping)."""
    s = unescape_text(nz(c))
    for ch, ent in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(ch), F.lit(ent))
    return s


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove leading and trailing (Unicode) whitespace."""
    return F.regexp_replace(col_of(c), r"^(?U)\s+|(?U)\s+$", "")


def strip_json_fences(c) -> Column:
    """Trim; drop a leading ``` line and a trailing ```.

    Written as a chain where each step reads the previous one once, so the
    expression tree stays linear (no re-evaluation of shared inputs).
    """
    s = strip_ws(nz(c))
    s = F.regexp_replace(s, r"^```[^\n]*\n?", "")
    s = F.regexp_replace(s, r"```$", "")
    return strip_ws(s)


def truncation_status(c, max_chars: int = 12000) -> Column:
    return F.when(F.length(nz(c)) >= max_chars - 100, "possibly_truncated").otherwise("complete")


def percent_text(x) -> Column:
    """JS ``Math.round(x*100) + '%'`` (half up)."""
    return F.concat(F.floor(col_of(x) * 100 + 0.5).cast("long").cast("string"), F.lit("%"))


def risk_label(c) -> Column:
    labels = {"safe_read": "SAFE", "safe_write": "SAFE WRITE", "requires_confirmation": "CONFIRM",
              "requires_escalation": "ESCALATE", "high_risk": "HIGH RISK"}
    pairs = []
    for k, v in labels.items():
        pairs += [F.lit(k), F.lit(v)]
    fallback = title_case(F.replace(nz(c), F.lit("_"), F.lit(" ")))
    return F.coalesce(F.create_map(*pairs)[col_of(c)], fallback)


def contains_any_prefix(c, prefixes) -> Column:
    """True when the text starts with any of the prefixes."""
    c = col_of(c)
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out
