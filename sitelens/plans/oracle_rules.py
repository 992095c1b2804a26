"""Independent DuckDB formulation of the rule engine, used as the oracle.

It starts from the flat ``site_pages`` fixture columns (heading text with
pipes, one optional code block, a link count) instead of the nested page
schema, and evaluates each rule with RE2 regexes in plain SQL.  Patterns are
the same fixed values the Spark side uses; everything else (aggregation,
formulas, messages) is written again here in SQL.
"""

from __future__ import annotations

import re

from .. import constants as K
from ..sources.fixtures import SITE_PAGES_SELECT


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(col: str, pattern: str, ci: bool = True) -> str:
    return f"regexp_matches({col}, {q(('(?i)' if ci else '') + pattern)})"


def ratio(p: str, n: str) -> str:
    return f"CAST(round_even({p} / {n} * 100, 0) AS INTEGER)"


def word(term: str) -> str:
    return r"\b" + re.escape(term).replace(r"\ ", " ") + r"\b"


def _i(cond: str) -> str:
    return f"CAST(CASE WHEN {cond} THEN 1 ELSE 0 END AS BIGINT)"


def page_cte(revise_content: str | None = None) -> str:
    terms = []
    for g, (ts, _l) in enumerate(K.R7_TERM_GROUPS):
        for t, term in enumerate(ts):
            terms.append(f"{_i(rx('lc', word(term), False))} AS r7_g{g}_t{t}")
    intent = " OR ".join(f"contains(lower(substr(c, 1, {K.R18_PREFIX_CHARS})), {q(p)})" for p in K.R18_INTENT)
    howto = " OR ".join(f"contains(lower(t), {q(p)})" for p in K.R9_HOWTO_TITLE)
    head = f"(t || ' ' || substr(c, 1, {K.R12_PREFIX_CHARS}))"
    has_code = "code_txt IS NOT NULL"
    r12 = ",\n".join(f"{_i(rx(head, pat))} AS r12_{i}" for i, (_n, pat) in enumerate(K.R12_TYPES))
    words = "len(list_filter(regexp_split_to_array(c, '\\s+'), lambda x: x <> ''))"
    return f"""
sp AS ({_sp_sql(revise_content)}),
pg AS (SELECT site, ord, coalesce(content, '') AS c, lower(coalesce(content, '')) AS lc, coalesce(title, '') AS t,
              description, CASE WHEN heading_txt = '' THEN [] ELSE string_split(heading_txt, '|') END AS heads,
              code_txt, code_lang, link_n, has_tables FROM sp),
pw AS (SELECT *, {words} AS wc FROM pg),
sig AS (SELECT site, ord,
 {_i('NOT ' + rx('c', K.R1_VAGUE_REFS))} AS r1_pass,
 CAST(len(heads) AS BIGINT) AS r2_total,
 CAST(len(list_filter(heads, lambda h: {rx('h', K.R2_ACTION)})) AS BIGINT) AS r2_action,
 {_i(rx('c', K.R3_PARAM))} AS r3_params,
 {_i(rx('c', K.R3_PARAM) + ' AND (' + rx('c', K.R3_TABLE_ROW, False) + ' OR coalesce(has_tables, false))')} AS r3_tables,
 {_i(has_code)} AS r4_code,
 {_i(has_code + ' AND (' + rx('code_txt', K.R4_IMPORT, False) + " OR coalesce(code_lang, '') NOT IN ('', 'text'))")} AS r4_complete,
 {_i(f"len(regexp_extract_all(c, {q('(?i)' + K.R5_VAGUE)})) <= {K.R5_MAX_MATCHES}")} AS r5_pass,
 {_i(rx('c', K.R6_ERROR))} AS r6_err,
 {_i(rx('c', K.R6_ERROR) + ' AND ' + rx('c', K.R6_FIX))} AS r6_fix,
 {", ".join(terms)},
 {_i("regexp_matches(c, '^\\s*---') OR (coalesce(length(description) > 10, false) AND length(t) > 3)")} AS r8_pass,
 {_i(howto)} AS r9_howto,
 {_i(rx('c', K.R9_PREREQ))} AS r9_prereq,
 {_i('(' + howto + ') AND ' + rx('c', K.R9_PREREQ))} AS r9_howto_prereq,
 {_i(has_code)} AS r10_code,
 {_i(has_code + ' AND ' + rx('c', K.R10_OUTPUT))} AS r10_pass,
 {_i('link_n > 0')} AS r11_linked,
 {_i('link_n > 0 AND NOT ' + rx('c', K.R11_BAD_LINK_TEXT))} AS r11_pass,
 {r12},
 {_i(rx('c', K.R13_VERSION))} AS r13_pass,
 {_i(rx('lc', K.R14_DECISION))} AS r14_any,
 {_i(rx('c', K.R15_SAFETY))} AS r15_pass,
 {_i('NOT ' + rx('c', K.R16_ANTIPATTERN))} AS r16_pass,
 CASE WHEN wc < {K.R17_MIN_WORDS} THEN 0.0
      WHEN len(heads) / (wc / {float(K.R17_WORDS_PER_UNIT)}) >= {K.R17_FULL_DENSITY} AND wc <= {K.R17_MAX_WORDS} THEN 1.0
      WHEN len(heads) / (wc / {float(K.R17_WORDS_PER_UNIT)}) >= {K.R17_HALF_DENSITY} THEN 0.5 ELSE 0.0 END AS r17_good,
 {_i(intent)} AS r18_pass,
 {_i(rx('lc', K.R19_STATE))} AS r19_state,
 {_i(rx('lc', K.R19_ARROW, False))} AS r19_arrow,
 {_i(rx('c', K.R20_CALLOUT))} AS r20_pass
FROM pw),
sums AS (SELECT site, CAST(count(*) AS BIGINT) AS n, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in _sig_names() if c != 'r17_good')},
 CAST(sum(r17_good) AS DOUBLE) AS r17_good FROM sig GROUP BY site)"""


def _sp_sql(revise_content: str | None) -> str:
    base = f"SELECT {SITE_PAGES_SELECT} FROM documents"
    if revise_content is None:
        return base
    return f"SELECT * REPLACE ({revise_content} AS content) FROM ({base}) b"


def _sig_names() -> list[str]:
    names = ["r1_pass", "r2_total", "r2_action", "r3_params", "r3_tables", "r4_code", "r4_complete", "r5_pass",
             "r6_err", "r6_fix"]
    for g, (ts, _l) in enumerate(K.R7_TERM_GROUPS):
        names += [f"r7_g{g}_t{t}" for t in range(len(ts))]
    names += ["r8_pass", "r9_howto", "r9_prereq", "r9_howto_prereq", "r10_code", "r10_pass", "r11_linked",
              "r11_pass"]
    names += [f"r12_{i}" for i in range(len(K.R12_TYPES))]
    names += ["r13_pass", "r14_any", "r15_pass", "r16_pass", "r17_good", "r18_pass", "r19_state", "r19_arrow",
              "r20_pass"]
    return names


def _s(x) -> str:
    return f"CAST({x} AS VARCHAR)"


def _msg(template: str, **vals) -> str:
    parts = re.split(r"(\{\w+\})", template)
    out = []
    for p in parts:
        if p.startswith("{") and p.endswith("}"):
            out.append(_s(vals[p[1:-1]]))
        elif p:
            out.append(q(p))
    return " || ".join(out)


def rule_rows_sql() -> list[str]:
    """One SELECT per rule over ``sums``: (site, rule_id, score, checked, passing, finding)."""
    F = K.FINDINGS
    rows = {}

    def ratio_rule(rid, p):
        rows[rid] = (ratio(p, "n"), "n", p, _msg(F[rid], passing=p, n="n"))
    ratio_rule(1, "r1_pass")
    rows[2] = (f"CASE WHEN r2_total = 0 THEN 0 ELSE least(100, CAST(round_even(r2_action / r2_total * 100 * {K.R2_BOOST}, 0) AS INTEGER)) END",
               "n", "r2_action",
               f"CASE WHEN r2_total = 0 THEN {q(F['2_none'])} ELSE {_msg(F[2], action='r2_action', total='r2_total')} END")
    rows[3] = (f"CASE WHEN r3_params = 0 THEN {K.R3_NO_PARAMS} ELSE {ratio('r3_tables', 'r3_params')} END",
               "r3_params", "r3_tables",
               f"CASE WHEN r3_params = 0 THEN {q(F['3_none'])} ELSE {_msg(F[3], tables='r3_tables', params='r3_params')} END")
    rows[4] = (f"CASE WHEN r4_code = 0 THEN {K.R4_NO_CODE} ELSE {ratio('r4_complete', 'r4_code')} END",
               "r4_code", "r4_complete",
               f"CASE WHEN r4_code = 0 THEN {q(F['4_none'])} ELSE {_msg(F[4], complete='r4_complete', code='r4_code')} END")
    ratio_rule(5, "r5_pass")
    hi, mid, lo = K.R6_SCORES
    rows[6] = (f"CASE WHEN r6_fix > 0 THEN {hi} WHEN r6_err > 0 THEN {mid} ELSE {lo} END", "n",
               "CASE WHEN r6_fix > 0 THEN 1 ELSE 0 END",
               f"CASE WHEN r6_fix > 0 THEN {q(F['6_fix'])} WHEN r6_err > 0 THEN {q(F['6_err'])} ELSE {q(F['6_none'])} END")
    found = []
    for g, (ts, _l) in enumerate(K.R7_TERM_GROUPS):
        found.append("(" + " + ".join(f"(CASE WHEN r7_g{g}_t{t} > 0 THEN 1 ELSE 0 END)" for t in range(len(ts))) + ")")
    groups = "(" + " + ".join(f"(CASE WHEN {f} >= 1 THEN 1 ELSE 0 END)" for f in found) + ")"
    conflicts = "(" + " + ".join(f"(CASE WHEN {f} >= {K.R7_CONFLICT_AT} THEN 1 ELSE 0 END)" for f in found) + ")"
    rows[7] = (f"CASE WHEN {groups} = 0 THEN {K.R7_NO_TERMS} ELSE {ratio(f'({groups} - {conflicts})', groups)} END",
               "n", f"n - {conflicts}",
               f"CASE WHEN {groups} = 0 THEN {q(F['7_none'])} WHEN {conflicts} > 0 THEN {_msg(F['7_conflict'], conflicts=conflicts)} ELSE {q(F['7_ok'])} END")
    ratio_rule(8, "r8_pass")
    chk = "(CASE WHEN r9_howto > 0 THEN r9_howto ELSE n END)"
    pas = "(CASE WHEN r9_howto > 0 THEN r9_howto_prereq ELSE r9_prereq END)"
    rows[9] = (ratio(pas, chk), chk, pas, _msg(F[9], passing=pas, checked=chk))
    rows[10] = (f"CASE WHEN r10_code = 0 THEN {K.R10_NO_CODE} ELSE {ratio('r10_pass', 'r10_code')} END",
                "r10_code", "r10_pass",
                f"CASE WHEN r10_code = 0 THEN {q(F['10_none'])} ELSE {_msg(F[10], passing='r10_pass', code='r10_code')} END")
    rows[11] = (f"CASE WHEN r11_linked = 0 THEN {K.R11_NO_LINKS} ELSE {ratio('r11_pass', 'r11_linked')} END",
                "r11_linked", "r11_pass",
                f"CASE WHEN r11_linked = 0 THEN {q(F['11_none'])} ELSE {_msg(F[11], passing='r11_pass', linked='r11_linked')} END")
    types = "(" + " + ".join(f"(CASE WHEN r12_{i} > 0 THEN 1 ELSE 0 END)" for i in range(len(K.R12_TYPES))) + ")"
    listed = "concat_ws(', ', " + ", ".join(f"CASE WHEN r12_{i} > 0 THEN {q(name)} END"
                                           for i, (name, _p) in enumerate(K.R12_TYPES)) + ")"
    rows[12] = (f"least(100, {types} * {K.R12_POINTS_PER_TYPE})", "n", types,
                q(F[12].split("{")[0]) + f" || CASE WHEN {types} = 0 THEN {q(F['12_none'])} ELSE {listed} END")
    rows[13] = (f"least({ratio('r13_pass', 'n')}, {K.R13_CAP})", "n", "r13_pass", _msg(F[13], passing="r13_pass", n="n"))
    y, no = K.R14_SCORES
    rows[14] = (f"CASE WHEN r14_any > 0 THEN {y} ELSE {no} END", "n", "CASE WHEN r14_any > 0 THEN 1 ELSE 0 END",
                f"CASE WHEN r14_any > 0 THEN {q(F['14_yes'])} ELSE {q(F['14_no'])} END")
    y, no = K.R15_SCORES
    rows[15] = (f"CASE WHEN r15_pass > 0 THEN {y} ELSE {no} END", "n", "r15_pass",
                f"CASE WHEN r15_pass > 0 THEN {_msg(F[15], passing='r15_pass')} ELSE {q(F['15_none'])} END")
    ratio_rule(16, "r16_pass")
    rows[17] = (ratio("r17_good", "n"), "n", "CAST(floor(r17_good) AS BIGINT)",
                _msg(F[17], passing="CAST(floor(r17_good) AS BIGINT)", n="n"))
    ratio_rule(18, "r18_pass")
    both, only, none = K.R19_SCORES
    rows[19] = (f"CASE WHEN r19_state > 0 AND r19_arrow > 0 THEN {both} WHEN r19_state > 0 THEN {only} ELSE {none} END",
                "n", "CASE WHEN r19_state > 0 AND r19_arrow > 0 THEN 1 ELSE 0 END",
                f"CASE WHEN r19_state > 0 AND r19_arrow > 0 THEN {q(F['19_both'])} WHEN r19_state > 0 THEN {q(F['19_states'])} ELSE {q(F['19_none'])} END")
    rows[20] = (f"least(100, {ratio('r20_pass', 'n')} + {K.R20_BONUS})", "n", "r20_pass",
                _msg(F[20], passing="r20_pass", n="n"))
    out = []
    for rid, name, short, comp in K.RULES:
        score, checked, passing, finding = rows[rid]
        out.append(f"SELECT site, {rid} AS rule_id, {q(name)} AS name, {q(short)} AS short_name, {q(comp)} AS category, "
                   f"CAST({score} AS INTEGER) AS score, CAST({checked} AS BIGINT) AS pages_checked, "
                   f"CAST({passing} AS BIGINT) AS pages_passing, {finding} AS finding FROM sums")
    return out


def rules_cte(revise_content: str | None = None) -> str:
    status = (f"CASE WHEN score >= {K.STATUS_PASS} THEN 'pass' WHEN score >= {K.STATUS_WARN} THEN 'warning' "
              f"ELSE 'fail' END")
    union = "\nUNION ALL\n".join(rule_rows_sql())
    return f"""WITH {page_cte(revise_content)},
rr0 AS ({union}),
rr AS (SELECT *, {status} AS status FROM rr0)"""


def grade_sql(col: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} >= {b} THEN {q(g)}" for b, g in K.GRADES) + " ELSE 'F' END"


def components_cte() -> str:
    comp_cols = ", ".join(
        f"CAST(coalesce(round_even(avg(CASE WHEN category = {q(c)} THEN score END), 0), 0) AS INTEGER) AS {c}"
        for c, _w in K.COMPONENTS)
    overall = " + ".join(f"CAST({c} AS DOUBLE) * CAST({w} AS DOUBLE)" for c, w in K.COMPONENTS)
    return f"""comp AS (SELECT site, {comp_cols},
  CAST(sum(CASE WHEN status = 'pass' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS pr FROM rr GROUP BY site),
scored AS (SELECT *, CAST(round_even({overall}, 0) AS INTEGER) AS overall_score FROM comp)"""


def site_rule_results_sql() -> str:
    return rules_cte() + "\nSELECT site, rule_id, name, short_name, category, score, status, finding, pages_checked, pages_passing FROM rr"


def site_scores_sql(empty_sites_from: str | None = None, revise_content: str | None = None) -> str:
    comps = ", ".join(c for c, _ in K.COMPONENTS)
    body = (rules_cte(revise_content) + ",\n" + components_cte() +
            f"\nSELECT s.site, n AS pages, overall_score, {grade_sql('overall_score')} AS grade, {comps}, "
            f"round(pr, 6) AS pass_rate FROM scored s JOIN sums USING (site)")
    if empty_sites_from:
        zero = ", ".join(f"0 AS {c}" for c, _ in K.COMPONENTS)
        body += (f"\nUNION ALL SELECT site, CAST(0 AS BIGINT) AS pages, 0 AS overall_score, 'F' AS grade, {zero}, "
                 f"0.0 AS pass_rate FROM ({empty_sites_from}) e WHERE site NOT IN (SELECT site FROM sp)")
    return body


def top_issues_sql(k: int = K.TOP_ISSUES_K) -> str:
    sev = (f"CASE WHEN score < {K.STATUS_WARN} THEN 'high' WHEN score < {K.STATUS_PASS} THEN 'medium' ELSE 'low' END")
    cat, title, severity, rid, rname, score = K.ALL_PASSING_ISSUE
    return rules_cte() + f""",
bad AS (SELECT site, score, rule_id, category, 'Rule ' || CAST(rule_id AS VARCHAR) || ': ' || name || ' — ' || finding AS title,
        {sev} AS severity, short_name AS rule_name,
        row_number() OVER (PARTITION BY site ORDER BY score, rule_id) AS rank FROM rr WHERE status IN ('fail', 'warning'))
SELECT site, CAST(rank AS INTEGER) AS rank, score, rule_id, category, title, severity, rule_name FROM bad WHERE rank <= {k}
UNION ALL
SELECT site, 1, {score}, {rid}, {q(cat)}, {q(title)}, {q(severity)}, {q(rname)} FROM sums WHERE site NOT IN (SELECT site FROM bad)"""


def rule_status_counts_sql() -> str:
    return rules_cte() + """
SELECT site, CAST(count_if(status = 'pass') AS INTEGER) AS n_pass, CAST(count_if(status = 'warning') AS INTEGER) AS n_warning,
       CAST(count_if(status = 'fail') AS INTEGER) AS n_fail FROM rr GROUP BY site"""


def rule_pass_rate_sql() -> str:
    return rules_cte() + """
SELECT site, CAST(count(*) AS INTEGER) AS query_count, round(CAST(count_if(status = 'pass') AS DOUBLE) / count(*), 6) AS pass_rate,
       0 AS avg_latency_ms FROM rr GROUP BY site"""
