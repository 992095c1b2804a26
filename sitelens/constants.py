"""Fixed values that must equal the behaviour being reproduced.

Everything in this module is data, not logic: vocabularies, regular
expressions, rule metadata, thresholds, grade boundaries and message
formats.  They are stated plainly, in their natural order, so that a
reader can audit them against the behaviour they stand for.  Regular
expressions are written in the common subset of Python/Java syntax; the
Spark side adds the ``(?iU)`` flags (Unicode-aware case folding and
classes) and the SQL oracle adds ``(?i)``.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — scoring model
# ---------------------------------------------------------------------------

# (rule_id, display name, short name, component)
RULES = [
    (1, "Self-Contained Sections", "self_contained", "accuracy"),
    (2, "Action-Oriented Headings", "action_headings", "context_utilization"),
    (3, "Structured Parameter Tables", "param_tables", "structure"),
    (4, "Complete, Runnable Code Examples", "complete_code", "code_executability"),
    (5, "Explicit Over Implicit", "explicit_language", "accuracy"),
    (6, "First-Class Error Documentation", "error_docs", "code_executability"),
    (7, "Consistent Terminology", "terminology", "accuracy"),
    (8, "Page Metadata (Frontmatter)", "frontmatter", "context_utilization"),
    (9, "Prerequisites Stated Up Front", "prerequisites", "citation_quality"),
    (10, "Expected Outputs Documented", "expected_outputs", "citation_quality"),
    (11, "Cross-References with Context", "cross_refs", "context_utilization"),
    (12, "Content Type Separation", "content_types", "accuracy"),
    (13, "Version Clarity", "versioning", "accuracy"),
    (14, "Decision Documentation", "decision_docs", "citation_quality"),
    (15, "Safety Boundaries", "safety", "structure"),
    (16, "No Anti-Patterns", "no_antipatterns", "structure"),
    (17, "Retrieval-Chunk Optimized", "chunking", "context_utilization"),
    (18, "Intent Before Mechanics", "intent_first", "accuracy"),
    (19, "State Transitions & Lifecycle", "state_transitions", "citation_quality"),
    (20, "Callouts & Admonitions", "callouts", "structure"),
]

# Components in weighting order, with their weights (site rule score).
COMPONENTS = [
    ("accuracy", 0.30),
    ("context_utilization", 0.25),
    ("citation_quality", 0.20),
    ("code_executability", 0.15),
    ("structure", 0.10),
]

# Query scorer: same first four components, latency in place of structure.
QUERY_COMPONENTS = [
    ("accuracy", 0.30),
    ("context_utilization", 0.25),
    ("citation_quality", 0.20),
    ("code_executability", 0.15),
    ("latency", 0.10),
]

# Lowest score for each grade, best first.
GRADES = [
    (97, "A+"), (93, "A"), (90, "A-"),
    (87, "B+"), (83, "B"), (80, "B-"),
    (77, "C+"), (73, "C"), (70, "C-"),
    (60, "D"), (0, "F"),
]

# status: >= 70 pass, >= 40 warning, else fail.  severity: < 40 high, < 70 medium, else low.
STATUS_PASS, STATUS_WARN = 70, 40

GRADE_TEXT = {
    "A+": "Exceptional — your docs are a competitive weapon in the agent economy",
    "A": "Excellent — agents confidently recommend your product",
    "A-": "Very good — minor gaps that could cost you agent referrals",
    "B+": "Good — but competitors with better docs are getting recommended first",
    "B": "Above average — meaningful agent visibility gaps exist",
    "B-": "Average — you're losing deals to better-documented competitors",
    "C+": "Below average — agents struggle to recommend you accurately",
    "C": "Concerning — agents are likely recommending competitors instead",
    "C-": "Poor — your docs are effectively invisible to AI agents",
    "D": "Critical — agents cannot use your docs at all",
    "F": "Failing — complete restructuring needed to enter the agent economy",
}

# ---------------------------------------------------------------------------
# FIXED VALUES — rule vocabularies (regex, word-bounded unless noted)
# ---------------------------------------------------------------------------

R1_VAGUE_REFS = (
    r"\bsee\s+(above|previous|earlier)\b"
    r"|\bas\s+(mentioned|described|noted|shown|discussed)\s+(above|earlier|previously)\b"
    r"|\brefer\s+to\s+(the\s+)?(above|previous)\b"
    r"|\bthe\s+previous\s+(section|example|step)\b"
)
R2_ACTION = (
    r"\b(how\s+to|create|send|configure|set\s*up|install|authenticate|deploy|"
    r"handle|verify|migrate|troubleshoot|debug|retry|list|get|update|delete|"
    r"build|connect|test|monitor|manage|enable|disable|upgrade)\b"
)
R3_PARAM = r"\b(parameter|argument|option|field|property|attribute)\b"
R3_TABLE_ROW = r"\|.*\|.*\|"
R4_IMPORT = r"\b(import|require|from|include|using|use)\b"  # case-sensitive
R5_VAGUE = (
    r"\b(typically|usually|simply|obviously|you\s+may\s+want\s+to|"
    r"it\s+works\s+like|as\s+you\s+might\s+expect|you\s+just\s+need\s+to|"
    r"it's\s+easy\s+to)\b"
)
R5_MAX_MATCHES = 2
R6_ERROR = (
    r"\b(error\s+code|status\s+code|error\s+message|troubleshoot|"
    r"common\s+errors|error\s+handling|exception|4[0-9]{2}|5[0-9]{2})\b"
)
R6_FIX = r"\b(fix|solution|resolve|how\s+to\s+fix|workaround|remedy|recovery|retry|fallback)\b"
# (terms, label) — whole-word presence on lower-cased text
R7_TERM_GROUPS = [
    (["workspace", "organization", "org", "team", "project"], "workspace entity"),
    (["token", "api key", "secret", "credential"], "authentication credential"),
    (["endpoint", "route", "path"], "API endpoint"),
]
R7_CONFLICT_AT = 3
R9_HOWTO_TITLE = [
    "how", "guide", "tutorial", "start", "setup", "install", "quick",
    "get started", "getting started", "build", "create", "set up",
    "configure", "integrate", "accept",
]
R9_PREREQ = (
    r"\b(prerequisite|before\s+you\s+begin|before\s+you\s+start|"
    r"requirements?|what\s+you\s+need|what\s+you'll\s+need|"
    r"before\s+starting|you'll\s+need|you\s+need\s+to\s+have|"
    r"you\s+need\s+a|you\s+must\s+have|must\s+have\s+a|"
    r"make\s+sure\s+you\s+have|make\s+sure\s+you've|"
    r"ensure\s+you\s+have|ensure\s+that\s+you|"
    r"set\s+up\s+your|sign\s+up\s+for|create\s+an?\s+account|"
    r"required|requires?\s+a|need\s+an?\s+account|"
    r"first,?\s+you\s+(need|must|should)|"
    r"to\s+follow\s+this|to\s+complete\s+this|"
    r"to\s+get\s+started|getting\s+started)\b"
)
R10_OUTPUT = (
    r"\b(response|output|returns?|result|expected\s+output|"
    r"example\s+response|sample\s+response|will\s+return)\b"
)
R11_BAD_LINK_TEXT = r"\b(click\s+here|see\s+here|learn\s+more|read\s+more|more\s+info)\b"
R12_PREFIX_CHARS = 200
R12_TYPES = [
    ("conceptual", r"\b(overview|concept|what\s+is|introduction|about)\b"),
    ("how-to", r"\b(how\s+to|guide|tutorial|step[\s-]+by[\s-]+step|walkthrough)\b"),
    ("reference", r"\b(reference|api\s+ref|endpoint|schema|specification)\b"),
]
R12_POINTS_PER_TYPE = 35
R13_VERSION = (
    r"\b(v\d+\.?\d*|version\s+\d|api\s+v\d|sdk\s+v\d|"
    r"deprecated|sunset|migration|breaking\s+change)\b"
)
R13_CAP = 90
R14_DECISION = (
    r"\b(when\s+to\s+use|vs\.?|versus|compared?\s+to|comparison|"
    r"trade[\s-]?offs?|which\s+should|differences?\s+between)\b"
)
R15_SAFETY = (
    r"\b(warning|caution|danger|irreversible|destructive|"
    r"cannot\s+be\s+undone|permanent|rate\s+limit|quota|"
    r"billing|side\s+effect|dry[\s-]?run)\b"
)
R16_ANTIPATTERN = (
    r"\b(seamlessly|world[\s-]?class|next[\s-]?generation|cutting[\s-]?edge|"
    r"unlock|leverage|synergy|revolutionary|best[\s-]?in[\s-]?class|"
    r"game[\s-]?changing|disruptive|supercharge|contact\s+support)\b"
)
R17_MIN_WORDS, R17_MAX_WORDS, R17_WORDS_PER_UNIT = 100, 5000, 500
R17_FULL_DENSITY, R17_HALF_DENSITY = 0.8, 0.5
R18_PREFIX_CHARS = 500
R18_INTENT = [
    "this guide", "this page", "in this", "learn how",
    "you can use", "allows you to", "enables you to",
    "to receive", "to send", "to create", "to configure",
    "purpose", "overview", "what you'll",
]
R19_STATE = (
    r"\b(state|lifecycle|status|transition|pending|active|"
    r"completed|failed|draft|published|archived|workflow)\b"
)
R19_ARROW = r"(→|->|=>)"
R20_CALLOUT = (
    r"(⚠️|❌|💡|ℹ️|warning|caution|note|tip|important|info|"
    r":::warning|:::note|:::tip|:::info|"
    r">\s*\*\*(warning|note|tip|important))"
)
# Every alternative of R20_CALLOUT contains one of these substrings and each
# substring is itself an alternative, so "pattern found (ignoring case)" is
# exactly "some substring occurs in the lower-cased text".
R20_CALLOUT_SUBSTRINGS = ["⚠️", "❌", "💡", "ℹ️", "warning", "caution", "note", "tip", "important", "info"]
R20_BONUS = 20

# ---------------------------------------------------------------------------
# FIXED VALUES — rule finding texts ({} are filled from aggregates)
# ---------------------------------------------------------------------------

FINDINGS = {
    1: "{passing}/{n} pages are self-contained (no vague cross-references)",
    2: "{action}/{total} headings are action-oriented",
    "2_none": "No headings found — documentation has no structure",
    3: "{tables}/{params} pages with parameters use structured tables",
    "3_none": "No parameter documentation detected",
    4: "{complete}/{code} pages have complete code examples (with imports or language tags)",
    "4_none": "No code examples found in any page",
    5: "{passing}/{n} pages use precise, explicit language",
    "6_fix": "Error documentation found with resolution steps",
    "6_err": "Error codes mentioned but no structured fix/resolution docs",
    "6_none": "No error documentation found — agents can't help users debug",
    "7_conflict": "{conflicts} terminology conflict(s) detected — 3+ synonyms used for the same concept",
    "7_ok": "Terminology is consistent across all pages",
    "7_none": "Limited terminology to evaluate",
    8: "{passing}/{n} pages have adequate metadata (title + description or frontmatter)",
    9: "{passing}/{checked} how-to/guide pages state prerequisites explicitly",
    10: "{passing}/{code} pages with code also show expected outputs",
    "10_none": "No code examples to check for expected outputs",
    11: "{passing}/{linked} pages use descriptive link text (no \"click here\")",
    "11_none": "No internal links found — pages may be isolated",
    12: "Content types detected: {types}",
    "12_none": "unclear",
    13: "{passing}/{n} pages include version information",
    "14_yes": "Decision/comparison documentation found",
    "14_no": "No decision documentation found (e.g., \"when to use X vs Y\")",
    15: "{passing} page(s) document safety boundaries (warnings, limits, irreversible actions)",
    "15_none": "No safety boundaries documented (rate limits, destructive actions, etc.)",
    16: "{passing}/{n} pages are free of marketing language and anti-patterns",
    17: "{passing}/{n} pages have good heading density for RAG chunking",
    18: "{passing}/{n} pages explain intent/purpose before diving into mechanics",
    "19_both": "State transitions and lifecycle documentation found",
    "19_states": "State/status concepts mentioned but no clear transition documentation",
    "19_none": "No state transition or lifecycle documentation found",
    20: "{passing}/{n} pages use callouts/admonitions (warnings, tips, notes)",
}

# Neutral / fixed scores used by rules when their denominator is empty.
R2_BOOST = 1.5
R3_NO_PARAMS = 70
R4_NO_CODE = 20
R6_SCORES = (85, 45, 15)
R7_NO_TERMS = 80
R10_NO_CODE = 50
R11_NO_LINKS = 60
R14_SCORES = (75, 30)
R15_SCORES = (80, 40)
R19_SCORES = (85, 55, 40)

TOP_ISSUES_K = 5
ALL_PASSING_ISSUE = ("optimization", "All rules passing — minor optimizations available for a perfect score",
                     "low", 0, "all_passing", 100)
NO_PAGES_ISSUE = ("crawling", "No pages could be analyzed", "high", 0, "no_pages", 0)

# ---------------------------------------------------------------------------
# Literal prefilter for the word-bounded rule patterns.
#
# Invariant: every match of the pattern (on lower-cased text) contains at
# least one of these whole-word tokens, where tokens are the maximal runs
# of word characters — the same characters that delimit ``\b``.  A page
# whose token set has none of them cannot match, so the regex is skipped.
# ``tests/test_prefilter.py`` checks the invariant on generated text.
# ---------------------------------------------------------------------------
PREFILTER = {
    "R1": ["above", "previous", "earlier", "previously"],
    "R3": ["parameter", "argument", "option", "field", "property", "attribute"],
    "R5": ["typically", "usually", "simply", "obviously", "want", "works", "expect", "just", "easy"],
    "R6_ERROR": ["error", "status", "message", "troubleshoot", "common", "handling", "exception"]
                + [str(n) for n in range(400, 600)],
    "R6_FIX": ["fix", "solution", "resolve", "workaround", "remedy", "recovery", "retry", "fallback"],
    "R9": ["prerequisite", "before", "requirement", "requirements", "need", "must", "sure", "ensure", "set", "sign",
           "account", "required", "require", "requires", "should", "follow", "complete", "started"],
    "R10": ["response", "output", "return", "returns", "result"],
    "R11": ["here", "more"],
    "R14": ["use", "vs", "versus", "compare", "compared", "comparison", "trade", "tradeoff", "tradeoffs", "which",
            "difference", "differences"],
    "R15": ["warning", "caution", "danger", "irreversible", "destructive", "undone", "permanent", "rate", "quota",
            "billing", "side", "dry", "dryrun"],
    "R16": ["seamlessly", "world", "worldclass", "next", "nextgeneration", "cutting", "cuttingedge", "unlock",
            "leverage", "synergy", "revolutionary", "best", "bestin", "bestinclass", "game", "gamechanging",
            "disruptive", "supercharge", "contact"],
    "R19": ["state", "lifecycle", "status", "transition", "pending", "active", "completed", "failed", "draft",
            "published", "archived", "workflow"],
    "R7": ["workspace", "organization", "org", "team", "project", "token", "api", "secret", "credential", "endpoint",
           "route", "path"],
}
