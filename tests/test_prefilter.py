"""The literal prefilter never hides a match: every match of a rule pattern
contains one of the rule's anchor tokens (constants.PREFILTER)."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sitelens import constants as K

PATTERNS = {
    "R1": K.R1_VAGUE_REFS, "R3": K.R3_PARAM, "R5": K.R5_VAGUE, "R6_ERROR": K.R6_ERROR, "R6_FIX": K.R6_FIX,
    "R9": K.R9_PREREQ, "R10": K.R10_OUTPUT, "R11": K.R11_BAD_LINK_TEXT, "R14": K.R14_DECISION,
    "R15": K.R15_SAFETY, "R16": K.R16_ANTIPATTERN, "R19": K.R19_STATE,
    "R7": r"\b(workspace|organization|org|team|project|token|api key|secret|credential|endpoint|route|path)\b",
}
VOCAB = sorted({w for p in PATTERNS.values() for w in re.findall(r"[a-z']+", p)} | {"a", "an", "the", "x", "é"})
SEPS = [" ", "  ", "-", "\n", ", ", ". ", "'", "_", "é", "3", ""]


def tokens(text):
    return set(re.split(r"\W+", text))


def check(key, text):
    text = text.lower()
    for m in re.finditer(PATTERNS[key], text):
        # the token set of the whole text must meet the anchors; check the match's own tokens
        span_tokens = tokens(text[max(0, m.start() - 1):m.end() + 1]) & tokens(text)
        assert span_tokens & set(K.PREFILTER[key]), (key, m.group(0))


@settings(max_examples=300, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.tuples(st.sampled_from(VOCAB), st.sampled_from(SEPS)), min_size=1, max_size=30))
def test_vocabulary_soup(parts):
    text = "".join(w + s for w, s in parts)
    for key in PATTERNS:
        check(key, text)


def test_each_alternative():
    # every alternative written out with single spaces and with other separators
    samples = ["see above", "as mentioned earlier", "refer to the above", "the previous step", "you may want to",
               "it works like", "as you might expect", "you just need to", "it's easy to", "error code", "status code",
               "common errors", "error handling", "error message", "404", "599", "how to fix", "before you begin",
               "what you'll need", "you'll need", "make sure you've", "first, you should", "first you must",
               "create an account", "need a account", "requires a", "to get started", "getting started",
               "expected output", "will return", "click here", "more info", "when to use", "vs.", "trade-offs",
               "tradeoff", "differences between", "which should", "cannot be undone", "rate limit", "side effect",
               "dry-run", "dryrun", "world-class", "worldclass", "best-in-class", "bestin class", "bestinclass",
               "next generation", "cutting-edge", "game changing", "contact support", "api key", "lifecycle",
               "v2", "v10.3", "version 4", "api v1", "sdk v3", "breaking change", "deprecated"]
    for s in samples:
        for key in PATTERNS:
            for text in (s, f"x {s} y", s.replace(" ", "\n")):
                check(key, text)


def test_digits_and_letters_beyond_ascii_match_as_in_python(spark):
    from pyspark.sql import functions as F

    from sitelens.functions import text as T

    rules = {"R13": K.R13_VERSION, "R19": K.R19_STATE, "R15": K.R15_SAFETY, "R1": K.R1_VAGUE_REFS}
    words = ["release v\u0662", "v2", "version \u0967", "VERSION 3", "\u017ftate", "\u017fTATU\u017f", "wor\u212Aflow", "M\u0130GRATION", "m\u0131gration", "i\u0307 v\u0307", "see above",
             "\u017fee above", "dry-run", "s\u0131de effect", "plain", "\u00e9tat", "ſ", "v\u0b66.1"]
    texts = words + [f"{a} {b}" for a in words for b in words]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", *[T.search_lc(T.fold("t"), p).alias(k) for k, p in rules.items()]).collect()
    for r in got:
        for k, p in rules.items():
            assert r[k] == bool(re.search(p, r["t"], re.IGNORECASE)), (k, r["t"])
