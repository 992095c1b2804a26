"""Operating guides and doc packages as nested JSON.

A guide arrives as raw text from a model (often inside a code fence).  It is
parsed once with ``from_json`` against an explicit schema — the old and the
new field names are both in the schema, and ``coalesce`` picks the new one
when present (the original's "key absent → old key" rule).  Every section is
then a ``posexplode`` / ``inline`` of one row: no grouping, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX
from ..session import replaced

_S = T.StringType()
_LS = T.ArrayType(T.StringType())


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


REF = _st(("label", _S), ("url", _S), ("topic", _S))
PLAYBOOK = _st(
    ("task_name", _S), ("goal", _S), ("risk_level", _S),
    ("ask_for", _LS), ("required_inputs", T.ArrayType(_st(("name", _S)))),
    ("check", _LS), ("pre_checks", _LS), ("do", _LS), ("steps", _LS),
    ("verify", _LS), ("verification_checks", _LS),
    ("confirm_before", _LS), ("confirmation_required_when", _LS),
    ("escalate_if", _LS), ("escalate_when", _LS),
    ("refs", T.ArrayType(REF)), ("source_refs", T.ArrayType(REF)))
# Lists whose items are strings or objects are read as strings (an object then arrives as its JSON text).
GUIDE_SCHEMA = _st(
    ("meta", _st(("product_name", _S), ("slug", _S), ("mode", _S), ("docs_root_url", _S))),
    ("hero", _st(("summary", _S), ("high_risk_notice", _S))),
    ("agent_scope", _st(("safe_without_approval", _LS), ("requires_confirmation", _LS), ("requires_escalation", _LS), ("never_do", _LS))),
    ("stop_conditions", _st(("stop_and_ask", _LS), ("stop_and_escalate", _LS))),
    ("task_playbooks", T.ArrayType(PLAYBOOK)),
    ("operating_rules", _st(("always", _LS), ("always_do", _LS), ("never", _LS), ("never_do", _LS), ("environment", _LS),
                            ("environment_rules", _LS), ("ambiguity_rules", _LS))),
    ("setup", _st(("prerequisites", _LS), ("auth_methods", _LS), ("required_secrets", _LS), ("env_notes", _LS),
                  ("authentication", _st(("methods", _LS), ("required_secrets_or_tokens", _LS), ("environment_notes", _LS))))),
    ("decision_guide", T.ArrayType(_st(("decision", _S), ("use_when", _LS), ("choose_when", _LS), ("avoid_when", _LS),
                                       ("escalate_if", _LS), ("escalate_when", _LS)))),
    ("troubleshooting", T.ArrayType(_st(("issue", _S), ("likely_cause", _S), ("likely_causes", _LS), ("fix", _S),
                                        ("recommended_actions", _LS), ("escalate_if", _S), ("escalate_when", _LS)))),
    ("references", T.ArrayType(_st(("label", _S), ("url", _S), ("topic", _S), ("references", T.ArrayType(REF))))),
    ("errors", _LS),
    ("_corrupt_record", _S),
)

DRAFT_FREE_PLAYBOOKS = 2  # FIXED VALUE - playbooks that a draft shows unlocked


def _first_items(items: Column, limit: int | None) -> Column:
    """The items, or the first ``limit`` where a page renderer asks for a bound."""
    return items if limit is None else F.slice(items, 1, limit)


def _item_text(item: Column) -> Column:
    """Text of a list item: a string as it is, an object's action (its JSON text without one)."""
    return F.when(item.startswith("{"), F.coalesce(F.get_json_object(item, "$.action"), item)).otherwise(item)


def parse_guides(raw: DataFrame, text_col: str = "raw") -> DataFrame:
    """Strip a code fence and parse; unparseable text → ``ok = false`` with an error row.

    ``from_json`` in PERMISSIVE mode keeps malformed input in the corrupt-record
    field (a truncated document can otherwise yield a partial struct), so a bad
    document never fails the job and is never half-accepted.
    """
    cleaned = TX.strip_json_fences(F.col(text_col))
    parsed = F.from_json(cleaned, GUIDE_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    out = raw.withColumn("guide", parsed)
    ok = F.col("guide").isNotNull() & F.col("guide._corrupt_record").isNull()
    out = out.withColumn("ok", ok).withColumn("guide", F.when(ok, F.col("guide")))
    return out.withColumn("error", F.when(~F.col("ok"), F.lit("Could not parse the guide JSON")))


def _empty_if_null(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def guide_playbooks(parsed: DataFrame, keys=("guide_id",), list_limit: int | None = None, step_limit: int | None = None) -> DataFrame:
    """One row per playbook; new field names win, old ones fill in when absent;
    playbooks after the second are locked in drafts.  Limits bound lists and steps for display."""
    g = parsed  # bad guides are NULL already; filtering on "ok" here would be pushed below the JSON parse
    ex = g.select(*keys, F.col("guide.meta.mode").alias("mode"),
                  F.posexplode_outer(F.col("guide.task_playbooks")).alias("idx", "pb")).where("idx IS NOT NULL")
    pb = F.col("pb")
    ask = F.when(F.size(_empty_if_null(pb["ask_for"])) > 0, pb["ask_for"]) \
        .otherwise(F.transform(F.coalesce(pb["required_inputs"], F.array().cast(T.ArrayType(_st(("name", _S))))),
                               lambda i: F.coalesce(i["name"], F.lit(""))))
    pick = lambda new, old: _empty_if_null(F.coalesce(pb[new], pb[old]))
    refs = F.coalesce(pb["refs"], pb["source_refs"], F.array().cast(T.ArrayType(REF)))
    return ex.select(
        *keys, "idx", F.coalesce(pb["task_name"], F.lit("")).alias("task_name"),
        F.coalesce(pb["goal"], F.lit("")).alias("goal"), TX.risk_label(F.coalesce(pb["risk_level"], F.lit(""))).alias("risk"),
        _first_items(ask, list_limit).alias("ask_for"), _first_items(pick("check", "pre_checks"), list_limit).alias("check"),
        _first_items(pick("do", "steps"), step_limit).alias("do"),
        _first_items(pick("verify", "verification_checks"), list_limit).alias("verify"),
        _first_items(pick("confirm_before", "confirmation_required_when"), list_limit).alias("confirm_before"),
        _first_items(pick("escalate_if", "escalate_when"), list_limit).alias("escalate_if"),
        F.transform(refs, lambda r: F.struct(F.coalesce(r["label"], F.lit("")).alias("label"),
                                             F.coalesce(r["url"], F.lit("#")).alias("url"))).alias("refs"),
        ((F.col("mode") == "draft") & (F.col("idx") >= DRAFT_FREE_PLAYBOOKS)).alias("locked"))


def stop_conditions(parsed: DataFrame, keys=("guide_id",), limit: int | None = None) -> DataFrame:
    """Stop-and-ask / stop-and-escalate lists with the old-schema fallbacks."""
    pbs = F.coalesce(F.col("guide.task_playbooks"), F.array().cast(T.ArrayType(PLAYBOOK)))
    ask = _empty_if_null(F.col("guide.stop_conditions.stop_and_ask"))
    esc = _empty_if_null(F.col("guide.stop_conditions.stop_and_escalate"))
    amb = _empty_if_null(F.col("guide.operating_rules.ambiguity_rules"))
    pb_confirm = F.flatten(F.transform(pbs, lambda p: _empty_if_null(F.coalesce(p["confirmation_required_when"],
                                                                                 p["confirm_before"]))))
    pb_escalate = F.flatten(F.transform(pbs, lambda p: _empty_if_null(F.coalesce(p["escalate_when"], p["escalate_if"]))))
    ask_fb = F.concat(amb, F.array_except(pb_confirm, amb))
    ask_all = F.when(F.size(ask) > 0, ask).otherwise(ask_fb)
    esc_all = F.when(F.size(esc) > 0, esc).otherwise(F.array_distinct(pb_escalate))
    return parsed.select(*keys, "ok", _first_items(ask_all, limit).alias("stop_and_ask"),
                         _first_items(esc_all, limit).alias("stop_and_escalate"))


def _listed(parsed: DataFrame, keys, lists, name: str, item: str) -> DataFrame:
    """Named lists of each guide as (name, pos, item) rows."""
    tagged = F.array(*[F.struct(F.lit(n).alias("name"), _empty_if_null(c).alias("items")) for n, c in lists])
    ex = parsed.select(*keys, F.explode_outer(tagged).alias("l"))
    return ex.select(*keys, F.col("l.name").alias(name), F.posexplode_outer(F.col("l.items")).alias("pos", item)).where("pos IS NOT NULL")


def guide_scope(parsed: DataFrame, keys=("guide_id",), limit: int | None = None) -> DataFrame:
    """The four scope lists as (list, pos, action) rows; items are strings or objects with an action."""
    scope = lambda name: F.col(f"guide.agent_scope.{name}")
    never = F.coalesce(scope("never_do"), F.col("guide.operating_rules.never_do"), F.col("guide.operating_rules.never"))
    lists = [("safe", scope("safe_without_approval")), ("confirm", scope("requires_confirmation")),
             ("escalate", scope("requires_escalation")), ("never", never)]
    texts = [(n, F.transform(_first_items(_empty_if_null(c), limit), _item_text)) for n, c in lists]
    return _listed(parsed, keys, texts, "list", "action")


def guide_rules_setup(parsed: DataFrame, keys=("guide_id",)) -> DataFrame:
    """Operating rules and setup fields as (section, pos, item) rows, under new or old names."""
    rule = lambda new, old: F.coalesce(F.col(f"guide.operating_rules.{new}"), F.col(f"guide.operating_rules.{old}"))
    setup = lambda new, old: F.coalesce(F.col(f"guide.setup.{new}"), F.col(f"guide.setup.authentication.{old}"))
    return _listed(parsed, keys, [
        ("always", rule("always", "always_do")), ("never", rule("never", "never_do")),
        ("environment", rule("environment", "environment_rules")), ("prerequisites", F.col("guide.setup.prerequisites")),
        ("auth_methods", setup("auth_methods", "methods")), ("required_secrets", setup("required_secrets", "required_secrets_or_tokens")),
        ("env_notes", setup("env_notes", "environment_notes"))], "section", "item")


def guide_troubleshooting(parsed: DataFrame, keys=("guide_id",)) -> DataFrame:
    """Every troubleshooting entry; an empty field takes the first item of its old-form list."""
    ts = parsed.select(*keys, F.posexplode_outer(F.col("guide.troubleshooting")).alias("pos", "t")).where("pos IS NOT NULL")
    field = lambda one, many: F.coalesce(F.nullif(F.col(f"t.{one}"), F.lit("")), F.get(F.col(f"t.{many}"), F.lit(0)), F.lit(""))
    return ts.select(*keys, "pos", F.coalesce(F.col("t.issue"), F.lit("")).alias("issue"), field("likely_cause", "likely_causes").alias("likely_cause"),
                     field("fix", "recommended_actions").alias("fix"), field("escalate_if", "escalate_when").alias("escalate_if"))


def guide_decisions(parsed: DataFrame, keys=("guide_id",), limit: int | None = None) -> DataFrame:
    """Decision cards with their use / avoid / escalate lists, under new or old names."""
    dg = parsed.select(*keys, F.posexplode_outer(F.col("guide.decision_guide")).alias("pos", "d")).where("pos IS NOT NULL")
    cut = lambda *names: _first_items(_empty_if_null(F.coalesce(*(F.col(f"d.{n}") for n in names))), limit)
    return dg.select(*keys, "pos", F.coalesce(F.col("d.decision"), F.lit("")).alias("decision"),
                     cut("use_when", "choose_when").alias("use_when"), cut("avoid_when").alias("avoid_when"),
                     cut("escalate_if", "escalate_when").alias("escalate_if"))


def guide_references(parsed: DataFrame, keys=("guide_id",)) -> DataFrame:
    """References with their topic ('' without one); a list that starts with a group is a list of groups."""
    refs = F.col("guide.references")
    flat = F.transform(refs, lambda r: F.struct(r["topic"].alias("topic"), r["label"].alias("label"), r["url"].alias("url")))
    groups = F.flatten(F.transform(refs, lambda g: F.transform(
        F.coalesce(g["references"], F.array().cast(T.ArrayType(REF))), lambda r: F.struct(g["topic"].alias("topic"), r["label"].alias("label"), r["url"].alias("url")))))
    every = F.when(F.get(refs, F.lit(0))["references"].isNotNull(), groups).otherwise(flat)
    ex = parsed.select(*keys, F.posexplode_outer(every).alias("pos", "r")).where("pos IS NOT NULL")
    return ex.select(*keys, "pos", F.coalesce(F.col("r.topic"), F.lit("")).alias("topic"),
                     F.coalesce(F.col("r.label"), F.lit("")).alias("label"), F.coalesce(F.col("r.url"), F.lit("#")).alias("url"))


def package_errors(parsed: DataFrame, keys=("guide_id",)) -> DataFrame:
    """Error entries (objects only) with new or old names for the error and its cause."""
    ex = parsed.select(*keys, F.posexplode_outer(F.filter("guide.errors", lambda e: e.startswith("{"))).alias("pos", "e")).where("pos IS NOT NULL")
    field = lambda *names: F.coalesce(*(F.get_json_object("e", f"$.{n}") for n in names), F.lit(""))
    return ex.select(*keys, "pos", field("error_code_or_message", "error").alias("error"), field("likely_cause", "cause").alias("likely_cause"),
                     field("fix").alias("fix"), field("escalate_if").alias("escalate_if"))


def source_pages(pages: DataFrame, key: str = "site", k: int | None = None) -> DataFrame:
    """(url, title or 'Untitled') per job in crawl order, as rows (optionally first k)."""
    out = pages.select(key, "ord", "url", F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("Untitled")).alias("title"))
    if k is not None:
        from .scoring import first_k
        out = first_k(out, key, k)
    return out


def package_page_map(packages: DataFrame, preview_only: bool = False) -> DataFrame:
    """Explode the page map; preview runs keep preview-tier pages; full pages of
    unpaid packages are locked."""
    ex = packages.select("slug", "payment_status", F.posexplode_outer("page_map").alias("pos", "p")) \
        .where("pos IS NOT NULL")
    ex = ex.select("slug", "pos", F.col("p.page_type").alias("page_type"), F.col("p.title").alias("title"),
                   F.col("p.slug").alias("page_slug"), F.col("p.tier").alias("tier"), "payment_status")
    if preview_only:
        ex = ex.where(F.col("tier") == "preview")
    return ex.withColumn("locked", (F.col("tier") == "full") & (F.col("payment_status") != "paid"))


def faq_by_category(questions: DataFrame) -> DataFrame:
    """Category (default 'general', title-cased) in first-seen order, questions and answers in order."""
    q = questions.withColumn("category", TX.title_case(F.coalesce(F.col("category"), F.lit("general"))))
    first = q.groupBy("package", "category").agg(F.min("ord").alias("cat_ord"))
    return q.join(first, ["package", "category"]).select("package", "category", "cat_ord", "ord", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer"))


def write_package_bundle(packages: DataFrame, out_dir: str) -> None:
    """Per package, the pages a buyer is entitled to (full pages when paid
    and ready, else preview pages) as JSON rows, the page map, and llms.txt lines.

    The three outputs take the place of an earlier bundle together.  Files are range-partitioned and sorted by slug (not a folder for each), so
    their number follows the data; no package is gathered into one row.
    """
    paid_full = (F.col("payment_status") == "paid") & F.col("full_pages").isNotNull()
    pages = packages.select("slug", F.explode_outer(F.when(paid_full, F.col("full_pages"))
                                                    .otherwise(F.col("preview_pages"))).alias("page_slug", "p")) \
        .where("page_slug IS NOT NULL")
    by_slug = lambda df: df.repartitionByRange("slug").sortWithinPartitions("slug")
    lines = pages.select("slug", "page_slug",
                         F.concat(F.lit("- ["), F.coalesce(F.col("p.title"), F.col("page_slug")), F.lit("]("),
                                  F.col("page_slug"), F.lit(".json)")).alias("line"))
    with replaced(packages.sparkSession, out_dir) as draft:
        by_slug(pages.select("slug", "page_slug", F.col("p.*"))).write.json(f"{draft}/pages")
        by_slug(package_page_map(packages)).write.json(f"{draft}/page_map")
        lines = lines.repartitionByRange("slug", "page_slug").sortWithinPartitions("slug", "page_slug")
        lines.select("slug", "line").write.json(f"{draft}/llms")
