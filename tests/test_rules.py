"""Rule engine edge cases on hand-written page frames."""

from helpers import page, pages_df, rules_by_id

from sitelens.operators import rollups, rules


def run(spark, rows):
    return rules_by_id(rules.rule_results(pages_df(spark, rows)))


def test_half_even_rounding_one_of_eight(spark):
    rows = [page(ord=i, content="see above" if i else "plain text") for i in range(8)]
    r = run(spark, rows)[1]
    assert r["pages_passing"] == 1 and r["score"] == 12   # 12.5 → 12 (banker's rounding)
    assert r["status"] == "fail"
    assert r["finding"] == "1/8 pages are self-contained (no vague cross-references)"


def test_zero_denominators(spark):
    r = run(spark, [page(ord=0, content="nothing here")])
    assert r[2]["score"] == 0 and r[2]["finding"].startswith("No headings found")
    assert r[3]["score"] == 70 and r[3]["pages_checked"] == 0
    assert r[4]["score"] == 20 and r[4]["pages_checked"] == 0
    assert r[10]["score"] == 50 and r[10]["pages_checked"] == 0
    assert r[11]["score"] == 60
    assert r[7]["score"] == 80 and r[7]["finding"] == "Limited terminology to evaluate"


def test_null_content_is_empty(spark):
    r = run(spark, [page(ord=0, content=None)])
    assert r[1]["score"] == 100 and r[5]["score"] == 100 and r[16]["score"] == 100


def test_action_headings_boost_and_cap(spark):
    r = run(spark, [page(ord=0, headings=["Install the SDK", "Overview", "Concepts"])])[2]
    assert r["score"] == 50 and r["pages_passing"] == 1     # round(1/3*100*1.5) = 50
    r = run(spark, [page(ord=0, headings=["Install it", "Deploy it", "Notes"])])[2]
    assert r["score"] == 100                                  # min(100, 100)


def test_param_tables_markdown_or_html(spark):
    rows = [page(ord=0, content="the parameter x | a | b |"), page(ord=1, content="one option", has_tables=True),
            page(ord=2, content="a field in prose")]
    r = run(spark, rows)[3]
    assert (r["pages_checked"], r["pages_passing"], r["score"]) == (3, 2, 67)


def test_complete_code_imports_case_sensitive_or_language(spark):
    rows = [page(ord=0, code=["Import x"]), page(ord=1, code=["import x"]), page(ord=2, code=[("python", "x=1")]),
            page(ord=3, code=[("text", "x=1")]), page(ord=4, code=[("", "x=1")])]
    r = run(spark, rows)[4]
    assert (r["pages_checked"], r["pages_passing"]) == (5, 2)


def test_explicit_language_counts_matches(spark):
    rows = [page(ord=0, content="simply usually"), page(ord=1, content="simply usually typically")]
    r = run(spark, rows)[5]
    assert r["pages_passing"] == 1 and r["score"] == 50


def test_error_docs_levels(spark):
    assert run(spark, [page(content="error code 404 here")])[6]["score"] == 45
    assert run(spark, [page(content="error code 404, workaround: retry")])[6]["score"] == 85
    assert run(spark, [page(content="fine")])[6]["score"] == 15


def test_terminology_conflict_needs_three_synonyms(spark):
    two = run(spark, [page(ord=0, content="token and secret"), page(ord=1, content="endpoint")])[7]
    assert two["score"] == 100 and two["finding"] == "Terminology is consistent across all pages"
    three = run(spark, [page(ord=0, content="token"), page(ord=1, content="secret"), page(ord=2, content="api key")])[7]
    assert three["score"] == 0 and three["pages_passing"] == 2     # n - conflicts
    one = run(spark, [page(content="token secret credential team org route")])[7]
    assert one["score"] == 67 and one["finding"].startswith("1 terminology conflict")
    two_conflicts = run(spark, [page(content="token secret credential team org project route")])[7]
    assert two_conflicts["score"] == 33 and two_conflicts["finding"].startswith("2 terminology conflict")


def test_prerequisites_fallback_denominator(spark):
    rows = [page(ord=0, title="Topic", content="required"), page(ord=1, title="Topic", content="x")]
    r = run(spark, rows)[9]
    assert (r["pages_checked"], r["pages_passing"], r["score"]) == (2, 1, 50)
    rows = [page(ord=0, title="How to start", content="x"), page(ord=1, title="Topic", content="required")]
    r = run(spark, rows)[9]
    assert (r["pages_checked"], r["pages_passing"], r["score"]) == (1, 0, 0)


def test_content_types_sorted_and_capped(spark):
    rows = [page(ord=0, title="API reference"), page(ord=1, title="Overview"), page(ord=2, title="How to x")]
    r = run(spark, rows)[12]
    assert r["score"] == 100 and r["finding"] == "Content types detected: conceptual, how-to, reference"


def test_version_cap_and_callout_bonus(spark):
    r = run(spark, [page(content="version 2")])
    assert r[13]["score"] == 90
    assert r[20]["score"] == 20
    assert run(spark, [page(content="multiple")])[20]["score"] == 100   # 'tip' inside 'multiple'


def test_chunking_density(spark):
    words = lambda n: " ".join(["w"] * n)
    rows = [page(ord=0, content=words(99), headings=["a"]),              # too short → 0
            page(ord=1, content=words(500), headings=["a"]),              # density 1 → 1
            page(ord=2, content=words(1000), headings=["a"]),             # density .5 → .5
            page(ord=3, content=words(5001), headings=["h"] * 10)]        # >5000 words, density ~1 → .5
    r = run(spark, rows)[17]
    assert r["pages_passing"] == 2 and r["score"] == 50


def test_states_and_arrows_on_different_pages(spark):
    r = run(spark, [page(ord=0, content="status pending"), page(ord=1, content="a -> b")])[19]
    assert r["score"] == 85


def test_site_scores_and_issues(spark):
    rows = [page(site="a", ord=i, content="see above simply usually typically") for i in range(3)]
    df = pages_df(spark, rows)
    s = rollups.site_scores(df).collect()[0]
    assert 0 <= s["overall_score"] <= 100 and s["grade"] in {"A+", "A", "A-", "B+", "B", "B-", "C+", "C", "C-", "D", "F"}
    issues = rollups.top_issues(df).orderBy("rank").collect()
    assert len(issues) == 5 and [i["rank"] for i in issues] == [1, 2, 3, 4, 5]
    scores = [(i["score"], i["rule_id"]) for i in issues]
    assert scores == sorted(scores)


def test_partitioning_does_not_change_scores(spark):
    rows = [page(site=f"s{i % 3}", ord=i, content=("see above " if i % 2 else "") + "error code 500 retry",
                 headings=["Install"] if i % 4 else []) for i in range(40)]
    df = pages_df(spark, rows)
    a = sorted(map(tuple, rules.rule_results(df.repartition(1)).collect()))
    b = sorted(map(tuple, rules.rule_results(df.repartition(7)).collect()))
    assert a == b


def test_empty_site_row(spark):
    df = pages_df(spark, [page(site="a")])
    sites = spark.createDataFrame([("a",), ("b",)], "site string")
    s = {r["site"]: r for r in rollups.site_scores(df, sites).collect()}
    assert s["b"]["overall_score"] == 0 and s["b"]["grade"] == "F"
    t = rollups.top_issues(df, sites).where("site = 'b'").collect()
    assert t[0]["rule_name"] == "no_pages"
