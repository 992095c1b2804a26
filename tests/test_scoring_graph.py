"""Query scorer (the original's scorer assertions), BFS vs brute force, guides, streaming."""

import collections
import os
import tempfile

from pyspark.sql import functions as F

from helpers import page, pages_df
from sitelens.operators import guides as G
from sitelens.operators import linkgraph, scoring

QR = "analysis_id long, passed boolean, confidence double, accuracy_score double, retrieval_precision double, " \
     "latency_ms int, citation_accuracy double, code_valid boolean"


def score(spark, rows, keys=None):
    df = spark.createDataFrame(rows, QR)
    k = spark.createDataFrame([(x,) for x in keys], "analysis_id long") if keys else None
    return {r["analysis_id"]: r for r in scoring.score_queries(df, "analysis_id", k).collect()}


def test_empty_analysis_is_zero_f(spark):
    s = score(spark, [(1, True, .9, .85, .8, 500, .9, True)], keys=[1, 2])
    assert s[2]["overall"] == 0 and s[2]["grade"] == "F" and s[2]["query_count"] == 0


def test_empty_analyses_come_without_a_join_and_null_keys_stay_apart(spark):
    df = spark.createDataFrame([(1, True, .9, .85, .8, 500, .9, True), (None, False, .9, .85, .8, 500, .9, None),
                                (4, True, .9, None, None, None, None, None)], QR)
    keys = spark.createDataFrame([(x,) for x in (1, 2, 2, None, None)], "analysis_id long")
    out = scoring.score_queries(df, "analysis_id", keys)
    rows = sorted((r["analysis_id"] or 0, r["query_count"], r["overall"], r["accuracy"], r["latency"], r["pass_rate"], r["avg_latency_ms"]) for r in out.collect() if r["analysis_id"] != 4)
    first = scoring.score_queries(df, "analysis_id").where("analysis_id = 1").collect()[0]
    assert rows == [(0, 0, 0, 0, 0, 0.0, 0), (0, 1, first["overall"], 85, 100, 0.0, 500), (1, 1, first["overall"], 85, 100, 1.0, 500), (2, 0, 0, 0, 0, 0.0, 0)]
    four = [r for r in out.collect() if r["analysis_id"] == 4]
    assert len(four) == 1 and four[0]["query_count"] == 1 and four[0]["overall"] is None and four[0]["avg_latency_ms"] is None
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()  # results are read once, nothing is sorted


def test_perfect_and_low_accuracy(spark):
    perfect = score(spark, [(1, True, 1.0, 1.0, 1.0, 500, 1.0, True)] * 10)[1]
    assert perfect["overall"] >= 95 and perfect["grade"] in ("A", "A+") and perfect["pass_rate"] == 1.0
    low = score(spark, [(1, True, .3, .3, 1.0, 500, 1.0, True)] * 10)[1]
    assert low["overall"] < 80


def test_latency_buckets_and_code_all_null(spark):
    fast = score(spark, [(1, True, .9, .9, .9, 500, .9, None)] * 5)[1]
    slow = score(spark, [(1, True, .9, .9, .9, 6000, .9, None)] * 5)[1]
    assert fast["overall"] > slow["overall"]
    assert fast["code_executability"] == 100            # all code_valid null → 1.0
    edge = score(spark, [(1, True, .9, .9, .9, 1000, .9, True)])[1]
    assert edge["latency"] == 80                         # mean 1000 is not < 1000


def test_pass_rate_two_of_three(spark):
    s = score(spark, [(1, True, .9, .9, .9, 500, .9, True), (1, True, .9, .9, .9, 500, .9, True),
                      (1, False, .9, .9, .9, 500, .9, True)])[1]
    assert abs(s["pass_rate"] - 2 / 3) < 1e-6


def brute_bfs(pages):
    """Plain FIFO crawl per site over (url → ordered links)."""
    by_url = {p[2].rstrip("/"): p for p in pages}
    out = collections.defaultdict(list)
    starts = {}
    for p in sorted(pages, key=lambda p: p[1]):
        starts.setdefault(p[0], p[2].rstrip("/"))
    for site, start in starts.items():
        queue, seen = [start], set()
        while queue:
            u = queue.pop(0)
            if u in seen:
                continue
            seen.add(u)
            p = by_url.get(u)
            if p is None:
                continue
            if len((p[5] or "").strip()) > 50:
                out[site].append(u)
            for link in p[8]:
                n = link.rstrip("/")
                if n not in seen and n.startswith(start.rsplit("/", 0)[0]):
                    queue.append(n)
    return out


def test_reachable_matches_fifo_crawl(spark):
    base = "https://s.example.com/docs"
    body = "x" * 60
    graph = {"": ["a", "b"], "a": ["c", "b"], "b": ["d", "a"], "c": ["e"], "d": ["c"], "e": [], "f": ["a"]}
    rows = [page(site="s", ord=i, url=f"{base}/{k}".rstrip("/"), content=body if k != "b" else "short",
                 links=[f"{base}/{t}" for t in v]) for i, (k, v) in enumerate(graph.items())]
    df = pages_df(spark, rows)
    got = linkgraph.crawl_rank(linkgraph.reachable(df)).orderBy("rank").collect()
    expected = brute_bfs(rows)["s"]
    assert [r["url"] for r in got] == expected
    assert f"{base}/f" not in expected and f"{base}/b" not in expected


def test_guides_old_names_and_stop_fallback(spark):
    raw = ('```json\n{"meta": {"mode": "draft", "slug": "p"}, "stop_conditions": {"stop_and_ask": []},'
           '"operating_rules": {"ambiguity_rules": ["amb"]},'
           '"task_playbooks": [{"task_name": "t0", "steps": ["s1","s2","s3","s4","s5","s6"], "confirmation_required_when": ["c1", "amb"]},'
           '{"task_name": "t1", "do": ["d"], "steps": ["ignored"], "required_inputs": [{"name": "key"}], "confirm_before": ["c1", "c2"]},'
           '{"task_name": "t2"}]}\n```')
    df = spark.createDataFrame([(1, raw), (2, '{"meta": {"slug": "x"}, "task_playbooks": [')], "guide_id long, raw string")
    parsed = G.parse_guides(df)
    ok = {r["guide_id"]: r["ok"] for r in parsed.collect()}
    assert ok == {1: True, 2: False}
    pb = {r["idx"]: r for r in G.guide_playbooks(parsed).collect()}
    assert pb[0]["do"] == ["s1", "s2", "s3", "s4", "s5", "s6"] and pb[1]["do"] == ["d"] and pb[1]["ask_for"] == ["key"]
    assert [pb[i]["locked"] for i in range(3)] == [False, False, True]
    stop = G.stop_conditions(parsed).where("ok").collect()[0]
    assert stop["stop_and_ask"] == ["amb", "c1", "c2"]


def test_incremental_scores_match_batch(spark):
    from sitelens.operators import rollups
    from sitelens.streaming import incremental as INC
    root = tempfile.mkdtemp(prefix="sitelens-stream-test-")
    src, state = os.path.join(root, "src"), os.path.join(root, "state")
    v1 = [page(site=f"s{i % 2}", ord=i, content="see above") for i in range(6)]
    v2 = [page(site="s0", ord=0, content="plain")]
    df1 = pages_df(spark, v1).withColumn("fetched_at", F.timestamp_seconds(F.lit(1)))
    df2 = pages_df(spark, v2).withColumn("fetched_at", F.timestamp_seconds(F.lit(2)))
    df1.write.parquet(src, mode="append")
    INC.start(spark, src, state).awaitTermination()
    df2.write.parquet(src, mode="append")
    INC.start(spark, src, state).awaitTermination()
    got = {r["site"]: r["overall_score"] for r in INC.read_scores(spark, state).collect()}
    latest = pages_df(spark, [v2[0]] + v1[1:])
    want = {r["site"]: r["overall_score"] for r in rollups.site_scores(latest).collect()}
    assert got == want
    # a batch that is replayed changes nothing, nor does an older version of a page
    INC.process_batch(df2, 1, state)
    INC.process_batch(df1.limit(3), 2, state)
    assert {r["site"]: r["overall_score"] for r in INC.read_scores(spark, state).collect()} == want


def test_score_trend_hot_site_spans_partitions(spark):
    from sitelens.operators import history
    rows = [("hot", i, i, (i * 7) % 5) for i in range(200)] + [("cold", i, 1000 + i, (i * 3) % 4) for i in range(5)]
    df = spark.createDataFrame(rows, "site string, date long, event_id long, score int")
    got = {(r["site"], r["event_id"]): r["change"] for r in history.score_trend(df).collect()}
    want = {}
    for site in ("hot", "cold"):
        prev = None
        for _s, _d, e, sc in sorted((r for r in rows if r[0] == site), key=lambda r: (r[1], r[2])):
            want[(site, e)] = 0 if prev in (None, 0) else sc - prev
            prev = sc
    assert got == want


def test_ranked_and_previous_on_hot_keys(spark):
    from sitelens.operators.ranking import ranked, with_previous
    rows = [("hot" if i % 3 else None, i * 7 % 101, i) for i in range(150)] + [("a", 1, 900), ("z", 2, 901)]
    df = spark.createDataFrame(rows, "site string, score int, id long")
    for parts, aqe in ((1, "true"), (5, "true"), (7, "false")):
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        place = {r["id"]: r["position"] for r in ranked(df, "site", [F.col("id").desc()]).collect()}
        before = {r["id"]: r["p"] for r in with_previous(df, "site", [F.col("id")], "score", "p").collect()}
        for site in ("hot", None, "a", "z"):
            own = sorted((r for r in rows if r[0] == site), key=lambda r: r[2])
            assert [place[r[2]] for r in own] == list(range(len(own), 0, -1))
            assert [before[r[2]] for r in own] == [None] + [r[1] for r in own[:-1]]
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_chain_of_sixty_pages_is_reached(spark):
    urls = ["https://x.com/d"] + [f"https://x.com/d/p{i}" for i in range(1, 61)]
    pages = [("x.com", i, urls[i], "content " * 20, [("next", urls[i + 1]), ("first", urls[0])]) for i in range(60)]
    df = spark.createDataFrame(pages, "site string, ord long, url string, content string, link_refs array<struct<text:string,href:string>>")
    got = {r["url"]: r["depth"] for r in linkgraph.reachable(df).collect()}
    assert got == {urls[i]: i for i in range(60)}


def test_guide_variants(spark):
    import json
    new = {"agent_scope": {"safe_without_approval": [{"action": "a"}, "b", {"other": 1}], "never_do": [{"action": "n"}, "m"]},
           "operating_rules": {"always": ["x"], "never": ["y"], "environment": ["z"]},
           "setup": {"prerequisites": ["p"], "auth_methods": ["key"], "required_secrets": ["s"], "env_notes": ["e"]},
           "decision_guide": [{"decision": "d", "use_when": ["u"], "escalate_if": ["v"]}],
           "troubleshooting": [{"issue": f"i{k}", "likely_cause": "c", "fix": "f", "escalate_if": "g"} for k in range(10)],
           "references": [{"label": "l", "url": "u", "topic": "t"}, {"label": "k"}], "errors": [{"error_code_or_message": "E", "likely_cause": "c", "fix": "f"}, "text"]}
    old = {"agent_scope": {"requires_confirmation": ["only text"]}, "operating_rules": {"always_do": ["x"], "never_do": ["y"], "environment_rules": ["z"]},
           "setup": {"authentication": {"methods": ["key"], "required_secrets_or_tokens": ["s"], "environment_notes": ["e"]}},
           "decision_guide": [{"decision": "d", "choose_when": ["u"], "escalate_when": ["v"]}],
           "troubleshooting": [{"issue": "i0", "likely_causes": ["c", "c2"], "recommended_actions": ["f"], "escalate_when": ["g"]}, {"issue": "i1", "likely_causes": []}],
           "references": [{"topic": "t", "references": [{"label": "l", "url": "u"}, {"label": "k"}]}, {"topic": "w", "references": [{"label": "m"}]}],
           "errors": [{"error": "E", "cause": "c"}]}
    df = G.parse_guides(spark.createDataFrame([(1, json.dumps(new)), (2, json.dumps(old))], "guide_id long, raw string"))
    assert df.where("ok").count() == 2
    scope = {(r["guide_id"], r["list"], r["pos"]): r["action"] for r in G.guide_scope(df).collect()}
    assert scope == {(1, "safe", 0): "a", (1, "safe", 1): "b", (1, "safe", 2): '{"other":1}', (1, "never", 0): "n", (1, "never", 1): "m",
                     (2, "confirm", 0): "only text", (2, "never", 0): "y"}
    items = {(r["guide_id"], r["section"]): r["item"] for r in G.guide_rules_setup(df).collect()}
    assert {k: v for k, v in items.items() if k[1] != "prerequisites"} == {
        (g, n): v for g in (1, 2) for n, v in (("always", "x"), ("never", "y"), ("environment", "z"), ("auth_methods", "key"), ("required_secrets", "s"), ("env_notes", "e"))}
    trouble = {(r["guide_id"], r["pos"]): (r["likely_cause"], r["fix"], r["escalate_if"]) for r in G.guide_troubleshooting(df).collect()}
    assert len(trouble) == 12 and trouble[1, 9] == trouble[2, 0] == ("c", "f", "g") and trouble[2, 1] == ("", "", "")
    cards = {r["guide_id"]: (r["use_when"], r["avoid_when"], r["escalate_if"]) for r in G.guide_decisions(df).collect()}
    assert cards == {1: (["u"], [], ["v"]), 2: (["u"], [], ["v"])}
    refs = [(r["guide_id"], r["topic"], r["label"], r["url"]) for r in G.guide_references(df).orderBy("guide_id", "pos").collect()]
    assert refs == [(1, "t", "l", "u"), (1, "", "k", "#"), (2, "t", "l", "u"), (2, "t", "k", "#"), (2, "w", "m", "#")]
    errors = [(r["guide_id"], r["error"], r["likely_cause"], r["fix"]) for r in G.package_errors(df).orderBy("guide_id").collect()]
    assert errors == [(1, "E", "c", "f"), (2, "E", "c", "")]
