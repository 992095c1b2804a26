"""Breadth-first rounds: what they shuffle and read, and long chains."""

import pytest
from pyspark.sql import functions as F

from helpers import page, pages_df
from sitelens.operators import linkgraph as L


def place(site, k):
    return f"https://{site}.example.com/docs" + (f"/p{k}" if k else "")


def chain(n, site="s"):
    url = lambda k: place(site, k)
    return [page(site=site, ord=k, url=url(k), content="words " * 20, links=[url(k + 1), url(max(0, k - 1)), url(0)]) for k in range(n)]


def test_a_wide_round_does_not_shuffle_the_links(spark):
    links = L.ordered_links(pages_df(spark, chain(30))).withColumnRenamed("src", "url")
    frontier = links.select("site", "url", F.array(F.lit(0)).alias("path")).distinct()
    with L.Bucketed(links, "links") as table:
        wide = L.next_round(frontier, table.rows, None)
        plan = wide._jdf.queryExecution().executedPlan().toString()
        scan = next(i for i, line in enumerate(plan.splitlines()) if "FileScan parquet" in line and "Bucketed: true" in line)
        above = plan.splitlines()[:scan][::-1]
        before_join = [line for line in above[:next(i for i, line in enumerate(above) if "Join" in line)]]
        assert not any("Exchange" in line for line in before_join), plan
        assert wide.count() == 31
        narrow = L.next_round(frontier.limit(2), table.rows, [1, 2])
        plan = narrow._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [In(key" in plan and plan.count("Exchange hashpartitioning") <= 3, plan
        name = table.name
    assert not spark.catalog.tableExists(name)


def test_a_long_chain_and_its_runs(spark, monkeypatch):
    sizes = []
    add = L.Runs.add
    monkeypatch.setattr(L.Runs, "add", lambda self, rows: (add(self, rows), sizes.append([n for n, _ in self.runs])))
    n = 24
    got = {r.url: (r.depth, r.path) for r in L.reachable(pages_df(spark, chain(n))).collect()}
    assert got == {place("s", k): (k, [0] * k) for k in range(n)}
    assert all(a > 2 * b for run in sizes for a, b in zip(run, run[1:])) and max(map(len, sizes)) <= 5


@pytest.mark.parametrize("few", [0, 500])
def test_rounds_agree_whichever_way_they_go(spark, monkeypatch, few):
    monkeypatch.setattr(L, "FEW_KEYS", few)
    rows = [page(site=s, ord=k, url=place(s, k), content="x" * 60,
                 links=[place(s, (k * 7 + j) % 12) for j in range(3)]) for s in ("a", "b") for k in range(12)]
    got = {(r.site, r.url): (r.depth, r.path) for r in L.reachable(pages_df(spark, rows)).collect()}
    monkeypatch.undo()
    assert got == {(r.site, r.url): (r.depth, r.path) for r in L.reachable(pages_df(spark, rows)).collect()}
    assert len(got) > 10
