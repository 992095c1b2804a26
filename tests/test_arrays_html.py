"""Array helpers against plain Python; extraction of very large and odd pages; columns that are asked for alone."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sitelens.functions.arrays import collect_text, covered, emitting, let, numbers, spread_out
from sitelens.sources.html import PAGE_FIELDS, extract_pages


def test_folds_and_masks_against_plain_python(spark):
    rng = random.Random(4)
    rows = []
    for k in range(60):
        n = rng.randint(0, 40)
        ranges = sorted((a, min(n, a + rng.randint(0, 6))) for a in (rng.randrange(n) for _ in range(rng.randint(0, 6) if n else 0)))
        rows.append((k, n, [{"first": a, "last": b} for a, b in ranges], sorted(rng.sample(range(50), rng.randint(0, 9)))))
    df = spark.createDataFrame(rows, "k int, n int, ranges array<struct<first:int,last:int>>, places array<int>")
    running = collect_text(F.col("places"), F.lit(0), lambda total, x: emitting(total + x, F.concat((total + x).cast("string"), F.lit(":"), x.cast("string"), F.lit(";"))),
                           lambda total: F.concat(total.cast("string"), F.lit(":0;")))
    got = df.select("k", covered(F.col("ranges"), F.col("n")).alias("mask"), numbers(running, ("total", "x")).alias("sums"),
                    spread_out(F.col("places"), lambda x: x, lambda x: x * 2, "int").alias("spread"),
                    let(F.size("places") + 1, lambda s: s * s).alias("square")).collect()
    for r, (_, n, ranges, places) in zip(sorted(got, key=lambda r: r.k), rows):
        assert r.mask == [any(x["first"] <= i <= x["last"] for x in ranges) for i in range(n)]
        assert [(s.total, s.x) for s in r.sums] == [(sum(places[:i + 1]), x) for i, x in enumerate(places)] + [(sum(places), 0)]
        assert r.spread == [i * 2 if i in places else None for i in range(places[-1] + 1 if places else 0)]
        assert r.square == (len(places) + 1) ** 2


def big_page(kind, n):
    if kind == "closed":
        return "<html><body><article>" + "".join(f"<p>t{i} <b>x</b></p>" for i in range(n // 2)) + "</article></body></html>"
    if kind == "unclosed":
        return "<html><body><article>" + "".join(f"<p>t{i}" for i in range(n)) + "</article></body></html>"
    if kind == "noise":
        return "<html><body>" + "".join(f"<aside>t{i}</aside><p>u</p>" for i in range(n // 2)) + "</body></html>"
    return "<html><body>" + "".join(f"<pre>a<code>b{i}</code></pre>" for i in range(n // 2)) + "</body></html>"


@pytest.mark.parametrize("kind", ["closed", "unclosed", "noise", "code"])
def test_pages_of_very_many_elements_take_linear_time(spark, kind):
    def seconds(sizes):
        df = spark.createDataFrame([(i, "http://a.example/b", big_page(kind, n)) for i, n in enumerate(sizes)], "page_id long, url string, html string").coalesce(1)
        started = time.time()
        rows = extract_pages(df, columns=("title", "content", "headings", "code_blocks", "has_tables", "links")).collect()
        return time.time() - started, rows

    n = 50_000 if kind == "closed" else 20_000
    seconds([500])
    five, _ = seconds([n // 5] * 5)
    one, rows = seconds([n])
    assert one < 2 * five + 2
    assert rows[0].content.count("\n") + 1 == (n // 2 if kind == "noise" else n)
    assert len(rows[0].code_blocks) == (n // 2 if kind == "code" else 0)


def test_columns_alone_are_those_of_the_whole(spark):
    html = [None, "", "<title>T</title>x", "<body><article><h1>A</h1><p>p &amp; q<p>r<a href='/x?y#z'>link</a></article><nav><a href='/n'>n</a></nav>",
            "<main><pre><code class='language-py'>x = 1</code></pre><h3>c</h3><h2>b</h2><table></table><a href='../up/./k'>k</a></main></b></p>",
            "<div class='content'><div><p>deep</div></p>tail</div><meta name='description' content='d'>"]
    df = spark.createDataFrame([(i, "https://h.example/a/b", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    for strip in (False, True):
        whole = {r.page_id: r for r in extract_pages(df, strip_chrome=strip).collect()}
        for column in PAGE_FIELDS:
            alone = extract_pages(df, strip_chrome=strip, columns=(column,))
            assert alone.columns == ["page_id", "url", column]
            assert all(r[column] == whole[r.page_id][column] for r in alone.collect()), column


def test_unused_columns_are_not_built(spark):
    df = spark.createDataFrame([(1, "https://h.example/", "<p>x")], "page_id long, url string, html string")
    plan = extract_pages(df, columns=("title",))._jdf.queryExecution().optimizedPlan().toString()
    assert "docs-content" not in plan and "language-" not in plan
