"""HTML extraction branches (H1-H11) and URL functions."""

import random
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from sitelens.functions import urls as U
from sitelens.sources.html import VOID, extract_pages, unescape

LONG = "w" * 300
CASES = {
    "article": ("https://x.com/a", "<html><head><title> T </title></head><body><nav>N</nav><article><h2>B</h2><h1>A</h1>"
                "<aside>side</aside><header>hd</header><footer>F</footer><script>var x='</p>'</script><p>text</p></article></body></html>"),
    "body": ("https://x.com/a", "<body><header>H</header><aside>A</aside><p>P</p><footer>F</footer></body>"),
    "class": ("https://x.com", '<body><div class="x Markdown-Body y">m</div><div class="content">c</div></body>'),
    "role": ("https://x.com", '<body><div role="main">r</div><main>M</main></body>'),
    "only_role": ("https://x.com", '<body><div class="content">c</div><div data-x="a>b" role=\'main\'>r</div></body>'),
    "content": ("https://x.com", '<body><div class="content">c</div><p>p</p></body>'),
    "no_content": ("https://x.com", '<body><div class="contents">c</div></body>'),
    "meta": ("https://x.com", '<meta content="D &amp; E" name="description"><h1>Head</h1><p>x</p>'),
    "long_p": ("https://x.com", f"<p>{LONG}</p>"),
    "untitled": ("https://x.com", "<div>no title</div>"),
    "code": ("https://x.com", '<article><pre class="lang-js"><code class="language-python">import os</code></pre>'
             '<pre class="lang-go">go code</pre><pre><code> </code></pre><pre><code>plain</code></pre></article>'),
    "links": ("https://x.com/docs/p", '<article><a href="/b">b</a><a href="/a">a</a><a href="/b">b</a><a href="https://y.com/z">z</a>'
              '<a href="../up">u</a><a>none</a><table></table></article>'),
    "refs": ("https://x.com/docs/p", '<body><nav><a href="/out">out</a></nav><main><nav><a href="/in">in</a></nav><a href="/x">x</a><a href="/l.png">img</a>'
             '<a href="/e"> </a></main><footer><a href="/f">f</a></footer></body>'),
    "unclosed": ("https://x.com", "<article><p><b>one<br><p>two</p><p>three</p></article>"),
    "pops": ("https://x.com", "<article><div><nav>gone<div>gone too</div></div>kept</article>after"),
    "silent": ("https://x.com", "<article>a<template>t</template><ruby>b<rt>r</rt></ruby><!-- no <b> -->c</article>"),
    "stray": ("https://x.com", "<article>1 < 2 & 3 > 2 <p>x</article>"),
    "null": (None, None),
    "empty": ("https://x.com", ""),
}
CHROME = {
    "chrome": ("https://x.com", '<body><div class="breadcrumb">Home / Docs</div><a href="#main">Skip to content</a>'
               '<div><span>Sign in</span><p>Real text</p></div><div class="banner">b</div><ol aria-label="Breadcrumb trail"><li>x</li></ol></body>'),
    "nested_skip": ("https://x.com", "<main><a href='/s'><span>Skip to main</span></a><a href='/s'>Skip to main <b>x</b></a><section>Home</section></main>"),
}


@pytest.fixture(scope="module")
def extracted(spark):
    def run(cases, **options):
        df = spark.createDataFrame([(k, u, h) for k, (u, h) in cases.items()], "page_id string, url string, html string").repartition(2)
        return {r["page_id"]: r for r in extract_pages(df, **options).collect()}
    return run(CASES) | run(CHROME, strip_chrome=True, description_chars=200)


def test_containers_and_noise(extracted):
    r = extracted["article"]
    assert r["title"] == "T" and r["description"] == "text"
    assert r["content"] == "B\nA\nside\nhd\ntext"
    assert [h["level"] for h in r["headings"]] == [1, 2] and r["headings_flat"] == ["B", "A"]
    assert extracted["body"]["content"] == "P"
    assert [extracted[k]["content"] for k in ("class", "role", "only_role", "content", "no_content")] == ["m", "M", "r", "c", "c"]
    assert extracted["pops"]["content"] == "kept"                 # the end of the div closes the nav inside it
    assert extracted["silent"]["content"] == "a\nb\nc"
    assert extracted["stray"]["content"] == "1 < 2 & 3 > 2\nx"


def test_title_and_description(extracted):
    assert extracted["meta"]["title"] == "Head" and extracted["meta"]["description"] == "D & E"
    assert extracted["long_p"]["description"] == LONG and extracted["untitled"]["title"] is None
    assert extracted["unclosed"]["description"] == "onetwothree"  # the first <p> is never closed: all nests inside it
    assert extracted["unclosed"]["content"] == "one\ntwo\nthree"
    assert extracted["null"]["content"] == extracted["empty"]["content"] == ""


def test_code_tables_and_links(extracted):
    assert [tuple(c) for c in extracted["code"]["code_blocks"]] == [("python", "import os"), ("go", "go code"), (None, "plain")]
    assert [tuple(c) for c in extracted["code"]["code_samples"]] == [("python", "import os"), ("text", ""), ("text", "plain")]
    r = extracted["links"]
    assert r["links"] == ["https://x.com/a", "https://x.com/b", "https://x.com/up"] and r["has_tables"] and not extracted["code"]["has_tables"]
    # links of the whole page, read after the noise inside the container is gone
    assert [(x["text"], x["href"]) for x in extracted["refs"]["link_refs"]] == [("out", "https://x.com/out"), ("x", "https://x.com/x"), ("f", "https://x.com/f")]


def test_chrome_strip(extracted):
    assert extracted["chrome"]["content"] == "Real text"
    assert extracted["nested_skip"]["content"] == "Skip to main\nx\nHome"


class Reference(HTMLParser):
    """Texts outside script and style, by the standard library's tokenizer and a stack."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.texts, self.buffer = [], [], ""

    def cut(self):
        if self.buffer.strip():
            self.texts.append(self.buffer.strip())
        self.buffer = ""

    def handle_starttag(self, tag, attrs):
        self.cut()
        if tag not in VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.cut()

    def handle_endtag(self, tag):
        self.cut()
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_comment(self, data):
        self.cut()

    def handle_data(self, data):
        if not {"script", "style"} & set(self.open):
            self.buffer += data


def test_texts_match_a_stack_parser(spark):
    rng = random.Random(3)
    bits = ["<p>", "</p>", "<b>", "</b>", "<div>", "</div>", "<br>", "<img src='a>b'>", "text", " x &amp; y ", "&lt;i&gt;", "<!-- c -->", "<i/>", "&eacute;&#8364;",
            "<script>if (a<b) '</p>'</script>", "<style>p{}</style>", "<a href=\"/q\">l</a>", "\n"]
    pages = [(i, "https://x.com", "<article>" + "".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) + "</article>") for i in range(150)]
    got = {r["page_id"]: r["content"] for r in extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i, _, html in pages:
        parser = Reference()
        parser.feed(html)
        parser.close()
        parser.cut()
        assert got[i] == "\n".join(parser.texts), html


def test_unescape_and_resolve_like_the_standard_library(spark):
    import html

    texts = ["a &amp; b", "&lt;&gt;&quot;&#39;", "&amp;lt;", "&eacute; &hellip; &copy", "&#x1F600; &#8212;", "&unknown; &", "&#0; &#xD800;", "&amp;#39;", "R&D &notin; x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(unescape(F.col("t"))).collect()] == [html.unescape(t) for t in texts]
    bases = ["https://x.com/docs/p", "https://x.com/docs/", "https://x.com", "http://x.com/a/b/c?q=1#f"]
    hrefs = ["/b", "b", "../b", "../../b", "./b", "b/../c", "?z=1", "#top", "//y.com/z", "https://y.com/q", "mailto:a@b.c", "", "a/b/", "..", "b?x=/../y"]
    df = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string")
    got = {(r["b"], r["h"]): r["u"] for r in df.select("b", "h", U.resolve_url("b", F.col("h")).alias("u")).collect()}
    for b in bases:
        for h in hrefs:
            want = urljoin(b, h) if h else b
            assert got[b, h] == want, (b, h, got[b, h], want)


def test_url_functions(spark):
    rows = [("https://www.docs.Example.com:8080/docs/a/#frag", "https://www.docs.Example.com:8080/docs"),
            ("https://x.com/docs2/b", "https://x.com/docs"), ("http://x.com/a b/c", "http://x.com/"),
            ("https://x.com/", "https://x.com/")]
    df = spark.createDataFrame(rows, "u string, s string")
    out = df.select(U.site_name("u").alias("site"), U.normalize_url("u").alias("n"), U.in_scope("u", "s").alias("sc"),
                    U.valid_path("u").alias("v"), U.file_name(F.lit("My Title!"), "u").alias("f")).collect()
    assert out[0]["site"] == "docs.Example.com:8080" and out[0]["n"] == "https://www.docs.Example.com:8080/docs/a"
    assert out[1]["sc"]                       # plain prefix: /docs admits /docs2
    assert out[2]["site"] == "x.com"          # a space in the URL still yields a host
    assert out[0]["f"] == "docs-a.md" and out[3]["f"] == "my-title.md"
    assert out[3]["n"] == "https://x.com"


def test_valid_path_rules(spark):
    df = spark.createDataFrame([("https://x.com/api/v1",), ("https://x.com/guide.PDF",), ("https://x.com/docs/ok",)],
                               "u string")
    assert [r[0] for r in df.select(U.valid_path("u")).collect()] == [False, False, True]
