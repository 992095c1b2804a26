"""Scalar helpers (X12-X23) and the bundle writers."""

import glob
import os
import tempfile

from pyspark.sql import functions as F

from sitelens.functions import text as T
from sitelens.operators import guides as G
from sitelens.operators import history as H
from sitelens.operators import rewrites as RW
from sitelens.sources import fixtures, records


def test_scalar_helpers(spark):
    df = spark.createDataFrame([("B+", "a &lt;b&gt; & c", "---\ntitle: x\n---\nbody", 0.125, "safe_write", "custom_risk")],
                               "g string, h string, fm string, x double, r1 string, r2 string")
    r = df.select(T.interpretation("g").alias("i"), T.interpretation(F.lit("Z")).alias("u"), T.html_escape("h").alias("e"),
                  T.strip_frontmatter("fm").alias("f"), T.percent_text("x").alias("p"), T.risk_label("r1").alias("l1"),
                  T.risk_label("r2").alias("l2"), T.truncation_status(F.repeat(F.lit("a"), 11900)).alias("t"),
                  T.strip_json_fences(F.lit("```json\n{\"a\": 1}\n```")).alias("j"),
                  T.title_case(F.lit("how-to api_v2")).alias("tc")).collect()[0]
    assert r["i"].startswith("Good") and r["u"] == "Unknown"
    assert r["e"] == "a &lt;b&gt; &amp; c"                 # unescape first: no double escaping
    assert r["f"] == "body" and r["p"] == "13%"              # JS Math.round: half up
    assert r["l1"] == "SAFE WRITE" and r["l2"] == "Custom Risk"
    assert r["t"] == "possibly_truncated" and r["j"] == '{"a": 1}'
    assert r["tc"] == "How-To Api_V2"


def test_progress_and_duration(spark):
    df = spark.createDataFrame([(60, "RUNNING", 0, 90), (99, "RUNNING", 0, None), (10, "COMPLETED", 5, 6)],
                               "progress int, status string, s long, e long")
    out = df.select(H.progress_stage(F.col("progress"), F.col("status")).alias("st"),
                    H.duration_seconds(F.timestamp_seconds("s"), F.timestamp_seconds("e")).alias("d")).collect()
    assert [o["st"] for o in out] == ["scoring", "generating recommendations", None]
    assert [o["d"] for o in out] == [90, 0, 1]


def test_bundle_writers(spark, sf_small):
    out = tempfile.mkdtemp(prefix="sitelens-bundle-")
    acc = RW.accept_rewrites(fixtures.rewrites(spark, sf_small), fixtures.site_pages(spark, sf_small), fixtures.REWRITE_RUN_DATE)
    RW.write_rewrite_bundle(acc, os.path.join(out, "rewrites"))
    assert spark.read.json(os.path.join(out, "rewrites", "markdown")).count() == acc.count()
    assert spark.read.json(os.path.join(out, "rewrites", "llms")).count() == RW.llms_txt_lines(acc).count()
    assert spark.read.json(os.path.join(out, "rewrites", "metadata", "improvements")).count() > 0
    for name in ("markdown", "llms", "metadata/pages"):  # files follow the data, not the number of sites
        assert len(glob.glob(os.path.join(out, "rewrites", name, "*.json"))) <= 8
    G.write_package_bundle(records.packages(spark, sf_small), os.path.join(out, "packages"))
    assert spark.read.json(os.path.join(out, "packages", "pages")).count() > 0
    assert spark.read.json(os.path.join(out, "packages", "llms")).count() > 0


def test_html_escape_decodes_every_reference(spark):
    import html
    import random

    from pyspark.sql import functions as F

    from sitelens.functions import text as T
    from sitelens.functions.entities import unescape_text

    rng = random.Random(2)
    names = rng.sample(sorted(html.entities.html5), 150)
    texts = ["&notit; &amp;lt; &copy &copyx &nosuch; & && &; &#; &#x; &#xZ;", "&#0;&#x0;&#128;&#150;&#159;&#13;&#1;&#11;&#xfdd0;&#xfffe;&#x1ffff;&#xd800;",
             "&#1114112;&#99999999999999;&#x110000;&#xffffffffffff;&#x1F600;&#128512&#65a", "a&ampb&LT&gt;", "&#00065;&#x0041;", "plain", ""]
    texts += ["".join(rng.choice([f"&{rng.choice(names)}", f"&{rng.choice(names)};", f"&#{rng.randrange(70_000)};", "x", " ", "<", '"']) for _ in range(12)) for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", unescape_text(F.col("t")).alias("plain"), T.html_escape("t").alias("escaped")).collect():
        want = html.unescape(r.t)
        assert r.plain == want, r.t
        assert r.escaped == want.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
