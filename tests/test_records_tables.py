"""Slug tables that are merged bucket by bucket; rows that do not fit a schema."""

import os
import tempfile

import pytest
from pyspark.sql import types as T

from sitelens.operators import records as R
from sitelens.sources.records import enforced


def seeds_of(spark, rows):
    return spark.createDataFrame(rows, "slug string, title string, status string")


def test_merge_rewrites_the_touched_buckets_only(spark, monkeypatch):
    root = os.path.join(tempfile.mkdtemp(prefix="sitelens-slugs-"), "slugs")
    target = spark.createDataFrame([(f"p{i}", f"Title {i}", "old", i) for i in range(60)], "slug string, title string, status string, views int")
    table = R.SlugTable(spark, root, buckets=8)
    with pytest.raises(ValueError):
        table.rows()
    table.create(target)
    seeds = seeds_of(spark, [("p3", "Third", "new"), ("p60", "Sixtieth", "new")])
    want = sorted(map(tuple, R.upsert_by_slug(target, seeds, ["title"]).collect()))
    before = table.state.current()
    read = []
    state_read = R.State.read
    monkeypatch.setattr(R.State, "read", lambda self, m, t, s, buckets=None: (read.append(buckets), state_read(self, m, t, s, buckets))[1])
    table.merge(seeds, ["title"])
    assert read == [set(table.touched(seeds))] and len(read[0]) <= 2
    monkeypatch.undo()
    assert sorted(map(tuple, table.rows().collect())) == want
    after = table.state.current()
    changed = {b for b, v in after["tables"]["rows"].items() if before["tables"]["rows"].get(b) != v}
    assert changed == set(table.touched(seeds))
    table.merge(seeds, ["title"])  # again: the same table
    table.merge(seeds.limit(0), ["title"])
    assert sorted(map(tuple, table.rows().collect())) == want
    monkeypatch.setattr(R.State, "commit", lambda self, m: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        table.merge(seeds_of(spark, [("p5", "Never", "x")]), ["title"])
    monkeypatch.undo()
    assert sorted(map(tuple, table.rows().collect())) == want


def test_rows_that_do_not_fit_are_set_aside(spark):
    rows = spark.createDataFrame([("1", "a", "2.5", "x"), ("two", "b", "1", "x"), ("3", None, "oops", "x"), (None, "d", None, "x")], "id string, name string, score string, extra string")
    schema = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("name", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("later", T.DateType())])
    good, bad = enforced(rows, schema)
    assert [(f.name, f.dataType) for f in good.schema] == [(f.name, f.dataType) for f in schema]
    assert [tuple(r) for r in good.collect()] == [(1, "a", 2.5, None)]
    assert sorted(tuple(r.reasons) for r in bad.collect()) == [("id: missing",), ("id: not a bigint",), ("score: not a double",)]
    assert enforced(rows.limit(0), schema)[0].count() == 0


def test_a_deep_page_of_a_hot_key_sorts_its_ranges_only(spark):
    from pyspark.sql import functions as F

    from sitelens.operators import ranking

    rows = spark.range(0, 9_000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("o"), F.col("id") % 40)).alias("org"),
                                        F.pmod(F.col("id") * 7919, F.lit(9_000)).alias("at"), "id").repartition(6)
    order = [F.col("at").desc(), F.col("id")]
    everything = {}
    for r in rows.collect():
        everything.setdefault(r.org, []).append((-r.at, r.id))
    for offset, limit in ((2_400, 25), (990, 20), (100, 5), (2_999, 10)):
        got = ranking.paged(rows, "org", order, offset, limit)
        assert got.columns == ["org", "at", "id", "position"]
        want = {(org, i, k + 1) for org, mine in everything.items() for k, (_, i) in enumerate(sorted(mine)) if offset <= k < offset + limit}
        assert {(r.org, r.id, r.position) for r in got.collect()} == want
    _, wanted = ranking.page_ranges(rows, "org", order, 2_400, 25)
    assert 1 <= wanted.where("_c_key = 'hot'").count() <= 2


def test_a_bundle_is_replaced_as_a_whole(spark):
    from sitelens.session import replaced

    out = os.path.join(tempfile.mkdtemp(prefix="sitelens-bundle-"), "bundle")
    put = lambda at, n: [spark.range(n).write.json(f"{at}/{name}") for name in ("one", "two")]
    sizes = lambda: [spark.read.json(f"{out}/{name}").count() for name in ("one", "two")]
    with replaced(spark, out) as draft:
        put(draft, 3)
    assert sizes() == [3, 3]
    with pytest.raises(RuntimeError), replaced(spark, out) as draft:
        spark.range(9).write.json(f"{draft}/one")
        raise RuntimeError("killed")
    assert sizes() == [3, 3]
    with replaced(spark, out) as draft:
        put(draft, 5)
    assert sizes() == [5, 5] and os.listdir(os.path.dirname(out)) == ["bundle"]
