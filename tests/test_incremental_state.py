"""Versioned state of the incremental scores: crashes, replays, clean-up, settings."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from sitelens.operators import rollups
from sitelens.streaming import incremental as INC

from helpers import page, pages_df


def batch(spark, rows, when):
    return pages_df(spark, rows).withColumn("fetched_at", F.timestamp_seconds(F.lit(when)))


def scores(spark, state):
    return {r["site"]: r["overall_score"] for r in INC.read_scores(spark, state).collect()}


def wanted(spark, rows):
    return {r["site"]: r["overall_score"] for r in rollups.site_scores(pages_df(spark, rows)).collect()}


def size(root):
    return sum(1 for _at, _dirs, files in os.walk(root) for f in files if f.endswith((".parquet", ".json")))


def test_a_batch_that_dies_leaves_the_old_state(spark, monkeypatch):
    state = os.path.join(tempfile.mkdtemp(prefix="sitelens-state-test-"), "state")
    old = [page(site=f"s{i % 2}", ord=i, content="see above") for i in range(6)]
    new = [page(site="s0", ord=0, content="plain")]
    with pytest.raises(ValueError):
        INC.read_scores(spark, state)
    INC.process_batch(batch(spark, old, 1), 0, state, 3, 2)
    before = scores(spark, state)
    assert before == wanted(spark, old)
    write = INC.State.write
    for table in ("fresh", "signals", "sums", "scores"):  # killed at each of the four writes, and before the manifest
        def dies(self, df, version, name, bucket, table=table):
            write(self, df, version, name, bucket)
            if name == table:
                raise RuntimeError("killed")
        monkeypatch.setattr(INC.State, "write", dies)
        with pytest.raises(RuntimeError):
            INC.process_batch(batch(spark, new, 2), 1, state)
        assert scores(spark, state) == before
    monkeypatch.setattr(INC.State, "write", write)
    INC.process_batch(batch(spark, new, 2), 1, state)
    after = scores(spark, state)
    assert after == wanted(spark, [new[0]] + old[1:]) != before
    current = INC.State(spark, state).current()
    assert (current["version"], current["batch_id"], current["site_buckets"], current["page_buckets"]) == (2, 1, 3, 2)
    INC.process_batch(batch(spark, old, 3), 1, state)  # its number is committed
    assert scores(spark, state) == after


def test_state_stays_of_constant_size(spark):
    state = os.path.join(tempfile.mkdtemp(prefix="sitelens-state-test-"), "state")
    pages = [page(site="s0", ord=i, content="see above") for i in range(3)]
    sizes = []
    for n in range(7):
        pages[n % 3] = page(site="s0", ord=n % 3, content="plain" if n % 2 else "step 1")
        INC.process_batch(batch(spark, pages, n + 1), n, state, 2, 2)
        sizes.append(size(state))
    assert len(set(sizes[2:])) == 1, sizes
    assert len(INC.State(spark, state).versions()) == INC.KEPT
    assert scores(spark, state) == wanted(spark, pages)
    INC.process_batch(batch(spark, pages, 9).limit(0), 20, state)  # nothing to do
    assert scores(spark, state) == wanted(spark, pages)
