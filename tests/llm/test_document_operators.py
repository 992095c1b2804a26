"""Jaccard join, embedding near-dedup, quality rules and votes, components and the pipeline."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitelens.llm import embedding_dedup, jaccard_join, line_dedup, quality_knn, quality_rules
from sitelens.llm.components import connected_components

from .conftest import AWKWARD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    pairs = {frozenset(e) for e in edges if e[0] != e[1]}
    want = roots({n for e in pairs for n in e}, lambda a, b: frozenset((a, b)) in pairs)
    assert got == want


def edited(text, rng, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10 ** 6)}"
    return " ".join(words)


def test_jaccard_components_against_brute_force(docs_of, prose):
    rng = random.Random(5)
    texts = []
    for k in range(12):  # groups of near copies around the threshold, some of one another only
        base = prose(k, rng.choice([4, 12, 40, 90, 200, 400])).replace("\n", " ")
        texts += [base, base.upper(), base + "\n"]
        texts += [edited(base, rng, rng.choice([1, 1, 2, 3, 5])) for _ in range(8)]
        texts += [edited(texts[-1], rng, 1), " ".join(base.split(" ")[: -rng.choice([1, 3, 9])])]
    passage = prose(77, 60)
    texts += [prose(500 + i, 20) + "\n" + passage for i in range(30)]
    texts += [f"w{i % 4} tail" for i in range(8)] + [f"a b c d e f g h i j {i}" for i in range(6)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = {r.doc_id: r for r in jaccard_join.jaccard_components(docs_of(rows), block=8).collect()}
    sets = {i: shingles(t) for i, t in rows}

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return sets[a] and sets[b] and 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both)

    want = roots(sorted(sets), linked)
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in got.items()} == want
    kept = {r.doc_id for r in jaccard_join.keep_one(docs_of(rows)).collect()}
    assert kept == set(want.values())


def test_keep_one_of_five_words_at_80_percent(docs_of, prose):
    """The pipeline's law: near copies that op5's three words at 90 % leave apart are one group."""
    rng = random.Random(11)
    texts = []
    for k in range(10):
        base = prose(k, rng.choice([3, 4, 30, 60, 150, 300])).replace("\n", " ")
        texts += [base, base.upper()] + [edited(base, rng, rng.choice([1, 1, 2, 4, 7])) for _ in range(6)]
    swapped = prose(900, 105).replace("\n", " ").split(" ")
    texts += [" ".join(swapped), " ".join(swapped[:40] + ["x1"] + swapped[41:80] + ["x2"] + swapped[81:])]
    rows = list(enumerate(texts))
    sets = {i: shingles(t, 5) for i, t in rows}
    want = roots(sorted(sets), lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    three = {i: shingles(t) for i, t in rows}
    a, b = rows[-2][0], rows[-1][0]
    assert want[b] == want[a] and 100 * len(three[a] & three[b]) < 90 * len(three[a] | three[b])
    assert {r.doc_id for r in jaccard_join.keep_one(docs_of(rows), words=5, percent=80).collect()} == set(want.values())


def test_pipeline_joins_by_five_words_at_80_percent(docs_of, prose, spark):
    import corpus_pipeline

    words = prose(900, 105).replace("\n", " ").split(" ")
    near = " ".join(words[:40] + ["x1"] + words[41:80] + ["x2"] + words[81:])
    docs = docs_of([(1, " ".join(words)), (2, near), (3, prose(901, 120))])
    assert sorted(r.doc_id for r in corpus_pipeline.jaccard_stage(spark, docs, "").collect()) == [1, 3]


def test_bands_and_parts_hold_every_pair():
    starts = jaccard_join.band_starts(90, 10_000)
    for n in range(1, 3000):
        least = -(-90 * n // 100)
        band = lambda x: np.searchsorted(starts, x, side="right") - 1
        assert band(n) - band(least) <= 1
    rng = np.random.default_rng(0)
    for n in (1, 5, 19, 20, 38, 57, 200, 1000):
        a = np.sort(rng.integers(0, 2**63, n, dtype=np.uint64))
        for drop in range(0, n // 10 + 1, max(1, n // 40)):
            b = np.sort(np.concatenate([a[drop:], rng.integers(0, 2**63, 0, dtype=np.uint64)]))
            if 100 * len(b) >= 90 * n:
                x, y = jaccard_join.tile_keys([a, b], 90)
                assert set(x) & set(y)


def test_jaccard_awkward(awkward, spark):
    got = jaccard_join.jaccard_components(awkward.withColumn("row", F.lit(1)).withColumn("root", F.lit("clash"))).collect()
    assert len(got) == len(AWKWARD)
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((d, len(shingles(t))) for d, t in AWKWARD)
    assert all(r.component_id == r.doc_id for r in got if r.n_shingles == 0)
    kept = jaccard_join.keep_one(awkward).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter(set(AWKWARD))
    assert jaccard_join.jaccard_components(awkward.limit(0)).count() == 0
    assert jaccard_join.keep_one(awkward.limit(0)).count() == 0


def embedding_rows(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


def test_embedding_links_against_brute_force(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((40, 16))
    x = np.concatenate([c + 0.08 * rng.standard_normal((rng.integers(1, 30), 16)) for c in centres] + [rng.standard_normal((400, 16))])
    x = np.concatenate([x, x[:50], 3 * x[50:60]]).astype(np.float32)  # copies, and copies of another length
    rows = [(int(i), [float(v) for v in e], int(i) % 3) for i, e in enumerate(x)]
    bad = [(10_000, None, 0), (10_001, [0.0] * 16, 0), (10_002, [float("nan")] * 16, 1), (10_003, [None] * 16, 1), (10_004, [1.0, 2.0], 1), (10_005, [float("inf")] + [0.0] * 15, 1), (10_006, [], 0)]
    got = {r.vec_id: r for r in embedding_dedup.link_vectors(embedding_rows(spark, rows + bad)).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= hit.sum(axis=1)).all() and found.sum() >= 0.98 * hit.sum()
    if (found == hit.sum(axis=1)).all():
        assert {i: got[i].component_id for i in range(len(x))} == roots(range(len(x)), lambda a, b: hit[a, b])
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert all(got[i].n_links == 0 and got[i].component_id == i for i, _, _ in bad)
    assert embedding_dedup.link_vectors(embedding_rows(spark, [])).count() == 0
    assert embedding_dedup.link_vectors(embedding_rows(spark, bad[:1])).collect()[0].kept


def test_embedding_cells_in_blocks(spark, monkeypatch):
    """A cell that holds most vectors is cut into blocks of residents and visitors without losing a link."""
    monkeypatch.setattr(embedding_dedup, "RESIDENTS", 16)
    monkeypatch.setattr(embedding_dedup, "VISITORS", 32)
    rng = np.random.default_rng(1)
    x = np.concatenate([np.ones(8) + 0.02 * rng.standard_normal((150, 8)), rng.standard_normal((50, 8))])
    rows = [(int(i), [float(v) for v in e], 0) for i, e in enumerate(x)]
    got = {r.vec_id: r for r in embedding_dedup.link_vectors(embedding_rows(spark, rows)).collect()}
    u = np.float32(x).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = u @ u.T >= 0.95
    assert [got[i].n_links for i in range(150)] == (hit.sum(axis=1) - 1)[:150].tolist()
    assert {got[i].component_id for i in range(150)} == {0}


def test_block_labels_that_a_later_part_lowers():
    """Over 512 visitors: chained links give one component whatever part of the visitors they come from."""
    import pyarrow as pa

    def block(residents, visitors):
        degrees = np.radians([*residents, *visitors])
        n, m = len(residents), len(visitors)
        return pa.table({"cell": [0] * (n + m), "visitor": [0] * n + [1] * m, "node": list(range(n + m)), "copies": [1] * (n + m), "home": [0] * n + [1] * m,
                         "vector": pa.array(np.stack([np.cos(degrees), np.sin(degrees)], axis=1).tolist(), pa.list_(pa.float64())),
                         "cells": pa.array([[0]] * n + [[]] * m, pa.list_(pa.int64()))})

    rng = np.random.default_rng(6)
    cases = [([60, 0, 30], [15] + [200] * 599 + [45])]  # part 1 joins residents 1 and 2, part 2 residents 0 and 2
    for _ in range(20):
        few = np.where(rng.random(1500) < 0.01, rng.uniform(0, 180, 1500), 270)
        cases.append((rng.uniform(0, 180, 12), few))
    for residents, visitors in cases:
        found = [(int(a), int(b)) for part in embedding_dedup._block_links(block(residents, visitors), 0.95) for a, b in zip(part.column("node").to_pylist(), part.column("other").to_pylist())]
        angle = np.radians(np.concatenate([residents, visitors]))
        n = len(residents)
        true = {frozenset((i, j)) for i in range(n) for j in range(n, len(angle)) if np.cos(angle[i] - angle[j]) >= 0.95}
        nodes = sorted({x for pair in true for x in pair})
        made = {frozenset(e) for e in found}
        assert roots(nodes, lambda a, b: frozenset((a, b)) in made) == roots(nodes, lambda a, b: frozenset((a, b)) in true)


def test_visits_are_measured_on_real_links(spark, monkeypatch):
    """Sparse links: a query's match with itself counts for nothing, and no id needs to be divisible by 50."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((3000, 16))
    for k in range(30):  # pairs just over the threshold
        noise = rng.standard_normal(16)
        noise -= noise @ x[k] / (x[k] @ x[k]) * x[k]
        x[2000 + k] = x[k] + 0.32 * np.linalg.norm(x[k]) / np.linalg.norm(noise) * noise
    x = x.astype(np.float32)
    vectors = embedding_rows(spark, [(50 * int(i) + 1, [float(v) for v in e], 0) for i, e in enumerate(x)])
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    got = {(r.vec_id - 1) // 50: r.n_links for r in embedding_dedup.link_vectors(vectors, sample_queries=64).collect()}
    assert sum(got.values()) >= 0.99 * hit.sum() > 0
    _, classes, dimension = embedding_dedup.classes_of(vectors)
    index = embedding_dedup.fit_index(classes, dimension)
    monkeypatch.setattr(embedding_dedup, "MAX_QUERIES", 64)  # too few links to tell: more cells
    assert embedding_dedup.visits_needed(classes, index, dimension, 0.995, 0.95, 64) >= embedding_dedup.FEW_VISITS


def test_recall_of_a_result(spark):
    rng = np.random.default_rng(13)
    x = np.repeat(rng.standard_normal((20, 8)), 5, axis=0) + 0.01 * rng.standard_normal((100, 8))
    x = np.concatenate([x, x[:3]])
    vectors = embedding_rows(spark, [(int(i), [float(v) for v in e], 0) for i, e in enumerate(x)])
    u = np.float32(x).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = int((u[:100] @ u.T >= 0.95).sum()) - 100 - 3  # neither itself nor copies
    linked = embedding_dedup.link_vectors(vectors)
    assert embedding_dedup.recall(vectors, linked) == (links, links)
    none = linked.withColumn("n_links", F.when(F.col("vec_id").isin(0, 1, 2, 100, 101, 102), 1).otherwise(0).cast("long"))
    assert embedding_dedup.recall(vectors, none) == (0, links)
    assert embedding_dedup.recall(embedding_rows(spark, []), linked) == (0, 0)


def test_multi_sequence_order():
    rng = np.random.default_rng(3)
    index = embedding_dedup.MultiIndex(rng.standard_normal((7, 4)), rng.standard_normal((7, 4)))
    x = rng.standard_normal((20, 8))
    a, b = index.distances(x)
    every = (a[:, :, None] + b[:, None, :]).reshape(20, -1)
    for count in (1, 3, 10, 49, 60):
        cells = index.visits(x, count)
        assert np.allclose(np.take_along_axis(every, cells, axis=1), np.sort(every, axis=1)[:, :count])
    assert (index.visits(x, 5)[:, 0] == index.home(x)).all()


def base_by_hand(text):
    t = text or ""
    words, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def junk(text):
    return " ".join(w + "$$#" for w in text.split())


@pytest.fixture(scope="module")
def graded(docs_of, labels_of, prose):
    rows = [(i, junk(prose(i)) if i % 6 == 0 else prose(i)) for i in range(300)]
    return rows, docs_of(rows), labels_of([(i, int(i % 6 != 0), 0) for i in range(0, 300, 2)] + [(None, 1, 0), (4, None, 0), (2, 1, 1), (9999, 0, 0)])


def test_quality_rules(graded, docs_of):
    rows, docs, labels = graded
    rows = rows + [(1000 + i, t) for i, (_, t) in enumerate(AWKWARD)]
    got = {r.doc_id: r for r in quality_rules.score_quality(docs_of(rows).withColumn("kept", F.lit(3)), labels).collect()}
    for d, t in rows:
        r, c = got[d], base_by_hand(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == c, d
        assert r.base_failed == (c[0] < 50 or 100 * c[4] > 50 * c[0])
        assert r.kept == (not r.base_failed and r.probability >= quality_rules.THRESHOLD)
    unseen = [d for d in range(1, 300, 2)]
    assert np.mean([got[d].kept == (d % 6 != 0) for d in unseen]) > 0.97
    kept = {r.doc_id for r in quality_rules.keep_quality(docs_of(rows), labels).collect()}
    assert kept == {d for d, r in got.items() if r.kept}


def test_frequencies_of_many_texts_share_their_arrays():
    import tracemalloc

    from sitelens.llm.quality_features import frequencies

    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefgh  ") for _ in range(rng.randrange(1, 4_000))).encode() for _ in range(200)] + [b""]
    frequencies(texts[:2], 17)
    tracemalloc.start()
    found = frequencies(texts, 17)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 60 * sum(map(len, texts))  # not one copy of all features for each text
    for text, (feature, value) in zip(texts, found):
        alone = frequencies([text], 17)[0]
        assert feature.tolist() == alone[0].tolist() and value.tolist() == alone[1].tolist()


@pytest.mark.parametrize("quality", [None, 0, 1])
def test_quality_without_two_classes(docs_of, labels_of, prose, quality):
    labels = labels_of([] if quality is None else [(0, quality, 0), (1, quality, 0)])
    docs = docs_of([prose(i) for i in range(4)] + [None])
    got = {r.doc_id: r for r in quality_rules.score_quality(docs, labels).collect()}
    assert [got[i].kept for i in range(5)] == [quality != 0] * 4 + [False]
    votes = {r.doc_id: r.score for r in quality_knn.score_documents(docs, labels).collect()}
    assert all(0 <= v <= 1 for v in votes.values()) and len(votes) == 5


def test_calibration_is_a_probability():
    rng = np.random.default_rng(0)
    z = rng.standard_normal(4000) * 3
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.7 * z - 0.4)))).astype(float)
    slope, shift = quality_rules.platt(z, y)
    assert slope == pytest.approx(0.7, abs=0.06) and shift == pytest.approx(-0.4, abs=0.12)


def test_votes_by_brute_force(graded, docs_of):
    """The blocked products give the votes of a plain nearest-neighbour count, and held-out labels are told apart."""
    rows, docs, labels = graded
    got = {r.doc_id: r for r in quality_knn.score_documents(docs, labels).collect()}
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, _ in rows)
    assert all(got[d].predicted == int(got[d].score >= 0.3) for d, _ in rows)
    held = [d for d, _ in rows if got[d].held_out]
    assert np.mean([got[d].predicted == int(d % 6 != 0) for d in held]) > 0.95

    known = [(d, int(d % 6 != 0)) for d in range(0, 300, 2) if zlib.crc32(str(d).encode()) % 5 != 0 and d != 4 or d == 4 and zlib.crc32(b"4") % 5 != 0]
    texts = dict(rows)
    x = [(d, y, quality_knn.term_vectors([texts[d].encode()], quality_knn.BITS)[0].astype(np.float16).astype(np.float32)) for d, y in sorted(known)]
    model = quality_knn.fit(x, quality_knn.BITS, quality_knn.RANK)
    for d in (1, 6, 18, 31, 60):
        v = model.latent(quality_knn.term_vectors([texts[d].encode()], quality_knn.BITS))[0]
        near = sorted(((float(v @ w), y) for w, y in zip(model.vectors, model.label)), reverse=True)[:quality_knn.NEIGHBOURS]
        weight = {k: sum(max(c, 0) ** quality_knn.SHARPNESS for c, y in near if y == k) / (model.prior if k else 1 - model.prior) for k in (0, 1)}
        assert got[d].score == pytest.approx(weight[1] / (weight[0] + weight[1]), abs=2e-3)


def test_votes_awkward(graded, awkward):
    _, _, labels = graded
    got = quality_knn.score_documents(awkward.withColumn("score", F.lit("clash")), labels).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    assert quality_knn.score_documents(awkward.limit(0), labels).count() == 0


def test_pipeline_stages(graded, spark, tmp_path, prose, docs_of):
    import corpus_pipeline

    rows, _, labels = graded
    passage = prose(4242, 60)
    rows = rows + [(400 + i, prose(600 + i, 60) + "\n" + passage) for i in range(6)] + [(500 + i, prose(1, 80)) for i in range(4)]
    rows += [(600, edited(prose(7, 200), random.Random(1), 1) + " mail me@home.example.org"), (601, prose(7, 200))] + [(700 + i, t) for i, (_, t) in enumerate(AWKWARD)]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = first = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs)
        if k < 4:
            assert docs.dtypes == first.dtypes, name
    quality, lines, joined, private, packed = ({r.doc_id: r for r in x.collect()} for x in seen)
    scored = {r.doc_id for r in quality_rules.score_quality(first, labels).where("kept").collect()}
    assert set(quality) == scored and all(quality[d].text == dict(rows)[d] for d in quality)
    assert passage in lines[400].text and all(passage not in lines[400 + i].text and lines[400 + i].text for i in range(1, 6))
    assert 1 in lines and not {500, 501, 502, 503} & set(lines)  # whole copies go
    sets = {d: shingles(r.text) for d, r in lines.items()}
    want = roots(sorted(sets), lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]))
    assert set(joined) == {d for d in want if want[d] == d}
    assert set(private) == set(joined) and all(r.n_chars == len(r.text) for r in private.values())
    assert not any("me@home" in r.text for r in private.values())
    assert set(packed) == set(private)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.select("doc_id", "start", "ids_crc32", "sequence_id").collect())) == sorted(map(tuple, seen[-1].select("doc_id", "start", "ids_crc32", "sequence_id").collect()))


def test_unrelated_sets_of_a_band_make_no_candidates(docs_of, spark):
    """2,000 unrelated texts of one band: no part is shared, so no pair is ever formed."""
    rng = np.random.default_rng(7)
    sets = [np.sort(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in rng.integers(330, 400, 2_000)]
    for percent in (80, 90):
        keys = np.concatenate(jaccard_join.tile_keys(sets, percent))
        assert len(keys) - len(np.unique(keys)) < 40  # sets with more empty parts than the surplus are rare
    a = sets[0]
    for percent in (80, 90):
        for drop in range(0, len(a) * (100 - percent) // 100 + 1, 5):
            x, y = jaccard_join.tile_keys([a, a[drop:]], percent)
            assert set(x) & set(y)
        few = [np.sort(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in range(1, 60)]
        for s in few:  # every pair of small sets that reaches the threshold meets, empty parts or not
            for drop in range(len(s)):
                if 100 * (len(s) - drop) >= percent * len(s):
                    x, y = jaccard_join.tile_keys([s, s[drop:]], percent)
                    assert set(x) & set(y)


def test_signatures_bound_the_difference():
    rng = np.random.default_rng(8)
    for n in (3, 40, 400, 1_500, 6_000):
        a, b = (np.sort(rng.integers(0, 2**63, n, dtype=np.uint64)) for _ in range(2))
        most = int(jaccard_join._most_different(n, n, 80))
        for other in (b, a[n // 8:], np.sort(np.concatenate([a[n // 10:], b[:n // 10]]))):
            bits = pa.array([jaccard_join.signature(a, 80), jaccard_join.signature(other, 80)], pa.list_(pa.int64()))
            x, y = jaccard_join._same_width(bits)
            unequal = int(np.bitwise_count(x ^ y).sum())
            assert unequal <= len(np.setxor1d(a, other))
            assert n < 40 or other is not b or unequal > 3 * most  # unrelated sets of any size are told apart


def test_results_outlive_the_scratch_of_others(docs_of, prose, spark):
    import corpus_pipeline

    from sitelens.llm.common import Scratch

    docs = docs_of([(i, prose(i // 2, 60)) for i in range(20)])
    mine = line_dedup.dedup_lines(docs)  # reads its tables when it is counted, below
    one, two = Scratch(), Scratch()
    with one.open():
        first = line_dedup.dedup_lines(docs)
    with two.open():
        line_dedup.dedup_lines(docs)
    assert len(one.paths) == len(two.paths) == 1
    two.release(spark)
    corpus_pipeline.line_stage(spark, docs, "").count()
    corpus_pipeline.line_stage(spark, docs, "").count()
    assert mine.count() == first.count() == 20


def test_ids_of_any_type(graded, docs_of, labels_of):
    _, docs, labels = graded
    named = lambda df: df.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    ids = {r.doc_id for r in named(docs).select("doc_id").collect()}
    scored = quality_rules.score_quality(named(docs), named(labels)).collect()
    assert {r.doc_id for r in scored} == ids
    votes = quality_knn.score_documents(named(docs).union(named(docs).limit(1).withColumn("doc_id", F.lit(None).cast("string"))), named(labels)).collect()
    assert {r.doc_id for r in votes} == ids | {None} and all(r.held_out is not None for r in votes)
    many = docs.union(docs.where("doc_id = 1")).union(docs.where("doc_id = 1"))
    assert quality_rules.labelled_sample(many, labels, "quality", 10_000).groupBy("doc_id").count().where("count > 1").count() == 0


@pytest.mark.parametrize("planted", [4_000, 30])
def test_recall_of_planted_links_among_many_vectors(spark, tmp_path, planted):
    """20,000 vectors of 64 numbers; copies with noise that leaves cosines of 0.95 to 0.99, many and few."""
    import pyarrow.parquet as pq

    rng = np.random.default_rng(planted)
    x = rng.standard_normal((20_000, 64))
    at = rng.permutation(20_000)[:2 * planted].reshape(2, -1)
    x[at[1]] = x[at[0]] + rng.uniform(0.14, 0.32, (planted, 1)) * rng.standard_normal((planted, 64))
    x = x.astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(20_000), "embedding": pa.array(list(x), pa.list_(pa.float32())), "label": pa.array(np.zeros(20_000, np.int32))}), f"{tmp_path}/v.parquet")
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    true = np.concatenate([(u[k:k + 2_000] @ u.T >= 0.95).sum(axis=1) - 1 for k in range(0, 20_000, 2_000)])
    assert 1.5 * planted < true.sum() <= 2 * planted + 20
    linked = embedding_dedup.link_vectors(spark.read.parquet(f"{tmp_path}/v.parquet")).toPandas().set_index("vec_id").sort_index()
    found = linked.n_links.to_numpy()
    assert (found <= true).all() and found.sum() >= 0.9 * true.sum()
    print("links found", int(found.sum()), "of", int(true.sum()))
    exact = at[:, found[at[0]] * found[at[1]] > 0]
    assert (linked.component_id.to_numpy()[exact[0]] == linked.component_id.to_numpy()[exact[1]]).mean() > 0.99
